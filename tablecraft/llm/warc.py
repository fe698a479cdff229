"""Legacy archive records to WARC records: parsing by declared lengths, and writing, of bytes.

A legacy archive starts with a version block, whose first line gives the version and
whose second names the fields of the header lines that follow; each record is a header
line, as many bytes as its last field declares, and a line feed.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

# Header fields of versions 1 and 2 of the legacy format.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


@dataclass
class ArcRecord:
    url: str
    date: str
    content_type: str
    offset: int
    block: bytes


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes


def printable(value: str | None, none: str = "-") -> str:
    """A field of a header line: blanks and control characters are percent-encoded."""
    if not value:
        return none
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def arc_header(version: int, url: str | None, date: str, mime: str, name: str, offset: int, block: bytes) -> bytes:
    """A header line without its line feed."""
    fields = [printable(url), "0.0.0.0", date, mime]
    if version == 2:
        fields += ["200", hashlib.md5(block).hexdigest(), "-", str(offset), name]
    return " ".join([*fields, str(len(block))]).encode("utf-8", "replace")


def arc_version_block(version: int, name: str, date: str) -> bytes:
    """The first record of an archive, without the line feed after it."""
    block = f"{version} 0 archive\n{FIELDS[version]}\n".encode()
    return arc_header(version, f"filedesc://{name}", date, "text/plain", name, 0, block) + b"\n" + block


def http_block(page_id: int | None, payload: bytes) -> bytes:
    """The answer of a server, with the page's number as a header field of its own."""
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + payload


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and payload."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        head, gap, payload = block.partition(b"\n\n")
    fields = {}
    for line in head.decode("latin-1").splitlines()[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return fields, payload


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """All records after the version block, by the fields that it names."""
    at, names = 0, []
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"a header line without an end at byte {at}")
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        length = int(line.rpartition(" ")[2])
        block = data[end + 1 : end + 1 + length]
        if len(block) != length:
            raise ValueError(f"a record of {length} bytes at byte {at} is cut off")
        if not names:
            # The version block describes itself.
            names = block.decode("utf-8", "replace").splitlines()[1].split()
        else:
            # From the right: only the first field, the address, may hold blanks.
            values = dict(zip(names, line.rsplit(" ", len(names) - 1)))
            yield ArcRecord(values["URL"], values["Archive-date"], values["Content-type"], at, block)
        at = end + 1 + length


def sha1(data: bytes) -> str:
    return hashlib.sha1(data).hexdigest()


def record_id(archive: str, offset: int) -> str:
    """The same record of the same archive always gets the same identifier."""
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{archive}#{offset}')}>"


def warc_date(date: str) -> str:
    """14 digits (shorter ones are filled up) to the form of WARC."""
    d = (date + "00000101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_head(headers: dict[str, str], block: bytes) -> bytes:
    """A record without the two line ends after its block."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items() if v), f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "replace") + block


def convert(record: ArcRecord, archive: str, original: tuple[str, str] | None = None) -> bytes:
    """The WARC record of an archived answer; with ``original`` (record id, page number) a revisit of it.

    A revisit keeps the answer's header fields and leaves out its payload, whose
    digest and length stay in the record.
    """
    fields, payload = http_parts(record.block)
    head = record.block[: len(record.block) - len(payload)]
    block = head if original else record.block
    digest = sha1(payload)
    return warc_head(
        {
            "WARC-Type": "revisit" if original else "response",
            "WARC-Record-ID": record_id(archive, record.offset),
            "WARC-Date": warc_date(record.date),
            "WARC-Target-URI": record.url,
            "Content-Type": "application/http;msgtype=response",
            "WARC-Block-Digest": f"sha1:{sha1(block)}",
            "WARC-Payload-Digest": f"sha1:{digest}",
            "WARC-Payload-Length": str(len(payload)),
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if original else "",
            "WARC-Refers-To": original[0] if original else "",
            "WARC-Refers-To-Page": original[1] if original else "",
        },
        block,
    )


def read_warc(data: bytes) -> Iterator[WarcRecord]:
    """All records, by their declared lengths."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError(f"a record header without an end at byte {at}")
        headers = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip()] = value.strip()
        length = int(headers["Content-Length"])
        block = data[end + 4 : end + 4 + length]
        if len(block) != length:
            raise ValueError(f"a record of {length} bytes at byte {at} is cut off")
        yield WarcRecord(headers, block)
        at = end + 4 + length
