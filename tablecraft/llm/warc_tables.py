"""Legacy archives and WARC files over tables.

Files are written by Spark's text writer, whose line separator is the separator of
records, and read as whole files of at most RECORDS_PER_FILE records each; so they may
lie in any store that Spark reads. Blocks are bytes all the way.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.llm import warc
from tablecraft.llm.common import Workspace

RECORDS_PER_FILE = 2000
CAPTURED = "20240101000000"
#: Payloads below this size are never revisits.
LEAST_PAYLOAD = 1000
#: Bytes of blocks that leave Python at once, unless one block is larger.
BATCH_BYTES = 1 << 20


def _write(records: DataFrame, path: str, separator: str) -> None:
    (
        records.select(F.col("record").cast("string").alias("record"))
        .write.option("lineSep", separator)
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .option("compression", "gzip")
        .text(path)
    )


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _binary(values: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], names=["record"])


def write_arc(pages: DataFrame, path: str, captured: str = CAPTURED) -> None:
    """Legacy archives of ``pages`` (page_id, url, html); tasks take turns at versions 1 and 2."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        version, n = 1 + task % 2, 0
        for batch in batches:
            out = []
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                name = f"pages-{task:06d}-{n // RECORDS_PER_FILE:06d}.arc"
                if n % RECORDS_PER_FILE == 0:
                    out.append(warc.arc_version_block(version, name, captured))
                    n += 1
                block = warc.http_block(page_id, (html or "").encode("utf-8", "replace"))
                out.append(warc.arc_header(version, url, captured, "text/html", name, n, block) + b"\n" + block)
                n += 1
            yield _binary(out)

    _write(pages.select("page_id", "url", "html").mapInArrow(records, "record binary"), path, "\n")


def _arc_records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, warc.ArcRecord]]:
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            name = path.as_py().rpartition("/")[2]
            for record in warc.read_arc(gzip.decompress(content.as_buffer())):
                yield name, record


def arc_index(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, page_id, digest, payload_bytes) of every record of the archives below ``path``."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for name, record in _arc_records(batches):
            fields, payload = warc.http_parts(record.block)
            page = fields.get("x-page-id")
            rows.append((warc.record_id(name, record.offset), page and int(page), warc.sha1(payload), len(payload)))
            if len(rows) == RECORDS_PER_FILE:
                yield _index_batch(rows)
                rows = []
        yield _index_batch(rows)

    return _files(spark, path).mapInArrow(
        index, "record_id string, page_id long, digest string, payload_bytes long"
    )


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["record_id", "page_id", "digest", "payload_bytes"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def revisits(index: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """(record_id, original, original_page) of the records that revisit another one.

    Of equal payloads of at least ``least`` bytes the record of the largest page_id is
    the original, of several such the one with the largest record_id; a record without
    page_id comes last.
    """
    large = index.where(F.col("payload_bytes") >= least)
    best = F.max(F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("rank"), "record_id", "page_id"))
    groups = large.groupBy("digest").agg(F.count("*").alias("n"), best.alias("best")).where("n > 1")
    return (
        large.join(groups, "digest")
        .where(F.col("record_id") != F.col("best.record_id"))
        .select(
            "record_id",
            F.col("best.record_id").alias("original"),
            F.col("best.page_id").alias("original_page"),
        )
    )


PARSED = pa.schema(
    [
        ("record_id", pa.string()),
        ("archive", pa.string()),
        ("at", pa.int64()),
        ("url", pa.string()),
        ("date", pa.string()),
        ("block", pa.binary()),
    ]
)


def _parsed_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[k] for r in rows], field.type) for k, field in enumerate(PARSED)], schema=PARSED
    )


def convert(spark: SparkSession, arc_path: str, warc_path: str, workspace: Workspace) -> None:
    """WARC files of the legacy archives below ``arc_path``."""
    index = workspace.keep(arc_index(spark, arc_path), "index")
    again = workspace.keep(revisits(index), "revisits")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for name, r in _arc_records(batches):
            rows.append((warc.record_id(name, r.offset), name, r.offset, r.url, r.date, r.block))
            held += len(r.block)
            if held >= BATCH_BYTES:
                yield _parsed_batch(rows)
                rows, held = [], 0
        yield _parsed_batch(rows)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                original = None
                if r["original"] is not None:
                    page = r["original_page"]
                    original = (r["original"], "" if page is None else str(page))
                record = warc.ArcRecord(r["url"], r["date"], "", r["at"], r["block"])
                out.append(warc.convert(record, r["archive"], original))
            yield _binary(out)

    records = _files(spark, arc_path).mapInArrow(
        parse, "record_id string, archive string, at long, url string, date string, block binary"
    )
    if again.isEmpty():
        joined = records.selectExpr("*", "CAST(NULL AS STRING) AS original", "CAST(NULL AS BIGINT) AS original_page")
    else:
        joined = records.join(again, "record_id", "left")
    _write(joined.mapInArrow(write, "record binary"), warc_path, "\r\n\r\n")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id).

    Digests of responses are computed again from what was read and must agree.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def row(record: warc.WarcRecord) -> tuple:
        head = record.headers
        fields, payload = warc.http_parts(record.block)
        digest, length = head["WARC-Payload-Digest"].partition(":")[2], int(head["WARC-Payload-Length"])
        if head["WARC-Type"] == "response" and (digest, length) != (warc.sha1(payload), len(payload)):
            raise ValueError(f"{head['WARC-Record-ID']} does not have the payload of its digest")
        page, refers = fields.get("x-page-id"), head.get("WARC-Refers-To-Page")
        return page and int(page), length, digest, head["WARC-Type"], refers and int(refers)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = [row(r) for r in warc.read_warc(gzip.decompress(content.as_buffer()))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names
                )

    return _files(spark, path).mapInArrow(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) as legacy archives, converted to WARC files and read back.

    A NULL html is an empty payload; a NULL url is written as "-". Rows that repeat are
    records of their own; of several with the largest page_id one is the response. An
    empty table gives an empty table; other columns are left out.
    """
    spark = pages.sparkSession
    workspace = Workspace(spark, "archives")
    arc_path, warc_path = workspace.path("arc"), workspace.path("warc")
    write_arc(pages, arc_path)
    convert(spark, arc_path, warc_path, workspace)
    workspace.drop("arc")
    return read_warc(spark, warc_path)
