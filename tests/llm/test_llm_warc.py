import hashlib

import duckdb
import pytest

import compare
import edges
from tablecraft.llm import queries, warc, warc_tables

PAGE = "<p>" + "é x\r\n\r\n" * 400
ROWS = [
    (1, "http://a b/\n", PAGE), (2, None, PAGE), (9, "u", PAGE), (9, "u", PAGE), (3, "u", None), (4, "u", ""),
    (5, "u", "short"), (6, "u", "short"), (None, "u", PAGE), (7, "ü", "\x01" + "z" * 2000), (8, "v", "\x01" + "z" * 2000),
    (10, "w", "y" * 300_000), (11, "w", "y" * 999), (12, "w", "y" * 999), (13, "w", "y" * 1000), (14, "w", "y" * 1000),
]


def test_odd_rows_as_sql_says(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "page_id long, url string, html string, record string, path int")
    pages.select("page_id", "url", "html").write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages/*.parquet')")
    got = warc_tables.round_trip(pages)
    assert compare.difference(got, con, queries.SQL["op4_legacy_archives"]) is None
    assert warc_tables.round_trip(pages.limit(0)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_versions_and_lengths(version):
    blocks = [warc.http_block(k, b"a\nb\r\n\r\n" * k) for k in range(4)] + [b"", b"\n\n"]
    data = warc.arc_version_block(version, "x.arc", "20240102030405") + b"\n"
    for k, block in enumerate(blocks):
        data += warc.arc_header(version, f"http://h/{k} k", "20240102030405", "text/html", "x.arc", k, block) + b"\n" + block + b"\n"
    records = list(warc.read_arc(data))
    assert [r.block for r in records] == blocks
    assert [r.url for r in records] == [f"http://h/{k}%20k" for k in range(6)]
    with pytest.raises(ValueError):
        list(warc.read_arc(data[:-10]))


def test_address_with_blanks():
    block = b"x"
    line = b"http://h/a b 1.2.3.4 20200101 text/html 1\n" + block + b"\n"
    record = list(warc.read_arc(warc.arc_version_block(1, "x", "2020") + b"\n" + line))[0]
    assert (record.url, record.date, record.block) == ("http://h/a b", "20200101", block)
    assert warc.warc_date(record.date) == "2020-01-01T00:00:00Z"


def test_records_and_revisits():
    record = warc.ArcRecord("http://h/", "20240102030405", "text/html", 7, warc.http_block(3, b"payload"))
    whole = list(warc.read_warc(warc.convert(record, "x.arc") + b"\r\n\r\n"))[0]
    assert whole.block == record.block and whole.headers["WARC-Type"] == "response"
    assert whole.headers["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(b"payload").hexdigest()
    assert whole.headers["WARC-Date"] == "2024-01-02T03:04:05Z"
    again = list(warc.read_warc(warc.convert(record, "x.arc", ("<urn:uuid:1>", "9"))))[0]
    assert again.headers["WARC-Record-ID"] == whole.headers["WARC-Record-ID"]
    assert again.headers["WARC-Refers-To"] == "<urn:uuid:1>" and b"payload" not in again.block
    assert again.headers["WARC-Payload-Digest"] == whole.headers["WARC-Payload-Digest"]


def test_empty_documents_are_no_pages(spark):
    assert edges.empty(spark).count() == 0
