"""Main text of pages by the template of their host, over tables.

1. Each page gives its tokens and how often each occurs. Pages of a host with the same
   texts count once, so that copies of a page make no template. Per host and token these are
   summed up before the shuffle: number of pages, and a checksum of the vector of
   occurrences by page. Tokens of a host with equal numbers and checksums occur equally
   often on the same pages and form an equivalence class.
2. A class is valid by its own support: on at least LEAST_PAGES pages, with at least
   CLASS_TOKENS tags, as each layout of a host has. A class with fewer tags may be a passage
   that pages share; it needs CLASS_TOKENS tokens on TEXT_PAGES pages and TEXT_SHARE of the
   host's. A class nests in the template if the tags around its tokens are on at least as many
   pages, in a class of their own or in this one. Valid classes make up the host's template.
3. Pages are joined with the template of their host, and the slots between its tokens
   are their text. Spark broadcasts the templates if they are small, else it joins by
   host and splits the rows of a frequent host.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.llm import html_blocks
from tablecraft.llm.common import Workspace

LEAST_PAGES = 4
CLASS_TOKENS = 2
TEXT_PAGES = 10
TEXT_SHARE = 0.8


@F.pandas_udf(T.StringType())
def hosts(urls: pd.Series) -> pd.Series:
    return pd.Series([html_blocks.host(u) for u in urls], dtype=object)


def tokens(pages: DataFrame) -> DataFrame:
    """(host, page, token, parent, n, tag): one row per distinct page of a host and token.

    page numbers the texts of the page, so that its copies count once; parent is the token
    of the enclosing tag; tag tells tags from texts. Texts inside an article or main element are no template, and texts
    beside the main text go anyway: both have no row.
    """
    kinds = [pa.string(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.bool_())]
    names = ["host", "page", "token", "parent", "n", "tag"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for url, page in zip(*(batch.column(c).to_pylist() for c in ("url", "html"))):
                read = html_blocks.parse(page)
                found = {token: (read.parents[token], n) for token, n in read.tags.items()}
                for block in read.blocks:
                    if not block.main and not block.beside:
                        found[block.token] = (block.path, found.get(block.token, (0, 0))[1] + 1)
                rows.append(
                    (
                        html_blocks.host(url),
                        html_blocks.shown(read.blocks),
                        list(found),
                        [parent for parent, _ in found.values()],
                        [n for _, n in found.values()],
                        [token in read.tags for token in found],
                    )
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names
            )

    lists = "token array<long>, parent array<long>, n array<long>, tag array<boolean>"
    read = pages.select("url", "html").mapInArrow(run, f"host string, page long, {lists}")
    # Of copies in different markup the least stands for all, whatever the order of rows.
    once = read.groupBy("host", "page").agg(F.min(F.struct("token", "parent", "n", "tag")).alias("one"))
    zipped = F.arrays_zip("one.token", "one.parent", "one.n", "one.tag")
    return once.select("host", "page", F.explode(zipped).alias("t")).select("host", "page", "t.*")


def template_tokens(pages: DataFrame, workspace: Workspace) -> DataFrame:
    """(host, token, tag): the tokens of the template of each host that has one."""
    counted = workspace.keep(
        tokens(pages)
        .groupBy("host", "token", "parent", "tag")
        .agg(
            F.count("*").alias("pages"),
            # The vector of occurrences by page, in a sum that does not depend on the order of pages.
            F.expr("bit_xor(xxhash64(page, n))").alias("vector"),
        ),
        "tokens",
    )
    # The token of most pages stands for the pages of its host.
    sizes = counted.groupBy("host").agg(F.max("pages").alias("all"))
    frequent = workspace.keep(counted.where(F.col("pages") >= LEAST_PAGES), "frequent")
    shared = (F.col("pages") >= TEXT_PAGES) & (F.col("pages") >= TEXT_SHARE * F.col("all"))
    classes = (
        frequent.groupBy("host", "pages", "vector")
        .agg(F.count("*").alias("size"), F.count_if("tag").alias("tags"))
        .where(F.col("size") >= CLASS_TOKENS)
        .join(sizes, "host")
        .where((F.col("tags") >= CLASS_TOKENS) | shared)
        .select("host", "pages", "vector")
    )
    valid = frequent.join(classes, ["host", "pages", "vector"])
    above = frequent.groupBy("host", F.col("token").alias("parent")).agg(F.max("pages").alias("above"))
    roots = F.col("parent") == html_blocks.OUTSIDE
    nested = valid.join(above, ["host", "parent"], "left").where(roots | (F.col("above") >= F.col("pages")))
    return nested.select("host", "token", "tag")


def templates(pages: DataFrame, workspace: Workspace, tags: bool = True) -> DataFrame:
    """(host, template): the token numbers of the template of each host, or without ``tags`` of its texts only."""
    found = template_tokens(pages, workspace)
    found = found if tags else found.where(~F.col("tag"))
    return found.groupBy("host").agg(F.sort_array(F.collect_set("token")).alias("template"))


@F.pandas_udf(T.StringType())
def _slots(pages: pd.Series, template: pd.Series) -> pd.Series:
    sets: dict[bytes, frozenset[int]] = {}
    out = []
    for page, known in zip(pages, template):
        key = b"" if known is None else known.tobytes()
        if key not in sets:
            sets[key] = frozenset() if known is None else frozenset(known.tolist())
        out.append(html_blocks.main_text(page, sets[key]))
    return pd.Series(out, dtype=object)


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, url, text and n_chars.

    A NULL or empty html has an empty text. Pages without a host share one template, as
    if they were of one host. Repeated rows stay repeated; an empty table gives an empty
    table; other columns are left out.
    """
    workspace = Workspace(pages.sparkSession, "html")
    known = workspace.keep(templates(pages, workspace, tags=False), "templates")
    rows = pages.select("page_id", "url", "html", hosts("url").alias("host")).join(known, "host", "left")
    return rows.select("page_id", "url", _slots("html", "template").alias("text")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )
