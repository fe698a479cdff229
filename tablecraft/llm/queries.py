"""One query per operator over its whole table, and SQL of the same meaning where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablecraft.llm import (
    bpe_tables,
    decontaminate_tables,
    dialogue_tables,
    html_tables,
    jaccard_tables,
    negatives_tables,
    pii_tables,
    quality,
    repeats_tables,
    shard_tables,
    simhash_tables,
    toxicity_tables,
    warc_tables,
)
from tablecraft.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql.strip()
        return function

    return register


WORDS_SQL = """
list_filter(string_split(translate(coalesce(text, ''), chr(9)||chr(10)||chr(11)||chr(12)||chr(13), '     '), ' '),
            lambda x: x <> '')"""

QUALITY_SQL = f"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {WORDS_SQL} AS w FROM documents
), windows AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS times FROM (
    SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS win
    FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM base))
), repeated AS (
  SELECT rid, count(DISTINCT place) AS n FROM (
    SELECT rid, unnest(range(i, i + 5)) AS place FROM windows WHERE times > 1) GROUP BY rid
), counted AS (
  SELECT doc_id, len(w) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, n_lines, stutters
  FROM (SELECT *, list_filter(string_split(text, chr(10)),
            lambda l: translate(l, ' '||chr(9)||chr(11)||chr(12)||chr(13), '') <> '') AS lines,
          len(string_split(text, chr(10))) AS n_lines,
          len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS stutters FROM base)
  LEFT JOIN repeated USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 20 * n_words
    OR 100 * n_dup_lines > 40 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 100 * stutters > 30 * n_words) AS kept
FROM counted
"""


@query("op10_quality_cascade", QUALITY_SQL)
def op10_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.statistics(table(spark, sf_dir, "documents"))


@query("op2_byte_bpe")
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tables.digests(table(spark, sf_dir, "documents"))


DECONTAMINATE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM (SELECT *, least(10, len(w)) AS n FROM items WHERE len(w) > 0))
), places AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM docs, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)
), hits AS (
  SELECT rid, i, n, item_id FROM places JOIN wins USING (n, win)
), hit_words AS (
  SELECT rid, count(DISTINCT place) AS n_hit
  FROM (SELECT rid, unnest(range(i, i + n)) AS place FROM hits) GROUP BY rid
), hit_items AS (
  SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
"""


@query("op5_benchmark_decontamination", DECONTAMINATE_SQL)
def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate_tables.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_personal_data")
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_tables.find(table(spark, sf_dir, "documents")).drop("scores")


@query("op8_simhash_near_duplicates")
def op8_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_tables.clusters(table(spark, sf_dir, "documents"))


@query("op3_shards_by_bytes")
def op3_shards_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_tables.by_bytes(table(spark, sf_dir, "documents"))


ARCHIVE_SQL = """
WITH p AS (
  SELECT row_number() OVER () AS rid, page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT rid, page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p
), r AS (
  SELECT *, first_value(page_id) OVER w AS best, row_number() OVER w AS place
  FROM d WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST, rid)
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND place > 1 THEN best END AS refers_to
FROM r
"""


@query("op4_legacy_archives", ARCHIVE_SQL)
def op4_legacy_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_tables.round_trip(table(spark, sf_dir, "pages"))


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_tables.score(docs, toxicity_tables.fit(docs, table(spark, sf_dir, "labels")))


@query("op9_html_main_text")
def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tables.extract(table(spark, sf_dir, "pages"))


@query("op6_repeated_strings")
def op6_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_tables.remove(table(spark, sf_dir, "documents"))


@query("op13_dialogue_repair")
def op13_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue_tables.report(table(spark, sf_dir, "conversations"))


NEGATIVES_SQL = """
WITH numbers AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), whole AS (
  SELECT vec_id, label, list_transform(x, lambda y: floor(256 * y)) AS v FROM numbers
  WHERE len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM whole a, whole b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id,
  positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 3
"""


@query("op12_hard_negatives", NEGATIVES_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives_tables.mine(table(spark, sf_dir, "embeddings"))


JACCARD_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id, {WORDS_SQL.replace("coalesce(text, '')",
    "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
  FROM documents
), grams AS (
  SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS gram
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
), sizes AS (
  SELECT rid, count(*) AS n FROM grams GROUP BY rid
), shared AS (
  SELECT a.rid AS u, b.rid AS v, count(*) AS n_both FROM grams a JOIN grams b USING (gram) WHERE a.rid <> b.rid GROUP BY ALL
), links AS (
  SELECT u, v FROM shared JOIN sizes a ON a.rid = u JOIN sizes b ON b.rid = v WHERE 100 * n_both >= 80 * (a.n + b.n - n_both)
), reach AS (
  SELECT rid, rid AS other FROM docs
  UNION
  SELECT reach.rid, v FROM reach JOIN links ON other = u
)
SELECT docs.doc_id, coalesce(n, 0) AS n_shingles, min(others.doc_id) AS component_id
FROM reach JOIN docs USING (rid) JOIN docs others ON others.rid = other LEFT JOIN sizes ON sizes.rid = docs.rid
GROUP BY docs.rid, docs.doc_id, n
"""


@query("op11_jaccard_join", JACCARD_SQL)
def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_tables.clusters(table(spark, sf_dir, "documents"))
