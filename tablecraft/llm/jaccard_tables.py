"""Groups of documents by an exact Jaccard join of their n-grams, cut vertically.

1. N-grams are hashed to numbers, and one pass counts them by slots of these hashes: all
   n-grams of all documents, in a table of fixed size. Slots with few n-grams come first
   in the global order.
2. A document becomes its set of n-grams in that order. Equal sets are one class, and
   classes are compared, not documents. A class keeps its size, its first n-grams and a
   parity bitmap of all.
3. Linked sets share one of their first n-grams (``prefix``), so the sets that share one
   are a bucket. N-grams of frequent slots go past the shuffle that looks for buckets.
4. Buckets are not expanded into all their pairs. Each is first linked as a star to one
   of its sets; then, between sets that are not yet in one group, as a forest. Sizes and
   bitmaps, which bound the difference of two sets from below, rule out pairs.
5. Pairs are decided exactly: the global order is cut into FRAGMENTS, the sets of all
   pairs are cut with it, overlaps are counted per pair and fragment and summed per pair.
6. Pairs between groups that no bound rules out and that have not been counted yet are
   counted last. So every pair is linked, in one group already, or ruled out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.llm import shingle_sets as sets
from tablecraft.llm.common import Workspace, shuffle_tasks
from tablecraft.llm.graph import components
from tablecraft.llm.simhash import Forest

#: Pieces of the global order, counted separately.
FRAGMENTS = 8
#: Sets of one side of a comparison in a task.
TILE_ROWS = 2048
#: A slot is frequent if it holds this many n-grams more than twice the mean.
FREQUENT = 1000
#: Rows per task of the shuffle that looks for buckets.
BUCKET_ROWS = 1_000_000
#: Bits per wanted set, and the most bits, of the filter that picks the texts to be cut.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 27
#: Numbers of a row of a table that tasks add up.
ROW_NUMBERS = 4096


def _summed(parts: DataFrame, n: int, add) -> np.ndarray:
    """One array of ``n`` numbers from rows (part, numbers), put together element by element with ``add``."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, None
        for batch in batches:
            for p, raw in zip(batch.column("part").to_pylist(), batch.column("numbers").to_pylist()):
                numbers = np.frombuffer(raw, np.int64)
                if p != part:
                    if part is not None:
                        yield _part_rows([part], [held])
                    part, held = p, numbers.copy()
                else:
                    add(held, numbers, out=held)
        if part is not None:
            yield _part_rows([part], [held])

    out = np.zeros(n, np.int64)
    for row in parts.repartition("part").sortWithinPartitions("part").mapInArrow(total, "part int, numbers binary").collect():
        numbers = np.frombuffer(row["numbers"], np.int64)
        out[row["part"] * ROW_NUMBERS : row["part"] * ROW_NUMBERS + len(numbers)] = numbers
    return out


def _part_rows(parts: list[int], arrays: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(parts, pa.int32()), pa.array([a.tobytes() for a in arrays], pa.binary())], names=["part", "numbers"]
    )


def _cut_rows(numbers: np.ndarray) -> pa.RecordBatch:
    at = [k for k in range(0, len(numbers), ROW_NUMBERS) if numbers[k : k + ROW_NUMBERS].any()]
    return _part_rows([k // ROW_NUMBERS for k in at], [numbers[k : k + ROW_NUMBERS] for k in at])


def slot_counts(docs: DataFrame, shingle: int) -> np.ndarray:
    """Distinct n-grams of each document, counted by slot over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(sets.SLOTS, np.int64)
        for batch in batches:
            found = [sets.hashes(t, shingle) for t in batch.column("text").to_pylist()]
            held += np.bincount(sets.slots(np.concatenate(found)) if found else [], minlength=sets.SLOTS).astype(np.int64)
        yield _cut_rows(held)

    return _summed(docs.select("text").mapInArrow(count, "part int, numbers binary"), sets.SLOTS, np.add)


MARKED = "doc_id long, n long, name long, first array<long>, bitmap binary"


def _signed(numbers: np.ndarray) -> np.ndarray:
    """The same order as signed numbers."""
    return (numbers ^ np.uint64(1 << 63)).view(np.int64)


def marked(docs: DataFrame, rank, shingle: int) -> DataFrame:
    """Per document: the size and name of its set, the first n-grams and the bitmap."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                size, name, first, bitmap = [], [], [], []
                for text in batch.column("text").to_pylist():
                    found = sets.hashes(text, shingle)
                    numbers = sets.ordered(found, rank.value)
                    size.append(len(found))
                    name.append(sets.name(numbers))
                    first.append(_signed(numbers[: sets.prefix(len(numbers))]))
                    bitmap.append(sets.parity(found).tobytes() if len(found) else b"")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), pa.array(size, pa.int64()),
                        pa.array(np.array(name, np.uint64).view(np.int64)), pa.array(first, pa.list_(pa.int64())),
                        pa.array(bitmap, pa.binary()),
                    ],
                    names=["doc_id", "n", "name", "first", "bitmap"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(mark, MARKED)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, name) of keys with two names or more, from rows sorted by key; equal lists of names are given once."""
    known: set[bytes] = set()
    rest_k, rest_n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def chosen(keys: np.ndarray, names: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        ends = np.append(starts[1:], len(keys))
        several = np.flatnonzero(ends - starts > 1)
        keep = []
        for a, b in zip(starts[several].tolist(), ends[several].tolist()):
            own = names[a:b].tobytes()
            own = own if len(own) <= 64 else xxhash.xxh3_128_digest(own)
            if own not in known:
                if len(known) > 1_000_000:
                    known.clear()
                known.add(own)
                keep.append(np.arange(a, b))
        at = np.concatenate(keep) if keep else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(names[at])], names=["key", "name"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.concatenate([rest_k, batch.column("key").to_numpy()])
        names = np.concatenate([rest_n, batch.column("name").to_numpy()])
        # The last key may go on in the next batch.
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield chosen(keys[:cut], names[:cut])
        rest_k, rest_n = keys[cut:], names[cut:]
    if len(rest_k):
        yield chosen(rest_k, rest_n)


def buckets(classes: DataFrame, border: int) -> DataFrame:
    """(key, name): the sets of each n-gram that is among the first of two sets or more.

    N-grams from ``border`` on are frequent; they are not looked through for single sets.
    """
    rows = classes.select(F.explode("first").alias("key"), "name")
    n = classes.agg(F.sum(F.size("first"))).first()[0] or 0
    tasks = shuffle_tasks(classes.sparkSession, n, BUCKET_ROWS)
    rare = rows.where(F.col("key") < border).repartition(tasks, "key").sortWithinPartitions("key", "name")
    return rare.mapInArrow(_shared, "key long, name long").unionAll(rows.where(F.col("key") >= border))


@F.pandas_udf(T.BooleanType())
def _may_link(n1: pd.Series, bitmap1: pd.Series, n2: pd.Series, bitmap2: pd.Series) -> pd.Series:
    """Whether sizes and bitmaps let two sets be linked."""
    out = []
    for a, x, b, y in zip(n1, bitmap1, n2, bitmap2):
        if len(x) < len(y):
            a, x, b, y = b, y, a, x
        p, q = int.from_bytes(x, "little"), int.from_bytes(y, "little")
        if len(x) > len(y):
            half = 4 * len(x)
            p = (p ^ (p >> half)) & ((1 << half) - 1)
        near = len(x) <= 2 * len(y) and sets.SHARE * max(a, b) <= sets.SHARE_OF * min(a, b)
        out.append(near and (a + b - (p ^ q).bit_count()) // 2 >= sets.least_shared(a + b))
    return pd.Series(out, dtype=bool)


def stars(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (u, v) of the least set of each bucket with the others, as far as bounds allow."""
    lead = shared.groupBy("key").agg(F.min("name").alias("u"))
    pairs = shared.join(lead, "key").where("name <> u").select("u", F.col("name").alias("v")).distinct()
    one = classes.select(F.col("name").alias("u"), F.col("n").alias("n1"), F.col("bitmap").alias("b1"))
    two = classes.select(F.col("name").alias("v"), F.col("n").alias("n2"), F.col("bitmap").alias("b2"))
    near = F.expr(f"{sets.SHARE} * greatest(n1, n2) <= {sets.SHARE_OF} * least(n1, n2)")
    return pairs.join(one, "u").join(two, "v").where(near).where(_may_link("n1", "b1", "n2", "b2")).select("u", "v")


def grouped(names: DataFrame, links: DataFrame, workspace: Workspace) -> DataFrame:
    """(name, component) of all names by links."""
    found = components(links, workspace)
    return names.join(found, names["name"] == found["node"], "left").select("name", F.coalesce("component", "name").alias("component"))


def _compare(batches: Iterator[pa.RecordBatch], forest: bool) -> Iterator[pa.RecordBatch]:
    """Pairs between different groups in each comparison of a partition sorted by comparison.

    With ``forest`` only those that join the groups of the comparison, closest first.
    """
    held: list[dict] = []

    def pairs(rows: list[dict]) -> pa.RecordBatch:
        names = np.array([r["name"] for r in rows], np.int64)
        groups = np.array([r["component"] for r in rows], np.int64)
        size = np.array([r["n"] for r in rows], np.int64)
        maps = [np.frombuffer(r["bitmap"], np.uint64) for r in rows]
        side = np.array([r["side"] for r in rows]) if rows[0]["a"] != rows[0]["b"] else None
        i, j, shared = sets.close_pairs(size, maps, groups, side)
        if forest and len(i):
            places = {g: k for k, g in enumerate(np.unique(groups).tolist())}
            trees = Forest(len(places))
            keep = []
            for k in np.argsort(-shared / (size[i] + size[j]), kind="stable").tolist():
                before = len(trees.links)
                trees.add(np.array([places[groups[i[k]]]]), np.array([places[groups[j[k]]]]))
                if len(trees.links) > before:
                    keep.append(k)
            i, j = i[keep], j[keep]
        u, v = np.minimum(names[i], names[j]), np.maximum(names[i], names[j])
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        for row in batch.to_pylist():
            if held and any(row[k] != held[0][k] for k in ("lead", "a", "b")):
                if len(held) > 1:
                    yield pairs(held)
                held = []
            held.append(row)
    if len(held) > 1:
        yield pairs(held)


def between(shared: DataFrame, classes: DataFrame, groups: DataFrame, forest: bool, tile_rows: int) -> DataFrame:
    """Pairs (u, v) of sets in one bucket and in different groups that bounds do not rule out."""
    rows = shared.join(groups, "name")
    mixed = (
        rows.groupBy("key")
        .agg(F.min("component").alias("lead"), F.max("component").alias("last"))
        .where("lead <> last")
        .select("key", "lead")
    )
    # Buckets with one least group are one pool, in which a set lies once, not once per n-gram.
    pools = rows.join(mixed, "key").select("lead", "name", "component").distinct()
    parts = pools.groupBy("lead").agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("parts"))
    dealt = (
        pools.join(parts, "lead")
        .withColumn("own", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "lead", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
            (F.col("own") > F.col("other")).cast("int").alias("side"), "name", "component",
        )
    )
    full = dealt.join(classes.select("name", "n", "bitmap"), "name")
    keys = ["lead", "a", "b"]
    return (
        full.repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(lambda batches: _compare(batches, forest), "u long, v long")
        .distinct()
    )


def _mark_of(name: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    return sets._mixed(name.view(np.uint64) ^ sets._mixed(doc_id.view(np.uint64)))


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(-(2**63)).to_numpy(zero_copy_only=False)


def segments(docs: DataFrame, wanted: DataFrame, rank, borders: np.ndarray, shingle: int) -> DataFrame:
    """(name, fragment, n, keys) of the ``wanted`` sets (name, least_id), cut at ``borders``.

    Texts are hashed once more; a filter of the wanted sets, of checked size, keeps the
    rest out of the shuffle. Some others may pass, and a set may be given twice.
    """
    count = wanted.count()
    bits = min(MOST_FILTER_BITS, 1 << max(18, (FILTER_BITS * count).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            at = _mark_of(batch.column("name").to_numpy(), _ids(batch.column("least_id"))) % np.uint64(bits)
            np.bitwise_or.at(held, at // np.uint64(64), np.uint64(1) << at % np.uint64(64))
        yield _cut_rows(held.view(np.int64))

    found = _summed(wanted.select("name", "least_id").mapInArrow(mark, "part int, numbers binary"), bits // 64, np.bitwise_or)
    shared = docs.sparkSession.sparkContext.broadcast(found.view(np.uint64))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                out = []
                for text, doc_id in zip(batch.column("text").to_pylist(), _ids(batch.column("doc_id")).tolist()):
                    numbers = sets.ordered(sets.hashes(text, shingle), rank.value)
                    name = np.array([sets.name(numbers)], np.uint64)
                    place = int(_mark_of(name, np.array([doc_id], np.int64))[0]) % bits
                    if not int(shared.value[place // 64]) >> place % 64 & 1:
                        continue
                    ends = [0, *np.searchsorted(numbers, borders).tolist(), len(numbers)]
                    out += [
                        (int(name.view(np.int64)[0]), f, len(numbers), _signed(numbers[a:b]))
                        for f, (a, b) in enumerate(zip(ends, ends[1:])) if b > a
                    ]
                if out:
                    columns = list(zip(*out))
                    types = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(c), t) for c, t in zip(columns, types)], names=["name", "fragment", "n", "keys"]
                    )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        cut, "name long, fragment int, n long, keys array<long>"
    )


def counted(pairs: DataFrame, pieces: DataFrame) -> DataFrame:
    """Linked pairs (u, v): overlaps counted per fragment, then summed."""
    one = pieces.select(F.col("name").alias("u"), "fragment", F.col("n").alias("n1"), F.col("keys").alias("k1"))
    two = pieces.select(F.col("name").alias("v"), "fragment", F.col("n").alias("n2"), F.col("keys").alias("k2"))
    partial = (
        pairs.join(one, "u")
        .join(two, ["v", "fragment"])
        .select("u", "v", "fragment", "n1", "n2", F.size(F.array_intersect("k1", "k2")).alias("overlap"))
        # A text that repeats gives the same overlap again.
        .groupBy("u", "v", "fragment")
        .agg(F.max("overlap").alias("overlap"), F.max("n1").alias("n1"), F.max("n2").alias("n2"))
    )
    total = partial.groupBy("u", "v").agg(F.sum("overlap").alias("both"), F.max(F.col("n1") + F.col("n2")).alias("all"))
    return total.where(F.expr(f"{sets.SHARE_OF} * both >= {sets.SHARE} * (`all` - both)")).select("u", "v")


def linked(docs: DataFrame, workspace: Workspace, shingle: int = sets.SHINGLE, tile_rows: int = TILE_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, classes, links): doc_id, n and name; name, n and least_id; u and v, which join linked sets."""
    spark = docs.sparkSession
    counts = slot_counts(docs, shingle)
    rank = spark.sparkContext.broadcast(sets.ranks(counts))
    borders = sets.cuts(counts, FRAGMENTS)
    rare = int((np.sort(counts) <= 2 * counts.mean() + FREQUENT).sum())
    border = int(_signed(np.array([rare], np.uint64) << sets._REST)[0]) if rare < sets.SLOTS else 2**63 - 1

    all_marks = workspace.keep(marked(docs, rank, shingle), "marked")
    classes = workspace.keep(
        all_marks.where("n > 0")
        .groupBy("name")
        .agg(F.min("doc_id").alias("least_id"), *[F.any_value(c).alias(c) for c in ("n", "first", "bitmap")]),
        "classes",
    )
    documents = workspace.keep(all_marks.select("doc_id", "n", "name"), "documents")
    workspace.drop("marked")
    shared = workspace.keep(buckets(classes, border), "buckets")

    def decided(pairs: DataFrame, step: str) -> DataFrame:
        names = pairs.select(F.explode(F.array("u", "v")).alias("name")).distinct()
        wanted = workspace.keep(classes.select("name", "least_id").join(names, "name"), f"wanted-{step}")
        pieces = workspace.keep(segments(docs, wanted, rank, borders, shingle), f"pieces-{step}")
        found = workspace.keep(counted(pairs, pieces), f"links-{step}")
        workspace.drop(f"pieces-{step}")
        return found

    star = workspace.keep(stars(shared, classes), "stars")
    names = shared.select("name").distinct()
    groups = workspace.keep(grouped(names, star, workspace), "groups-star")
    forest = workspace.keep(between(shared, classes, groups, True, tile_rows), "forest")
    tried = star.unionAll(forest).distinct()
    links = decided(tried, "one")
    groups = workspace.keep(grouped(names, links, workspace), "groups-one")
    rest = between(shared, classes, groups, False, tile_rows).join(tried, ["u", "v"], "left_anti")
    rest = workspace.keep(rest, "rest")
    if rest.limit(1).count():
        links = links.unionAll(decided(rest, "two"))
    return documents, classes.select("name", "n", "least_id"), links


def clusters(docs: DataFrame, shingle: int = sets.SHINGLE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles and component_id.

    Sets are compared by 64-bit hashes of their n-grams; equal 64-bit names stand for
    equal sets. A NULL text is empty. Documents without words have no n-gram, are linked
    with nothing and are their own component. Rows that repeat stay repeated. A NULL
    doc_id is no candidate for a component_id. An empty table gives an empty table;
    other columns are left out.
    """
    workspace = Workspace(docs.sparkSession, "jaccard")
    documents, classes, links = linked(docs, workspace, shingle)
    groups = grouped(classes, links, workspace)
    named = classes.join(groups, "name").select("name", "least_id", "component")
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = workspace.keep(named.join(least, "component").select("name", "component_id"), "named")
    alone = documents.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return (
        documents.where("n > 0")
        .join(named, "name")
        .select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        .unionAll(alone)
    )
