"""Groups of near copies by SimHash over tables.

1. Every text gets its fingerprint; equal fingerprints become one row before anything
   is compared.
2. Fingerprints within the radius of r bits agree in at least one of r + 1 blocks of
   bits, so each goes to r + 1 buckets, by block and its value. No pair within the
   radius is missed.
3. A bucket is a tile of fingerprints; one above TILE_ROWS is dealt out into parts by
   number of set bits and by hash, and each pair of parts that can hold a close pair is
   a task's work; pairs of parts whose numbers of set bits differ beyond the radius are
   left out. Two tiles are compared whole, by exclusive or and bit counts.
4. A task gives the links of a spanning forest of what it found, not all pairs, and
   connected components of these links are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.llm.common import Workspace, fresh, shuffle_tasks
from tablecraft.llm.graph import components
from tablecraft.llm.simhash import BITS, RADIUS, Forest, close_pairs, fingerprint

#: Fingerprints of one side of a comparison in a task.
TILE_ROWS = 8192
#: Rows of buckets per shuffle task.
BUCKET_ROWS = 400_000


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    """Fingerprints as signed longs of the same 64 bits."""
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 1 blocks that together hold all bits."""
    cuts = [BITS * k // (radius + 1) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def buckets(prints: DataFrame, radius: int) -> DataFrame:
    """(block, value, fp): one row per fingerprint and block of bits."""
    values = [
        F.struct(
            F.lit(k).alias("block"),
            F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)).alias("value"),
        )
        for k, (shift, width) in enumerate(_blocks(radius))
    ]
    return prints.select("fp", F.explode(F.array(*values)).alias("b")).select("b.block", "b.value", "fp")


def dealt(rows: DataFrame, radius: int, tile_rows: int) -> DataFrame:
    """(block, value, one, other, side, fp): the rows of each comparison of two parts.

    Most buckets are one part, compared with itself. A large one is split by number
    of set bits and, within it, by hash; a row goes to every comparison its part is in.
    """
    bits = F.bit_count("fp")
    # One count per bucket and number of set bits, combined before the shuffle.
    sizes = rows.groupBy("block", "value", bits.alias("bits")).agg(F.count("*").alias("n"))
    large = (
        sizes.groupBy("block", "value")
        .agg(F.sum("n").alias("total"), F.collect_list(F.struct("bits", "n")).alias("sizes"))
        .where(F.col("total") > tile_rows)
        # parts[b] = number of parts of the fingerprints with b bits set
        .select(
            "block",
            "value",
            F.transform(
                F.sequence(F.lit(0), F.lit(BITS)),
                lambda b: F.aggregate(
                    "sizes",
                    F.lit(0),
                    lambda acc, s: F.when(
                        s["bits"] == b, F.ceil(s["n"] / F.lit(tile_rows)).cast("int")
                    ).otherwise(acc),
                ),
            ).alias("parts"),
        )
    )
    joined = rows.join(large, ["block", "value"], "left").withColumn("bits", bits)
    own = F.pmod(F.hash("fp"), F.get("parts", F.col("bits")))
    code = F.struct(F.col("bits").alias("bits"), own.alias("part"))
    others = F.flatten(
        F.transform(
            F.sequence(F.greatest(F.lit(0), F.col("bits") - radius), F.least(F.lit(BITS), F.col("bits") + radius)),
            lambda b: F.when(
                F.get("parts", b) > 0,
                F.transform(
                    F.sequence(F.lit(0), F.get("parts", b) - 1),
                    lambda p: F.struct(b.alias("bits"), p.cast("int").alias("part")),
                ),
            ).otherwise(F.array().cast("array<struct<bits:int,part:int>>")),
        )
    )
    alone = F.struct(F.lit(0).alias("bits"), F.lit(0).alias("part"))
    spread = joined.select(
        "block",
        "value",
        "fp",
        F.when(F.col("parts").isNull(), alone).otherwise(code).alias("mine"),
        F.explode(F.when(F.col("parts").isNull(), F.array(alone)).otherwise(others)).alias("their"),
    )
    return spread.select(
        "block",
        "value",
        F.least("mine", "their").alias("one"),
        F.greatest("mine", "their").alias("other"),
        F.when(F.col("mine") <= F.col("their"), 0).otherwise(1).alias("side"),
        "fp",
    )


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links within each comparison of a partition whose rows are sorted by comparison."""
    keys = ["block", "value", "a", "b", "c", "d"]
    held: list[np.ndarray] = []

    def links(rows: np.ndarray) -> Iterator[tuple[int, int]]:
        cuts = np.flatnonzero(np.any(rows[1:, :6] != rows[:-1, :6], axis=1)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)]):
            if end - start == 1:
                continue
            part = rows[start:end]
            sides = [part[part[:, 6] == k, 7].view(np.uint64) for k in (0, 1)]
            sides = [s[np.argsort(np.bitwise_count(s), kind="stable")] for s in sides]
            same = not len(sides[1])
            all_prints = np.concatenate(sides)
            forest = Forest(len(all_prints))
            shift = 0 if same else len(sides[0])
            for x, y in close_pairs(sides[0], sides[0] if same else sides[1], same, radius):
                forest.add(x, y + shift)
            for x, y in forest.links:
                yield int(all_prints[x].view(np.int64)), int(all_prints[y].view(np.int64))

    def out(found: Iterator[tuple[int, int]]) -> pa.RecordBatch:
        pairs = list(found)
        return pa.RecordBatch.from_arrays(
            [pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"]
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in [*keys, "side", "fp"]], axis=1)
        # The last comparison of a batch may go on in the next one.
        last = rows[-1, :6]
        first = len(rows) - int(np.argmax(np.any(rows[::-1, :6] != last, axis=1))) if np.any(rows[:, :6] != last) else 0
        if first or (held and np.any(held[-1][-1, :6] != last)):
            yield out(links(np.concatenate([*held, rows[:first]])))
            held = []
        held.append(rows[first:])
    if held:
        yield out(links(np.concatenate(held)))


def links(prints: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (u, v) that join fingerprints (fp, distinct) of at most ``radius`` differing bits into their groups."""
    spark = prints.sparkSession
    n = prints.count()
    rows = dealt(buckets(prints, radius), radius, tile_rows).select(
        F.col("block").cast("long").alias("block"),
        "value",
        *[F.col(f"{x}.{y}").cast("long").alias(z) for x, y, z in
          (("one", "bits", "a"), ("one", "part", "b"), ("other", "bits", "c"), ("other", "part", "d"))],
        F.col("side").cast("long").alias("side"),
        "fp",
    )
    keys = ["block", "value", "a", "b", "c", "d"]
    tasks = shuffle_tasks(spark, n * (radius + 1), BUCKET_ROWS)
    return (
        rows.repartition(tasks, *keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(lambda batches: _compare(batches, radius), "u long, v long")
    )


def groups(marked: DataFrame, workspace: Workspace, radius: int = RADIUS) -> DataFrame:
    """(fp, component, component_id) of the fingerprints in ``marked`` (doc_id, fp).

    component is a fingerprint that names the group; component_id is the smallest
    doc_id in it, NULL if it has none.
    """
    prints = workspace.keep(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "prints")
    found = components(links(prints.select("fp"), radius), workspace)
    joined = workspace.keep(
        prints.join(found, prints["fp"] == found["node"], "left").select(
            "fp", "least_id", F.coalesce("component", "fp").alias("component")
        ),
        "members",
    )
    least = joined.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return joined.select("fp", "component").join(least, "component").select("fp", "component", "component_id")


def clusters(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fingerprint (hex) and component_id.

    NULL and empty texts have the fingerprint 0 and are linked like any other. Rows
    that repeat stay repeated. A NULL doc_id is no candidate for a component_id. An
    empty table gives an empty table; other columns are left out.
    """
    workspace = Workspace(docs.sparkSession, "simhash")
    marked = workspace.keep(docs.select("doc_id", fingerprints("text").alias("fp")), "marked")
    named = workspace.keep(groups(marked, workspace, radius), "groups")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each group of near copies, with its columns: the row of the smallest doc_id.

    Of rows that share this doc_id and fingerprint one stays. A group without any
    doc_id keeps one row.
    """
    workspace = Workspace(docs.sparkSession, "simhash")
    marked = workspace.keep(docs.select("doc_id", fingerprints("text").alias("fp")), "marked")
    named = workspace.keep(groups(marked, workspace, radius), "groups")
    stay = workspace.keep(
        marked.join(named, "fp")
        .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("component")
        .agg(F.min("doc_id").alias("id"), F.min("fp").alias("fp"), F.count("*").alias("n")),
        "stay",
    )
    repeated = marked.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").limit(1).count()
    if not repeated:
        ids = stay.select(F.col("id").alias(fresh("id", docs.columns)))
        return docs.join(ids, docs["doc_id"] == ids[ids.columns[0]], "left_semi")
    # Some doc_id does not name one row: rows are told apart by their fingerprint as well.
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    row = row.withColumn("print", fingerprints("row.text"))
    found = row.join(stay, (row["print"] == stay["fp"]) & row["row.doc_id"].eqNullSafe(stay["id"]))
    alone = found.where("n = 1")
    several = found.where("n > 1").dropDuplicates(["component"])
    return alone.unionAll(several).select("row.*")
