"""Shards of near equal bytes over tables; equal texts stay together.

Groups of equal texts are dealt out by hash to parts of about PART_GROUPS groups; a
task differences each part into one partial partition (a sum per shard). Partial
partitions are then combined the same way, again in tasks while there are over
DRIVER_PARTS of them, and at last on the driver, which sees one sum per part and shard,
never a group.

Parts that are even cannot make up for a group larger than a part's share of a shard. Such
groups, of which there are at most parts times shards, are placed first, in the same way. So
many of the parts are then held back as weigh twice what the lighter shards lack; they begin
with what the shards hold already, and their groups fill up the lighter ones. The last of them is
placed when all else is, and makes up for what small differences have added up to.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablecraft.llm.common import Workspace
from tablecraft.llm.shard import difference

PART_GROUPS = 2000
DRIVER_PARTS = 1000
ROW_OVERHEAD = 16
#: Rows of a shard that one task numbers; shards are cut into so many cells, at least MIN_CELLS.
CELL_ROWS = 50_000
MIN_CELLS = 64


def _differenced(shards: int):
    """(part, place, bytes) of one part and its entries' places to (place, slot); groups are single entries."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bytes", "key"], ascending=[False, True], kind="stable")
        slots = difference([[size] for size in rows["bytes"].tolist()], shards)
        return rows.assign(slot=[s[0] for s in slots])[["key", "bytes", "part", "slot"]]

    return run


def _combined(shards: int):
    """Rows (part, slot, bytes, next_part) of one next part to the same with next_slot."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["part", "slot"])
        parts = [list(g) for _, g in rows.groupby("part", sort=False)["bytes"]]
        flat = [slot for part in difference(parts, shards) for slot in part]
        return rows.assign(next_slot=flat)

    return run


def _filled(shards: int, loads: list[int], parts: int):
    """(key, bytes, shard) of the groups of one part, beside its share of the ``loads`` of the shards."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        begun = [load // parts + (part < load % parts) for load in loads]
        rows = rows.sort_values(["bytes", "key"], ascending=[False, True], kind="stable")
        slots = difference([begun, *([size] for size in rows["bytes"].tolist())], shards)
        shard_at = {slot: shard for shard, slot in enumerate(slots[0])}
        return rows.assign(shard=[shard_at[s[0]] for s in slots[1:]])[["key", "bytes", "shard"]]

    return run


def placed(
    groups: DataFrame, shards: int, workspace: Workspace, part_groups: int, driver_parts: int, depth: int = 0
) -> DataFrame:
    """(key, shard) of groups (key, bytes)."""
    size = groups.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    parts = max(1, -(-size["n"] // part_groups))
    large = groups.where(F.col("bytes") > (size["bytes"] or 0) / (parts * shards))
    n_large = large.count() if parts > 1 else 0
    # Parts of few groups beside the number of shards have no groups that are small.
    if not 0 < 2 * n_large <= size["n"]:
        return _combined_parts(groups, parts, shards, workspace, driver_parts, depth)
    large = workspace.keep(large, f"large-{depth}")
    first = workspace.keep(placed(large, shards, workspace, part_groups, driver_parts, depth + 1), f"first-{depth}")
    first = large.join(first, "key").select("key", "bytes", "shard")
    parts = max(1, -(-(size["n"] - n_large) // part_groups))
    rest = groups.join(first, "key", "left_anti").withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))

    def weights(found: DataFrame) -> list[int]:
        sums = {r["shard"]: r["bytes"] for r in found.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
        return [sums.get(k, 0) for k in range(shards)]

    def filled(rows: DataFrame, others: DataFrame, parts: int, name: str) -> DataFrame:
        run = _filled(shards, weights(others), parts)
        found = rows.groupBy("part").applyInPandas(run, "key binary, bytes long, shard int")
        return workspace.keep(found, f"{name}-{depth}")

    loads = weights(first)
    left = size["bytes"] - sum(loads)
    lacking = sum(max(loads) - load for load in loads)
    held = max(1, min(parts, -(-2 * lacking * parts // max(left, 1))))
    if held < parts:
        free = workspace.keep(rest.where(F.col("part") >= held).select("key", "bytes"), f"free-{depth}")
        even = _combined_parts(free, parts - held, shards, workspace, driver_parts, depth)
        first = first.unionAll(workspace.keep(free.join(even, "key").select("key", "bytes", "shard"), f"even-{depth}"))
    if held > 1:
        first = first.unionAll(filled(rest.where((F.col("part") > 0) & (F.col("part") < held)), first, held, "held"))
    return first.unionAll(filled(rest.where("part = 0"), first, 1, "last")).select("key", "shard")


def _combined_parts(
    groups: DataFrame, parts: int, shards: int, workspace: Workspace, driver_parts: int, depth: int
) -> DataFrame:
    """(key, shard) of groups of which none outweighs the others of its part."""
    spark = groups.sparkSession
    now = workspace.keep(
        groups.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
        .groupBy("part")
        .applyInPandas(_differenced(shards), "key binary, bytes long, part long, slot int"),
        f"parts-{depth}",
    )
    sums = now.groupBy("part", "slot").agg(F.sum("bytes").alias("bytes"))
    now, level = now.select("key", "part", "slot"), 0
    while parts > driver_parts:
        level, parts = level + 1, -(-parts // driver_parts)
        steps = workspace.keep(
            sums.withColumn("next_part", F.pmod(F.xxhash64("part", F.lit(level)), F.lit(parts)))
            .groupBy("next_part")
            .applyInPandas(_combined(shards), "part long, slot int, bytes long, next_part long, next_slot int"),
            f"steps-{depth}-{level}",
        )
        now = now.join(steps.drop("bytes"), ["part", "slot"]).select(
            "key", F.col("next_part").alias("part"), F.col("next_slot").alias("slot")
        )
        sums = steps.groupBy(F.col("next_part").alias("part"), F.col("next_slot").alias("slot")).agg(
            F.sum("bytes").alias("bytes")
        )
    # At most driver_parts times shards rows.
    last = sums.toPandas().assign(next_part=0)
    last = _combined(shards)(last) if len(last) else last.assign(next_slot=0)
    shard = spark.createDataFrame(
        list(zip(*(last[c].tolist() for c in ("part", "slot", "next_slot")))),
        "part long, slot int, shard int",
    )
    return now.join(F.broadcast(shard), ["part", "slot"]).select("key", "shard")


def by_bytes(
    docs: DataFrame, shards: int = 40, part_groups: int = PART_GROUPS, driver_parts: int = DRIVER_PARTS
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its size, checksum, shard and place in the shard.

    NULL has no bytes and the checksum of no bytes; all NULL texts are one group. Rows
    that repeat each get a place of their own. A shard may stay empty if there are
    fewer groups than shards. An empty table gives an empty table; other columns are
    left out. Equal texts are told by SHA-256.
    """
    workspace = Workspace(docs.sparkSession, "shards")
    rows = workspace.keep(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
            F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b"")).alias("key"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "rows",
    )
    groups = workspace.keep(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")
    found = workspace.keep(placed(groups, shards, workspace, part_groups, driver_parts), "placed")
    cells = max(MIN_CELLS, -(-rows.count() // (shards * CELL_ROWS)))
    assigned = workspace.keep(
        rows.join(found, "key").select(
            "doc_id", "size", "text_crc32", "shard", "row",
            F.pmod(F.xxhash64("row"), F.lit(cells)).cast("int").alias("cell"),
        ),
        "assigned",
    )
    before = assigned.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = before.select(
        "shard", "cell",
        (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before"),
    )
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "row")) - 1
    numbered = assigned.withColumn("within", within).join(before, ["shard", "cell"])
    return numbered.select(
        "doc_id", "size", "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("within")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
