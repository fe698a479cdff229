"""Connected components of a table of links, by alternating large and small stars.

Every round is two aggregations and joins over the links; the links of a round are
written to the shared folder, so that lineage stays short and lost executors cost one
round. Minima are combined before the shuffle, and a join leaves it to Spark to split
a node with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.llm.common import Workspace


def _fingerprint(links: DataFrame) -> tuple[int, int | None]:
    row = links.select(
        F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")
    ).first()
    return row["n"], row["x"]


def components(links: DataFrame, workspace: Workspace) -> DataFrame:
    """(node, component) of all nodes of ``links`` (u, v), component being the smallest node reachable.

    Nodes are any ordered type. Links from a node to itself and repeated links are allowed.
    An empty table gives an empty table.
    """
    now = workspace.keep(
        links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(),
        "links-0",
    )
    before, step = None, 0
    state = _fingerprint(now)
    while state != before and state[0]:
        # Large star: every larger neighbour of a node is linked to the node's smallest neighbour.
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        large = workspace.keep(large, f"large-{step}")
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(least, "v")
        small = (
            joined.select(F.col("m").alias("a"), F.col("u").alias("b"))
            .unionAll(least.select(F.col("m").alias("a"), F.col("v").alias("b")))
            .where("a < b")
            .select(F.col("a").alias("u"), F.col("b").alias("v"))
            .distinct()
        )
        step += 1
        now = workspace.keep(small, f"links-{step}")
        before, state = state, _fingerprint(now)
        workspace.drop(f"large-{step - 1}")
        workspace.drop(f"links-{step - 1}")
    members = now.groupBy("v").agg(F.min("u").alias("component")).select(F.col("v").alias("node"), "component")
    roots = now.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return members.unionAll(roots)
