"""Random forests of two classes on counted rows.

Trees see a row by the bins of its features and its label only, so rows alike in them are one row
with a number. A tree draws each row as often as a Poisson number says; of n rows alike the draws
add up to a Poisson number of n times the mean, so drawing for all of them at once is the same.
Splits, stops and pruning are those of Spark's forest.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator, Sequence
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, StorageLevel, TaskContext, cloudpickle
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block at least and at most; between them a table has MOST_BLOCKS of them.
BLOCK_ROWS, LARGE_BLOCK_ROWS, MOST_BLOCKS = 25_000, 1_000_000, 400
#: Counts that a block sends at once, and nodes whose counts are added up by one task.
COUNTS_AT_ONCE, PIECE = 4_000_000, 64
EPSILON = 2.0**-52
BLOCK = "block long, cells binary"
COUNTS = "tree int, piece int, counts binary"
SPLITS = "tree int, node int, feature int, gain double, lefts array<int>, counts array<double>"

# Fitting asks for nothing of this library where tasks run.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Feature(NamedTuple):
    """A column of whole numbers from 0, how many there may be, and whether they are categories."""

    column: Column
    bins: int | None
    nominal: bool


class Tree:
    """Nodes in the order they were made; children follow each other, after their parent."""

    def __init__(self) -> None:
        self.feature, self.left, self.lefts = [-1], [-1], [()]
        self.counts, self.gain = [None], [0.0]

    def split(self, node: int, feature: int, gain: float, lefts: Sequence[int], counts: Sequence[float]) -> int:
        """Give a node two children; returns the left one."""
        first = len(self.feature)
        self.feature[node], self.left[node], self.lefts[node], self.gain[node] = feature, first, tuple(lefts), gain
        self.feature += [-1, -1]
        self.left += [-1, -1]
        self.lefts += [(), ()]
        self.gain += [0.0, 0.0]
        self.counts += [tuple(counts[:2]), tuple(counts[2:])]
        return first

    def pruned(self) -> list[bool]:
        """Which nodes are leaves once leaves of one prediction are one."""
        leaf = [f < 0 for f in self.feature]
        for node in range(len(leaf) - 1, -1, -1):
            a = self.left[node]
            if a >= 0 and leaf[a] and leaf[a + 1] and _said(self.counts[a]) == _said(self.counts[a + 1]):
                leaf[node] = True
        return leaf


def _said(counts: Sequence[float]) -> float:
    return float(counts[1] > counts[0])


def gini(counts: np.ndarray) -> np.ndarray:
    """Impurity of counts whose last axis has the two classes, 0 of none."""
    total = counts.sum(axis=-1)
    shares = counts / np.maximum(total, 1)[..., None]
    return np.where(total > 0, 1.0 - shares[..., 0] ** 2 - shares[..., 1] ** 2, 0.0)


def fit(data: DataFrame, features: Sequence[Feature], learner: RandomForestClassifier) -> RandomForestClassificationModel:
    """Grow the forest of ``learner`` on rows with ``label`` 0 or 1, level by level over all trees.

    ``features`` say, in vector order, which number of a row the model will find in its vector.
    """
    names = [f"f{i}" for i in range(len(features))]
    numbers = [f.column.cast("int").alias(name) for name, f in zip(names, features)]
    alike = data.select(*numbers, F.col("label").cast("int").alias("label")).na.drop()
    counted = alike.groupBy(*names, "label").agg(F.count("*").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    blocks = None
    try:
        size, *tops = counted.agg(F.count("*"), *(F.max(name) for name in names)).first()
        bins = [f.bins or top + 1 for f, top in zip(features, tops)]
        parts = max(-(-size // LARGE_BLOCK_ROWS), min(MOST_BLOCKS, -(-size // BLOCK_ROWS)))
        # The rows of a part follow from their values, so a lost one is drawn again alike.
        blocks = counted.repartition(parts, *names, "label").mapInArrow(_packed, BLOCK)
        blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
        blocks.count()
        counted.unpersist()
        trees = _grown(blocks, bins, [f.nominal for f in features], learner)
    finally:
        counted.unpersist()
        if blocks is not None:
            blocks.unpersist()
    return _model(trees, bins, [f.nominal for f in features], learner)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task as one array, a line per column, in an order that follows from them."""
    found = [batch for batch in batches if batch.num_rows]
    if found:
        cells = np.stack([column.to_numpy().astype("int64") for column in pa.Table.from_batches(found).columns])
        cells = cells[:, np.lexsort(cells)]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([task], pa.int64()), pa.array([cells.tobytes()], pa.binary())], names=["block", "cells"]
        )


def _grown(blocks: DataFrame, bins: Sequence[int], nominal: Sequence[bool], learner: RandomForestClassifier) -> list[Tree]:
    get = learner.getOrDefault
    seed, depth = get("seed"), get("maxDepth")
    trees = [Tree() for _ in range(get("numTrees"))]
    n_tried = len(bins) if len(trees) == 1 else int(np.ceil(np.sqrt(len(bins))))
    rule = (get("minInstancesPerNode"), get("minInfoGain"))
    at_once = max(PIECE, COUNTS_AT_ONCE // (n_tried * max(bins) * 2))
    level = [(tree, 0) for tree in range(len(trees))]
    for below in range(depth, -1, -1):
        # Nodes of all trees in turn, so that no tree has most of a job.
        level.sort(key=lambda found: (found[1], found[0]))
        following = []
        for start in range(0, len(level), at_once):
            asked: dict[int, list[int]] = {}
            for tree, node in level[start : start + at_once]:
                asked.setdefault(tree, []).append(node)
            tried = {
                tree: np.array([_tried(seed, tree, node, len(bins), n_tried) for node in nodes])
                for tree, nodes in asked.items()
            }
            state = {tree: _state(trees[tree], nodes, tried[tree], max(bins)) for tree, nodes in asked.items()}
            counts = blocks.mapInArrow(_counter(state, len(bins), max(bins), seed, get("subsamplingRate")), COUNTS)
            found = counts.groupBy("tree", "piece").applyInArrow(_chooser(tried, bins, nominal, rule), SPLITS)
            for row in found.collect():
                tree, node = trees[row["tree"]], asked[row["tree"]][row["node"]]
                sides = np.array(row["counts"]).reshape(2, 2)
                tree.counts[node] = tuple(sides.sum(axis=0).tolist())
                if row["feature"] < 0 or row["gain"] <= 0 or not below:
                    continue
                first = tree.split(node, row["feature"], row["gain"], row["lefts"], sides.ravel().tolist())
                if below > 1:
                    pure = gini(sides) < EPSILON
                    following += [(row["tree"], first + i) for i in (0, 1) if not pure[i]]
        level = following
        if not level:
            break
    return trees


def _tried(seed: int, tree: int, node: int, n_features: int, n_tried: int) -> np.ndarray:
    """The features a node may be split by."""
    if n_tried == n_features:
        return np.arange(n_features)
    draw = np.random.default_rng([seed % 2**64, tree, node])
    return np.sort(draw.choice(n_features, n_tried, replace=False))


def _state(tree: Tree, asked: Sequence[int], tried: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """What a block needs of a tree: the way down, and which counts the asked nodes want."""
    slot = np.full(len(tree.feature), -1)
    slot[np.array(asked)] = np.arange(len(asked))
    lefts = np.zeros((len(tree.feature), width), dtype=bool)
    for node, found in enumerate(tree.lefts):
        lefts[node, list(found)] = True
    return np.array(tree.feature), np.array(tree.left), lefts, slot, tried


def _counter(state: dict[int, tuple], n_features: int, width: int, seed: int, rate: float):
    """Counts by node, feature tried, bin and class of the rows that each tree draws from a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("cells")):
                cells = np.frombuffer(data.as_buffer(), dtype="int64").reshape(n_features + 2, -1)
                out = [found for tree, part in state.items() for found in of_tree(tree, part, block, cells)]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))]
                if out:
                    yield pa.RecordBatch.from_arrays(columns, names=["tree", "piece", "counts"])

    def of_tree(tree: int, part: tuple, block: int, cells: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        feature, left, lefts, slot, tried = part
        label, number = cells[n_features], cells[n_features + 1]
        drawn = np.random.default_rng([seed % 2**64, tree, block]).poisson(rate * number)
        rows = np.flatnonzero(drawn)
        node = np.zeros(len(rows), dtype="int64")
        there, wanted = [], []
        while len(rows):
            here = slot[node] >= 0
            there.append(rows[here])
            wanted.append(slot[node[here]])
            on = feature[node] >= 0
            rows, node = rows[on], node[on]
            node = left[node] + ~lefts[node, cells[feature[node], rows]]
        rows, slots = np.concatenate(there or [rows]), np.concatenate(wanted or [rows])
        counts = np.zeros((*tried.shape, width, 2))
        weights, classes = drawn[rows].astype("float64"), label[rows]
        for j in range(tried.shape[1]):
            place = (slots * width + cells[tried[slots, j], rows]) * 2 + classes
            of_all = np.bincount(place, weights=weights, minlength=len(tried) * width * 2)
            counts[:, j] = of_all.reshape(len(tried), width, 2)
        for piece, start in enumerate(range(0, len(tried), PIECE)):
            yield tree, piece, counts[start : start + PIECE].tobytes()

    return run


def _chooser(tried: dict[int, np.ndarray], bins: Sequence[int], nominal: Sequence[bool], rule: tuple[int, float]):
    """The best split of each node from the counts of all blocks."""

    def run(key: tuple[Any, ...], table: pa.Table) -> pa.Table:
        tree, piece = (part.as_py() for part in key)
        features = tried[tree][piece * PIECE : (piece + 1) * PIECE]
        counts = 0.0
        for data in table.column("counts"):
            counts = counts + np.frombuffer(data.as_buffer(), dtype="float64")
        counts = counts.reshape(*features.shape, max(bins), 2)
        found = [best_split(counts[i], features[i], bins, nominal, rule) for i in range(len(features))]
        columns = [[tree] * len(found), [piece * PIECE + i for i in range(len(found))], *zip(*found)]
        kinds = [pa.int32()] * 3 + [pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64())]
        names = ["tree", "node", "feature", "gain", "lefts", "counts"]
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)

    return run


def best_split(
    counts: np.ndarray, features: Sequence[int], bins: Sequence[int], nominal: Sequence[bool], rule: tuple[int, float]
) -> tuple[int, float, list[int], list[float]]:
    """Feature (-1: none), gain, bins that go left, and counts left and right.

    Categories are put in order by their rows of class 1, those without rows last, as Spark does.
    """
    min_rows, min_gain = rule
    total = counts[0].sum(axis=0)
    best: tuple[int, float, list[int], list[float]] = (-1, 0.0, [], [*total.tolist(), 0.0, 0.0])
    for feature, found in zip(features, counts):
        n = bins[feature]
        if n < 2:
            continue
        order = np.arange(n)
        if nominal[feature]:
            order = np.argsort(np.where(found[:n].sum(axis=1) > 0, found[:n, 1], np.inf), kind="stable")
        left = np.cumsum(found[order], axis=0)[:-1]
        right = total - left
        sizes = left.sum(axis=1), right.sum(axis=1)
        shares = [size / max(total.sum(), 1.0) for size in sizes]
        gain = gini(total) - shares[0] * gini(left) - shares[1] * gini(right)
        allowed = (sizes[0] >= min_rows) & (sizes[1] >= min_rows) & (gain >= min_gain)
        at = int(np.argmax(np.where(allowed, gain, -np.inf)))
        if allowed[at] and (best[0] < 0 or gain[at] > best[1]):
            lefts = order[: at + 1].tolist()
            best = (int(feature), float(gain[at]), lefts, [*left[at].tolist(), *right[at].tolist()])
    return best


def _model(
    trees: Sequence[Tree], bins: Sequence[int], nominal: Sequence[bool], learner: RandomForestClassifier
) -> RandomForestClassificationModel:
    """The trees as Spark's model; Python has no way to make one of given nodes, so the JVM's is used."""
    context = SparkContext._active_spark_context
    jvm = context._jvm
    # Names are looked up in the JVM each time, so once here.
    made, classes = jvm.org.apache.spark.ml.tree, jvm.org.apache.spark.ml.classification
    leaf_node, inner_node, one_tree = made.LeafNode, made.InternalNode, classes.DecisionTreeClassificationModel
    categories_in, up_to = made.CategoricalSplit, made.ContinuousSplit
    calculator, cut = jvm.org.apache.spark.mllib.tree.impurity.GiniCalculator, jvm.java.util.Arrays.copyOfRange
    array = context._gateway.new_array(one_tree, len(trees))
    for i, tree in enumerate(trees):
        leaf = tree.pruned()
        counts = np.array(tree.counts, dtype="float64")
        impurity = gini(counts).tolist()
        numbers = _py2java(context, Vectors.dense(counts.ravel())).toArray()
        lefts = _py2java(context, Vectors.dense([float(v) for found in tree.lefts for v in found])).toArray()
        ends = np.cumsum([len(found) for found in tree.lefts]).tolist()
        nodes: dict[int, Any] = {}
        used = _reached(tree, leaf)
        for node in reversed(used):
            stats = calculator(cut(numbers, 2 * node, 2 * node + 2), int(counts[node].sum()))
            said, feature, first = _said(tree.counts[node]), tree.feature[node], tree.left[node]
            if leaf[node]:
                nodes[node] = leaf_node(said, impurity[node], stats)
                continue
            if nominal[feature]:
                categories = cut(lefts, ends[node] - len(tree.lefts[node]), ends[node])
                split = categories_in(feature, categories, bins[feature])
            else:
                split = up_to(feature, max(tree.lefts[node]) + 0.5)
            children = nodes.pop(first), nodes.pop(first + 1)
            nodes[node] = inner_node(said, impurity[node], tree.gain[node], *children, split, stats)
        array[i] = one_tree(f"dtc_{uuid.uuid4().hex[:12]}", nodes[0], len(bins), 2)
    java = classes.RandomForestClassificationModel(f"{learner.uid}_model", array, len(bins), 2)
    model = learner._copyValues(RandomForestClassificationModel(java))
    # The JVM's model tells the number of trees by its parameter.
    model._transfer_params_to_java()
    return model


def _reached(tree: Tree, leaf: Sequence[bool]) -> list[int]:
    """Nodes that are left after pruning, parents first."""
    used = [0]
    for node in used:
        if not leaf[node]:
            used += [tree.left[node], tree.left[node] + 1]
    return used
