"""Moments of all pairs of columns over the rows where both have a value, as matrix products.

For a batch of rows with values X (0 where missing) and marks M (1 where present), the
products M'M, X'M, (X*X)'M and X'X hold the numbers, sums, squares and cross products of
all pairs. Values are taken about the batch's column means, and batches are merged by
their means and deviations, so that large values far from zero lose nothing.

What can be lost is a pair whose complete rows lie far from the means of their columns,
seen from their own spread. How much was subtracted is kept beside every moment, and
such pairs are found exactly by a second scan, about the means of their own rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A pair is looked at again if its squares about the mean are this share of what they were taken from, or less.
KEPT_SHARE = 1e-6
#: Rows whose products are formed at once.
BATCH_ROWS = 4096

#: Per pair (a, b): complete rows; mean of a and of b, squares of a, cross products, squares before
#: the mean was subtracted, complete rows with an infinite value.
_PARTS = ("n", "own", "other", "squares", "cross", "raw", "infinite")
_FIELDS = ", ".join(f"{p} array<double>" for p in _PARTS)


@dataclass
class Pairs:
    """Moments by pair of columns, as square matrices in the order of the columns."""

    n: np.ndarray
    own: np.ndarray
    other: np.ndarray
    squares: np.ndarray
    cross: np.ndarray
    raw: np.ndarray
    infinite: np.ndarray

    def add(self, more: Pairs) -> None:
        """Merge the moments of other rows."""
        n = self.n + more.n
        share = np.divide(more.n, n, out=np.zeros_like(n), where=n > 0)
        own, other = more.own - self.own, more.other - self.other
        weight = self.n * share
        self.squares += more.squares + own * own * weight
        self.cross += more.cross + own * other * weight
        self.own += own * share
        self.other += other * share
        self.raw += more.raw
        self.infinite += more.infinite
        self.n = n

    def rows(self) -> Iterator[list[np.ndarray]]:
        for k in range(len(self.n)):
            yield [getattr(self, p)[k] for p in _PARTS]


def _of_batch(values: np.ndarray) -> Pairs:
    """Moments of some rows; missing values are NaN."""
    here = ~np.isnan(values)
    finite = np.isfinite(values)
    marks = here.astype(np.float64)
    counts = finite.sum(0)
    held = np.where(finite, values, 0.0)
    # Means by shares, which large values do not overflow.
    centers = (held / np.maximum(counts, 1)).sum(0)
    about = np.where(finite, values - centers, 0.0)
    if finite.all():
        n = np.full((values.shape[1],) * 2, float(len(values)))
        sums = np.repeat(about.sum(0)[:, None], values.shape[1], 1)
        raw = np.repeat((about * about).sum(0)[:, None], values.shape[1], 1)
        infinite = np.zeros_like(n)
    else:
        n, sums, raw = marks.T @ marks, about.T @ marks, (about * about).T @ marks
        infinite = (here & ~finite).astype(np.float64).T @ marks
    rows = np.maximum(n, 1)
    mean = sums / rows
    return Pairs(
        n, np.where(n > 0, mean + centers[:, None], 0.0), np.where(n > 0, mean.T + centers, 0.0),
        np.maximum(raw - sums * mean, 0.0), about.T @ about - sums * mean.T, raw, infinite,
    )


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Columns side by side as doubles, NaN for NULL."""
    out = np.empty((batch.num_rows, batch.num_columns))
    for k in range(batch.num_columns):
        column = batch.column(k)
        out[:, k] = column.to_numpy(zero_copy_only=False)
        if column.null_count:
            out[column.is_null().to_numpy(zero_copy_only=False), k] = np.nan
    return out


def _values(df: DataFrame, values: Mapping[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{text} AS c{k}" for k, text in enumerate(values.values())])


def of_all_pairs(df: DataFrame, values: Mapping[str, str]) -> tuple[Pairs, np.ndarray]:
    """Moments of all pairs, and whether a column is constant, in one scan.

    ``values`` maps names to SQL text of doubles with NULL for missing. A task gives one
    row per column; what reaches the driver is as large as the matrix of the result.
    """
    k = len(values)
    schema = f"a int, {_FIELDS}, least double, most double"
    names = ["a", *_PARTS, "least", "most"]

    def out(pairs: Pairs, places: list[int], least: list[float], most: list[float]) -> pa.RecordBatch:
        lists = list(zip(*pairs.rows()))
        return pa.RecordBatch.from_arrays(
            [pa.array(places, pa.int32()), *[pa.array(list(p), pa.list_(pa.float64())) for p in lists],
             pa.array(least, pa.float64()), pa.array(most, pa.float64())], names=names)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, least, most = None, np.full(k, np.inf), np.full(k, -np.inf)
        for batch in batches:
            whole = _matrix(batch)
            for at in range(0, len(whole), BATCH_ROWS):
                rows = whole[at : at + BATCH_ROWS]
                least, most = np.fmin(least, np.fmin.reduce(rows, 0)), np.fmax(most, np.fmax.reduce(rows, 0))
                found = _of_batch(rows)
                if total is None:
                    total = found
                else:
                    total.add(found)
        if total is not None:
            yield out(total, list(range(k)), least.tolist(), most.tolist())

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, place, least, most = None, None, np.inf, -np.inf
        for batch in batches:
            for row in batch.to_pylist():
                part = Pairs(*[np.array([row[p]], np.float64) for p in _PARTS])
                if row["a"] != place:
                    if total is not None:
                        yield out(total, [place], [least], [most])
                    total, place, least, most = part, row["a"], row["least"], row["most"]
                else:
                    total.add(part)
                    least, most = min(least, row["least"]), max(most, row["most"])
        if total is not None:
            yield out(total, [place], [least], [most])

    tasks = max(1, min(k, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    found = (
        _values(df, values).mapInArrow(counted, schema)
        .repartition(tasks, "a").sortWithinPartitions("a").mapInArrow(merged, schema).collect()
    )
    if not found:
        return Pairs(*[np.zeros((k, k)) for _ in _PARTS]), np.ones(k, bool)
    found.sort(key=lambda row: row["a"])
    pairs = Pairs(*[np.array([row[p] for row in found]) for p in _PARTS])
    return pairs, np.array([not row["least"] < row["most"] for row in found])


def _again(df: DataFrame, values: Mapping[str, str], pairs: Pairs, places: list[tuple[int, int]]) -> dict:
    """(n, squares of a, squares of b, cross, whether both vary) of some pairs, about their own means."""
    shared = df.sparkSession.sparkContext.broadcast((places, pairs.own, pairs.other))
    sums = ("x", "y", "xx", "yy", "xy")
    ends = ("xa", "xb", "ya", "yb")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, own, other = shared.value
        total = np.zeros((len(wanted), 5))
        edge = np.tile([np.inf, -np.inf, np.inf, -np.inf], (len(wanted), 1))
        for batch in batches:
            rows = _matrix(batch)
            here = ~np.isnan(rows)
            for k, (a, b) in enumerate(wanted):
                both = here[:, a] & here[:, b]
                if both.any():
                    p, q = rows[both, a], rows[both, b]
                    x, y = p - own[a, b], q - other[a, b]
                    total[k] += x.sum(), y.sum(), x @ x, y @ y, x @ y
                    edge[k] = (min(edge[k, 0], p.min()), max(edge[k, 1], p.max()),
                               min(edge[k, 2], q.min()), max(edge[k, 3], q.max()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(wanted)), pa.int32()), *[pa.array(c) for c in (*total.T, *edge.T)]],
            names=["k", *sums, *ends],
        )

    schema = "k int, " + ", ".join(f"{c} double" for c in (*sums, *ends))
    found = (
        _values(df, values).mapInArrow(counted, schema).groupBy("k")
        .agg(*[F.sum(c).alias(c) for c in sums], *[(F.min if c[1] == "a" else F.max)(c).alias(c) for c in ends])
    )
    out = {}
    for r in found.collect():
        a, b = places[r["k"]]
        n = max(pairs.n[a, b], 1)
        out[a, b] = (
            max(r["xx"] - r["x"] ** 2 / n, 0.0), max(r["yy"] - r["y"] ** 2 / n, 0.0), r["xy"] - r["x"] * r["y"] / n,
            r["xa"] < r["xb"] and r["ya"] < r["yb"],
        )
    return out


def correlations(df: DataFrame, values: Mapping[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """(n, correlation) of all pairs, in one scan, or two where rows of a pair lie apart.

    NaN stands for a pair that holds an infinite value, None for one without variation.
    """
    pairs, constant = of_all_pairs(df, values)
    k = len(values)
    scale = np.sqrt(pairs.squares) * np.sqrt(pairs.squares.T)
    corr = np.clip(np.divide(pairs.cross, scale, out=np.zeros((k, k)), where=scale > 0), -1.0, 1.0).astype(object)
    np.fill_diagonal(corr, 1.0)
    infinite = (pairs.infinite + pairs.infinite.T) > 0
    still = constant[:, None] | constant | (pairs.n < 2)
    doubtful = pairs.squares <= KEPT_SHARE * pairs.raw
    open_pairs = np.argwhere(np.triu((doubtful | doubtful.T) & ~still & ~infinite)).tolist()
    if open_pairs:
        places = [tuple(p) for p in open_pairs]
        for (a, b), (xx, yy, xy, varies) in _again(df, values, pairs, places).items():
            found = float(np.clip(xy / (np.sqrt(xx) * np.sqrt(yy)), -1.0, 1.0)) if varies and xx > 0 and yy > 0 else None
            corr[a, b] = corr[b, a] = 1.0 if found is not None and a == b else found
    corr[infinite] = float("nan")
    corr[still & ~infinite] = None
    return pairs.n.astype(np.int64), corr
