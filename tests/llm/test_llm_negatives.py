import itertools
import math

import numpy as np
import pytest

import edges
from tablecraft.llm import hilbert, negatives_tables
from tablecraft.llm.common import Workspace

SCHEMA = "vec_id long, embedding array<float>, label int, query long, block long, v string, score double, rank int"


def brute(rows):
    whole = []
    for ident, vector, label in rows:
        if label is None or not vector or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if ident is not None and ident % 7 == 0:
            label = (label + 1) % 10
        whole.append((ident, [math.floor(256 * x) for x in vector], label))

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    def order(pair):
        return -pair[0], pair[1] is None, pair[1] or 0

    out, seen = [], set()
    for at, (ident, vector, label) in enumerate(whole):
        if ident is None or ident % 50 or (ident, tuple(vector), label) in seen:
            continue
        seen.add((ident, tuple(vector), label))
        near = sorted(((score(vector, v), k) for j, (k, v, m) in enumerate(whole) if j != at and m == label), key=order)[:5]
        far = sorted(((score(vector, v), k) for k, v, m in whole if m != label), key=order)
        for p, positive in near:
            fits = [(n, k) for n, k in far if 50 * p <= 100 * n <= 95 * p][:3]
            out += [(ident, positive, rank, k, p, n) for rank, (n, k) in enumerate(fits, 1)]
    return edges.in_order(out)


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(6, 20))
    rows = []
    for k in range(1500):
        v = (centers[rng.integers(6)] + rng.normal(size=20) * 0.4) / 4
        rows.append((k, [float(x) for x in v.astype(np.float32)], int(rng.integers(10))))
    common = rows[50][1]
    # A very common vector, repeated rows, ties, odd vectors and NULLs.
    rows += [(2000 + k, common, k % 3) for k in range(700)]
    rows += [rows[100], rows[100], rows[30], rows[30], (None, common, 4), (None, None, None), (3001, None, 2), (3050, [], 2),
             (3100, [None] * 20, 2), (3150, [float("nan")] * 20, 1), (3200, [float("inf")] * 20, 1), (3250, [0.0] * 20, 1),
             (3300, common, None), (3350, [0.5, -0.5], 3), (-50, [0.25] * 20, 3), (3400, [1.0] * 20, 11)]
    return [(*r, 1, 2, "v", None, 3) for r in rows]


def test_same_as_all_pairs(spark, odd, monkeypatch):
    frame = spark.createDataFrame(odd, SCHEMA)
    want = brute([r[:3] for r in frame.collect()])
    assert edges.in_order(negatives_tables.mine(frame).collect()) == want and len(want) > 100
    # Small blocks and batches of anchors.
    monkeypatch.setattr(negatives_tables, "BLOCK_ROWS", 16)
    monkeypatch.setattr(negatives_tables, "BATCH", 20)
    assert edges.in_order(negatives_tables.mine(frame).collect()) == want


def test_no_rows(spark, odd):
    frame = spark.createDataFrame(odd, SCHEMA)
    assert negatives_tables.mine(frame.limit(0)).collect() == []
    assert negatives_tables.mine(frame.where("vec_id % 50 <> 0")).collect() == []


def test_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (5, 2), (16, 1)):
        side = range(2**bits)
        cells = np.array(list(itertools.product(side, repeat=dims)) if dims < 16 else
                         np.random.default_rng(0).integers(0, 2, (500, 16)), np.uint64)
        place = hilbert.places(cells, bits)
        if dims < 16:
            assert sorted(place.tolist()) == list(range(len(cells)))
            along = cells[np.argsort(place)].astype(int)
            assert (np.abs(np.diff(along, axis=0)).sum(1) == 1).all()


def test_bounds_hold():
    rng = np.random.default_rng(1)
    anchors, vectors = rng.integers(-300, 300, (30, 12)), rng.integers(-300, 300, (200, 12))
    boxes = vectors.reshape(10, 20, 12)
    lower, upper = hilbert.bounds(anchors, boxes.min(1), boxes.max(1))
    found = (anchors @ vectors.T).reshape(30, 10, 20)
    assert (lower <= found.min(2)).all() and (found.max(2) <= upper).all()
    # Beyond doubles, still in whole numbers.
    large = np.array([[2**30 + 1, 3]])
    assert hilbert.scores(large, large).tolist() == [[(2**30 + 1) ** 2 + 9]]
    with pytest.raises(OverflowError):
        hilbert.scores(large * 8, large)


def test_blocks_left_out(spark, monkeypatch):
    """On data with clusters the zone maps leave out most blocks."""
    monkeypatch.setattr(negatives_tables, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 8)) * 2
    rows = [(k, [float(x) for x in centers[k % 40] + rng.normal(size=8) * 0.02], k % 10) for k in range(8000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    workspace = Workspace(spark, "test")
    whole = workspace.keep(negatives_tables.whole(frame), "rows")
    table, dims = negatives_tables.blocks(whole, workspace)
    zones = table.select("least", "most").collect()
    least, most = (np.array([z[k] for z in zones]) for k in (0, 1))
    anchors = np.array([r["v"] for r in whole.where("vec_id % 50 = 0").collect()])
    own = (anchors * anchors).sum(1)
    lower, upper = hilbert.bounds(anchors, least, most)
    window = (upper >= own[:, None] * 0.9) & (lower <= own[:, None] * 1.1)
    assert window.mean() < 0.35
