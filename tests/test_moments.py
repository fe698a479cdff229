import numpy as np
import pandas as pd
import pytest

from tablecraft.functions import moments
from tablecraft.operators import relations


def brute(data):
    """Pairwise n and correlation about the means of the pair's own rows."""
    out = {}
    for x in data:
        for y in data:
            both = data[x].notna() & data[y].notna()
            a, b = data[x][both].to_numpy(float), data[y][both].to_numpy(float)
            if not len(a) or a.min() == a.max() or b.min() == b.max():
                out[x, y] = len(a), None
            elif not (np.isfinite(a).all() and np.isfinite(b).all()):
                out[x, y] = len(a), float("nan")
            else:
                a, b = a - a.mean(), b - b.mean()
                out[x, y] = len(a), (a @ b) / np.sqrt((a @ a) * (b @ b))
    return out


def check(spark, data, scans, monkeypatch):
    seen = []
    for name in ("of_all_pairs", "_again"):
        def counting(*args, run=getattr(moments, name), name=name):
            seen.append(name)
            return run(*args)
        monkeypatch.setattr(moments, name, counting)
    rows = [tuple(None if pd.isna(v) else float(v) for v in row) for row in data.itertuples(index=False)]
    frame = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(5)
    got = {(r.x, r.y): (r.n, r["corr"]) for r in relations.correlation_matrix(frame).collect()}
    want = brute(data)
    assert set(got) == set(want) and len(seen) == scans
    for pair, (n, corr) in want.items():
        assert got[pair][0] == n
        if corr is None or corr != corr:
            assert got[pair][1] is None if corr is None else got[pair][1] != got[pair][1], pair
        else:
            assert got[pair][1] == pytest.approx(corr, abs=1e-9), pair


def test_many_columns_with_gaps_take_one_scan(spark, monkeypatch):
    rng = np.random.default_rng(1)
    data = pd.DataFrame(rng.normal(size=(3000, 60)) @ rng.normal(size=(60, 60)) * 10.0 ** rng.integers(-2, 9, 60)
                        + 10.0 ** rng.integers(0, 4, 60), columns=[f"c{k}" for k in range(60)])
    data = data.mask(rng.random(data.shape) < 0.2)
    data["fixed"], data["empty"] = 3.0, np.nan
    check(spark, data, 1, monkeypatch)


def test_rows_of_a_pair_far_from_the_column_means(spark, monkeypatch):
    rng = np.random.default_rng(2)
    near = rng.random(2000)
    data = pd.DataFrame({
        "a": np.where(np.arange(2000) % 2, 1e8 + near, rng.normal(size=2000) * 1e9),
        "b": np.where(np.arange(2000) % 2, 5 - near, np.nan),
        "held": np.where(np.arange(2000) % 2, 7.0, rng.normal(size=2000)),
        "c": rng.normal(size=2000),
    })
    check(spark, data, 2, monkeypatch)


def test_infinite_values_spoil_their_pairs_only(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = pd.DataFrame(rng.normal(size=(400, 3)), columns=["a", "b", "c"])
    data.loc[5, "a"], data.loc[5, "b"] = np.inf, np.nan
    check(spark, data, 1, monkeypatch)


def test_no_rows(spark):
    got = relations.correlation_matrix(spark.createDataFrame([], "a double, b int")).collect()
    assert sorted((r.x, r.y, r.n, r["corr"]) for r in got) == [(x, y, 0, None) for x in "ab" for y in "ab"]
