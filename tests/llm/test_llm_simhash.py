import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

import edges
from tablecraft.llm import simhash, simhash_tables
from tablecraft.llm.common import Workspace, table
from tablecraft.llm.graph import components

SF_DIR = "/root/testdata/sf0.001"


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows, radius=4, firsts=False):
    """(doc_id, fingerprint, component_id) from all pairs; with ``firsts`` one component_id per group."""
    prints = [brute_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        groups[root(i)].append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    if firsts:
        return edges.in_order([i] for i in least.values())
    return [(doc, f"{prints[i]:016x}", least[root(i)]) for i, (doc, _) in enumerate(rows)]


@pytest.fixture(scope="module")
def odd(spark):
    base = [t for t in edges.TEXTS if t != edges.LONG]
    line = " ".join(f"w{i}" for i in range(300))
    near = [line.replace(f"w{k} ", "other ") for k in range(0, 60, 3)]
    return edges.documents(spark, [*base, line, *near])


def test_real_and_odd_rows(spark, odd):
    for docs in (table(spark, SF_DIR, "documents"), odd):
        want = edges.in_order(brute_groups(edges.texts_of(docs)))
        assert edges.in_order(simhash_tables.clusters(docs).collect()) == want


def test_parts_of_large_buckets_lose_no_link(spark):
    rng = np.random.default_rng(2)
    centers = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = {int(c) for c in centers}
    for c in centers:
        for _ in range(8):
            prints.add(int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False)))
    values = np.array(sorted(prints), np.uint64)
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    want = {
        (min(a, b), max(a, b))
        for i, a in enumerate(values.view(np.int64).tolist())
        for b in values.view(np.int64)[np.bitwise_count(values ^ values[i]) <= 4].tolist()
        if a != b
    }

    def groups(links):
        parent = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[root(a)] = root(b)
        found = defaultdict(set)
        for x in list(parent):
            found[root(x)].add(x)
        return {frozenset(g) for g in found.values()}

    for rows in (simhash_tables.TILE_ROWS, 3):
        got = [(r["u"], r["v"]) for r in simhash_tables.links(frame, 4, rows).collect()]
        assert {(min(p), max(p)) for p in got} <= want
        assert groups(got) == groups(want)


def test_tiles_find_all_close_pairs():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 12, 3000, dtype=np.uint64)
    values = values[np.argsort(np.bitwise_count(values), kind="stable")]
    got = {p for x, y in simhash.close_pairs(values, values, True, 1) for p in zip(x.tolist(), y.tolist())}
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 1
    assert got == set(zip(*(a.tolist() for a in np.nonzero(np.triu(near, 1)))))
    left, right = values[::2], values[1::2]
    got = {p for x, y in simhash.close_pairs(left, right, False, 1) for p in zip(x.tolist(), y.tolist())}
    near = np.bitwise_count(left[:, None] ^ right[None, :]) <= 1
    assert got == set(zip(*(a.tolist() for a in np.nonzero(near))))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(6, 60)] + [(7, 7), (200, 201), (201, 200)]
    frame = spark.createDataFrame(links, "u long, v long")
    got = {r["node"]: r["component"] for r in components(frame, Workspace(spark, "test")).collect()}
    want = {i: 100 for i in range(100, 161)} | {k: 5 for k in range(5, 60)} | {200: 200, 201: 200}
    assert got == want
    assert components(frame.limit(0), Workspace(spark, "test")).count() == 0


def test_one_of_each(spark, odd):
    docs = table(spark, SF_DIR, "documents")
    got = simhash_tables.one_of_each(docs)
    want = sorted({c for _, _, c in brute_groups(edges.texts_of(docs))})
    assert sorted(r["doc_id"] for r in got.collect()) == want and got.columns == docs.columns
    # Odd rows: one row per group, though some have no doc_id or repeat.
    stay = simhash_tables.one_of_each(odd)
    assert stay.columns == odd.columns
    assert edges.in_order([r["doc_id"]] for r in stay.collect()) == brute_groups(edges.texts_of(odd), firsts=True)


def test_empty(spark):
    assert simhash_tables.clusters(edges.empty(spark)).count() == 0
    assert simhash_tables.one_of_each(edges.empty(spark)).count() == 0
