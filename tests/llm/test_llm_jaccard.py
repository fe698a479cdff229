import random
import re
from collections import defaultdict

import numpy as np
import pytest

import edges
from tablecraft.llm import jaccard_tables, shingle_sets
from tablecraft.llm.common import Workspace, table
from tablecraft.llm.graph import components

SF_DIR = "/root/testdata/sf0.001"


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_pairs(grams):
    return [
        (i, j) for i in range(len(grams)) for j in range(i)
        if grams[i] and 100 * len(grams[i] & grams[j]) >= 80 * len(grams[i] | grams[j])
    ]


def brute(rows):
    grams = [brute_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in brute_pairs(grams):
        parent[root(i)] = root(j)
    members = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        members[root(i)].append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in members.items()}
    return edges.in_order((doc, len(grams[i]), least[root(i)]) for i, (doc, _) in enumerate(rows))


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(6)
    texts = [t for t in edges.TEXTS if t != edges.LONG]
    # Copies at all distances around the limit, of texts of all sizes, in large and small groups.
    for size, group in ((6, 30), (30, 30), (110, 150), (900, 20)):
        base = [f"w{rng.randrange(size * 3)}" for _ in range(size)]
        texts += [changed(rng, base, rng.randrange(1 + max(2, size // 30))) for _ in range(group)]
        texts += [" ".join(base)] * 3
    # A line and a passage that most documents hold.
    line, passage = "one very common line of words here", " ".join(f"p{k}" for k in range(60))
    for k in range(60):
        own = " ".join(f"o{rng.randrange(400)}" for _ in range(rng.randrange(0, 80)))
        texts.append(f"{own}\n{line}\n{own if k % 2 else passage}")
    return edges.documents(spark, texts)


def test_real_and_odd_rows(spark, odd):
    for docs in (table(spark, SF_DIR, "documents"), odd):
        assert edges.in_order(jaccard_tables.clusters(docs).collect()) == brute(edges.texts_of(docs))


def test_large_buckets_and_frequent_grams(spark, odd, monkeypatch):
    """Small tiles, and slots that are frequent at once: the same groups."""
    monkeypatch.setattr(jaccard_tables, "TILE_ROWS", 8)
    monkeypatch.setattr(jaccard_tables, "FREQUENT", 3)
    workspace = Workspace(spark, "test")
    documents, classes, links = jaccard_tables.linked(odd, workspace, tile_rows=8)
    found = {r["node"]: r["component"] for r in components(links, workspace).collect()}
    least = {r["name"]: r["least_id"] for r in classes.collect()}
    members = defaultdict(list)
    for name, doc in least.items():
        if doc is not None:
            members[found.get(name, name)].append(doc)
    got = [
        (r["doc_id"], r["n"], min(members[found.get(r["name"], r["name"])], default=None) if r["n"] else r["doc_id"])
        for r in documents.collect()
    ]
    assert edges.in_order(got) == brute(edges.texts_of(odd))


def test_links_are_exact(spark, odd):
    documents, _, links = jaccard_tables.linked(odd, Workspace(spark, "test"))
    texts = [t for _, t in edges.texts_of(odd)]
    grams = {}
    counts = np.zeros(shingle_sets.SLOTS, np.int64)
    for t in texts:
        counts += np.bincount(shingle_sets.slots(shingle_sets.hashes(t)), minlength=shingle_sets.SLOTS)
    rank = shingle_sets.ranks(counts)
    for t in texts:
        name = shingle_sets.name(shingle_sets.ordered(shingle_sets.hashes(t), rank))
        grams[name - (1 << 64 if name >> 63 else 0)] = brute_set(t)
    found = links.collect()
    assert len(found) > 50
    for r in found:
        a, b = grams[r["u"]], grams[r["v"]]
        assert 100 * len(a & b) >= 80 * len(a | b)


def test_bounds_keep_every_linked_pair():
    rng = random.Random(7)
    base = [f"w{k}" for k in range(140)]
    texts = sorted({changed(rng, base[: rng.choice((20, 60, 64, 66, 70, 140))], rng.randrange(4)) for _ in range(250)})
    grams = [brute_set(t) for t in texts]
    found = [shingle_sets.hashes(t) for t in texts]
    assert [len(f) for f in found] == [len(g) for g in grams]
    size = np.array([len(f) for f in found])
    i, j, shared = shingle_sets.close_pairs(size, [shingle_sets.parity(f) for f in found], np.arange(len(texts)), tile=16)
    got = {(max(p), min(p)) for p in zip(i.tolist(), j.tolist())}
    want = set(brute_pairs(grams))
    assert want <= got and len(got) < 1.5 * len(want)
    assert all(len(grams[a] & grams[b]) <= s for a, b, s in zip(i, j, shared))


def test_numbers_of_sets():
    for n in range(1, 300):
        # A linked set shares at least 80 % of the larger; the first n-grams are the rest and one.
        assert shingle_sets.prefix(n) == n - -(-80 * n // 100) + 1
        for other in range(n, 300):
            least = next(o for o in range(other + 1) if 100 * o >= 80 * (n + other - o))
            assert shingle_sets.least_shared(n + other) == least
    assert shingle_sets.prefix(0) == 0
    counts = np.zeros(shingle_sets.SLOTS, np.int64)
    counts[5] = 9
    counts[7] = 3
    rank = shingle_sets.ranks(counts)
    assert rank[7] == shingle_sets.SLOTS - 2 and rank[5] == shingle_sets.SLOTS - 1 and rank[0] == 0


def test_no_rows(spark):
    assert jaccard_tables.clusters(edges.empty(spark)).count() == 0
    blank = edges.documents(spark, [None, "", " \n", "", "\t", None])
    assert edges.in_order(jaccard_tables.clusters(blank.where("doc_id IS NOT NULL")).collect()) == brute(
        edges.texts_of(blank.where("doc_id IS NOT NULL"))
    )
