import itertools
import random
import zlib
from collections import defaultdict

import edges
from tablecraft.llm import shard_tables
from tablecraft.llm.common import Workspace, table
from tablecraft.llm.shard import difference

SF_DIR = "/root/testdata/sf0.01"


def sums_of(parts, shards):
    sums = [0] * shards
    for part, slots in zip(parts, difference(parts, shards)):
        assert len(set(slots)) == len(part)
        for size, slot in zip(part, slots):
            sums[slot] += size
    return sums


def test_known_example():
    assert sorted(sums_of([[8], [7], [6], [5], [4]], 2)) == [14, 16]
    assert difference([], 3) == [] and difference([[], [5]], 3) == [[], [0]]


def test_never_worse_than_largest_first():
    rng = random.Random(5)
    for _ in range(100):
        sizes = [rng.randint(1, 1000) for _ in range(rng.randint(1, 60))]
        shards = rng.randint(1, 7)
        sums = sums_of([[s] for s in sizes], shards)
        assert sum(sums) == sum(sizes)
        assert max(sums) <= max(max(sizes), -(-sum(sizes) // shards) + max(sizes))
    even = sums_of([[rng.randint(1, 10**6)] for _ in range(5000)], 40)
    assert max(even) - min(even) < 1000


def check(rows, docs, shards=40):
    known = defaultdict(list)
    for i, t in ((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()):
        data = (t or "").encode()
        known[i, len(data) + 16, zlib.crc32(data)].append(t)
    places = defaultdict(list)
    for r in rows:
        assert known[r["doc_id"], r["size"], r["text_crc32"]].pop() is not NotImplemented
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        places[r["shard"]].append(r["slot"])
    assert not any(known.values())
    assert all(sorted(s) == list(range(len(s))) for s in places.values())


def test_laws(spark):
    docs = table(spark, SF_DIR, "documents")
    for options in ({}, {"part_groups": 20, "driver_parts": 3}):
        got = shard_tables.by_bytes(docs, **options).collect()
        check(got, docs)
        shards, sums = defaultdict(set), defaultdict(int)
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        for r in got:
            shards[texts[r["doc_id"]]].add(r["shard"])
            sums[r["shard"]] += r["size"]
        assert all(len(s) == 1 for s in shards.values())
        largest = max(sum(r["size"] for r in g) for _, g in itertools.groupby(
            sorted(got, key=lambda r: texts[r["doc_id"]]), key=lambda r: texts[r["doc_id"]]))
        assert max(sums.values()) - min(sums.values()) <= (100 if not options else largest)


def test_odd_rows(spark):
    docs = edges.documents(spark)
    check(shard_tables.by_bytes(docs).collect(), docs)
    assert shard_tables.by_bytes(edges.empty(spark)).count() == 0


def spread_of(groups, spark, shards=40, **options):
    """Largest less smallest sum, and the largest group."""
    frame = spark.createDataFrame([(k.to_bytes(8, "big"), n) for k, n in enumerate(groups)], "key binary, bytes long")
    options = {"part_groups": 2000, "driver_parts": 1000} | options
    found = shard_tables.placed(frame, shards, Workspace(spark, "test"), **options).collect()
    assert len({bytes(r["key"]) for r in found}) == len(found) == len(groups)
    sums = [0] * shards
    for r in found:
        sums[r["shard"]] += groups[int.from_bytes(r["key"], "big")]
    return max(sums) - min(sums)


def test_many_parts_stay_even(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    sums = defaultdict(int)
    for r in shard_tables.by_bytes(docs).select("shard", "size").collect():
        sums[r["shard"]] += r["size"]
    assert len(sums) == 40 and max(sums.values()) - min(sums.values()) <= 1000
    rng = random.Random(9)
    groups = [min(50_000, int(rng.paretovariate(1.2) * 100)) for _ in range(12_000)]
    share = sum(groups) // 40
    assert max(groups) < share
    # Parts in tasks, combined in tasks, with large groups entering at every level.
    assert spread_of(groups, spark) <= 1000
    assert spread_of(groups, spark, part_groups=300, driver_parts=3) <= 1000
    # A hot group of a third of all bytes is a shard by itself; the others are even.
    hot = sum(groups) // 2
    assert spread_of([*groups, hot], spark) <= hot - (sum(groups) // 39) + 1000
