import hashlib
import random
import re

import edges
from tablecraft.llm import decontaminate_tables as tables

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text, items):
    words = WORD.findall(lower(text))
    hit, names = set(), set()
    for item_id, item in items:
        parts = WORD.findall(lower(item))
        n = min(10, len(parts))
        for k in range(len(parts) - n + 1 if parts else 0):
            for i in range(len(words) - n + 1):
                if words[i : i + n] == parts[k : k + n]:
                    hit.update(range(i, i + n))
                    if item_id is not None:
                        names.add(str(item_id))
    joined = ",".join(sorted(names)).encode()
    return len(words), len(hit), len(names), hashlib.sha256(joined).hexdigest(), bool(hit)


def tables_of(spark):
    rng = random.Random(4)
    vocabulary = "alpha beta Gamma délta 7 eps".split()
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 9, 10, 11, 30]))) for i in range(12)]
    items += [(3, items[0][1]), (None, text(12)), (20, None), (21, ""), (22, "!?"), (5, items[5][1])]
    docs = [t for t in edges.TEXTS if t != edges.LONG] + [text(rng.randint(0, 80)) for _ in range(40)]
    docs += [items[k][1].upper().replace(" ", ", ") for k in range(6)]
    return spark.createDataFrame(items, "item_id long, text string"), edges.documents(spark, docs), items


def test_against_brute_force_in_one_and_many_blocks(spark):
    benchmark, docs, items = tables_of(spark)
    want = edges.in_order((i, *brute(t, items)) for i, t in edges.texts_of(docs))
    assert edges.in_order(tables.report(docs, benchmark).collect()) == want
    assert edges.in_order(tables.report(docs, benchmark, block_bytes=300).collect()) == want


def test_clean_keeps_rows_without_hits_whole(spark):
    benchmark, docs, items = tables_of(spark)
    got = tables.clean(docs, benchmark)
    assert got.columns == docs.columns
    want = [(i, t) for i, t in edges.texts_of(docs) if not brute(t, items)[-1]]
    assert edges.in_order(edges.texts_of(got)) == edges.in_order(want)


def test_blocks_are_bounded_and_one_is_held_at_a_time(spark, monkeypatch):
    benchmark, docs, items = tables_of(spark)
    repeated = benchmark.crossJoin(spark.range(30)).select("item_id", "text")
    parts = [p.collect() for p in tables.blocks(repeated, block_bytes=300)]
    assert edges.in_order((r["item_id"], r["text"]) for p in parts for r in p) == edges.in_order(
        {(None if i is None else str(i), t) for i, t in items if t is not None}
    )
    for part in parts:
        assert len(part) <= 1 or sum(len(r["text"].encode()) + len(r["item_id"] or "") + 64 for r in part) <= 300
    alive, most = [], []
    broadcast, destroy = spark.sparkContext.broadcast, tables.Broadcast.destroy
    monkeypatch.setattr(
        spark.sparkContext, "broadcast", lambda value: (alive.append(1), most.append(len(alive)), broadcast(value))[-1]
    )
    monkeypatch.setattr(tables.Broadcast, "destroy", lambda self: (alive.pop(), destroy(self))[-1])
    got = tables.clean(docs, repeated, block_bytes=300)
    assert len(most) == len(parts) > 2 and max(most) == 1
    want = [(i, t) for i, t in edges.texts_of(docs) if not brute(t, items)[-1]]
    assert got.columns == docs.columns
    assert edges.in_order(edges.texts_of(got)) == edges.in_order(want)


def test_empty(spark):
    benchmark, docs, _ = tables_of(spark)
    assert tables.report(edges.empty(spark), benchmark).count() == 0
    assert tables.report(docs, benchmark.limit(0)).where("contaminated OR n_hit > 0").count() == 0
    assert tables.clean(docs, benchmark.limit(0)).count() == docs.count()
