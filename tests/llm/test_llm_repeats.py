import hashlib
import random
from collections import Counter

import edges
from tablecraft.llm import repeats, repeats_tables
from tablecraft.llm.common import table

SF_DIR = "/root/testdata/sf0.001"


def brute(texts):
    times = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    rows = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if times[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        rows.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return rows


def same(docs):
    rows = edges.texts_of(docs)
    want = [(i, *w) for (i, _), w in zip(rows, brute([t.encode() for _, t in rows]))]
    got = repeats_tables.remove(docs)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return edges.in_order(got.collect()) == edges.in_order(want)


def test_real_documents(spark):
    assert same(table(spark, SF_DIR, "documents"))


def test_overlaps_borders_and_periods(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(300, 3000))) for _ in range(10)]
    texts = [t for t in edges.TEXTS if t != edges.LONG]
    for _ in range(80):
        text = ""
        for _ in range(rng.randint(1, 4)):
            part = rng.choice(base)
            i = rng.randint(0, len(part))
            text += part[i : rng.randint(i, len(part))] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 60)))
        texts.append(text)
    texts += ["ab" * 700, "ab" * 900, "a" * 2000, "a" * 399, "b" * 400, "q" * 401, "lol " * 500, "xlol " * 300]
    texts += [base[0], base[0], base[1][:400], base[1][1:401], base[2][:399]]
    assert same(edges.documents(spark, texts))


def test_runs_hold_every_window_once():
    rng = random.Random(1)
    data = bytes(rng.choice(b"abcd ") for _ in range(repeats.CHUNK + 3000))
    places = []
    for node, _ in repeats.runs(data):
        assert 0 <= node.low <= node.high <= repeats.LENGTH - repeats.GRAM
        places += range(node.anchor - node.high, node.anchor - node.low + 1)
    assert places == list(range(len(data) - 399))


def test_empty(spark):
    assert repeats_tables.remove(edges.empty(spark)).count() == 0
