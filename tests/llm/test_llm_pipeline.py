"""The pipeline against stages written out plainly."""

import public_tokenizers

import corpus_pipeline
import edges
from tablecraft.llm import bpe, bpe_tables, pii
from tablecraft.llm.common import table
from test_llm_decontaminate import brute as passages
from test_llm_quality import brute as numbers
from test_llm_simhash import brute_groups

SF_DIR = "/root/testdata/sf0.001"


def rejected(text):
    n, chars, symbols, lines, _, failed = numbers(text)
    words = text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    stutters = sum(a == b for a, b in zip(words, words[1:]))
    return (
        failed or 100 * symbols > 20 * n or 100 * lines > 40 * len(text.split("\n"))
        or not 2 * n <= chars <= 20 * n or 100 * stutters > 30 * n
    )


def test_stage_by_stage_and_run(spark):
    docs = table(spark, SF_DIR, "documents")
    items = [tuple(r) for r in table(spark, SF_DIR, "benchmark").select("item_id", "text").collect()]
    rows = [(i, t) for i, t in edges.texts_of(docs) if not rejected(t)]
    want = [rows]
    firsts = {c for _, _, c in brute_groups(rows)}
    want.append([r for r in want[-1] if r[0] in firsts])
    want.append([r for r in want[-1] if not passages(r[1], items)[-1]])
    want.append([(i, pii.mask(t, pii.spans(t))) for i, t in want[-1]])
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:4], want):
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert edges.in_order(edges.texts_of(docs)) == edges.in_order(expected), name
    with open(public_tokenizers.path(bpe_tables.VOCABULARY), "rb") as file:
        coder = bpe.Text(bpe.parse_ranks(file.read()), public_tokenizers.PATTERN)
    tokens = [(i, coder.encode(t)) for i, t in want[-1]]
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert edges.in_order((r["doc_id"], ",".join(map(str, r["ids"]))) for r in got) == edges.in_order(tokens)
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)


def test_stages_take_odd_and_empty_tables(spark):
    for docs in (edges.documents(spark), edges.empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF_DIR)
            assert out.count() <= docs.count(), name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns, name
