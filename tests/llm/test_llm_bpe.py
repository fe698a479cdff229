import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

import edges
from tablecraft.llm import bpe, bpe_tables, queries
from tablecraft.llm.common import table

SF_DIR = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(bpe_tables.VOCABULARY)


@pytest.fixture(scope="module")
def known():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as file:
        return bpe.Text(bpe.parse_ranks(file.read()), public_tokenizers.PATTERN)


def test_random_texts(known, own):
    rng = random.Random(3)
    parts = ["abcdefgh ", "the andtion ing\n", "éàüñ ß", "日本語", "a", " \t\n\x0b\x0c\r\x1c\x85\xa0　", "0123²Ⅷ", "!?#😀", "'s't're"]
    for _ in range(4000):
        text = "".join(rng.choice(rng.choice(parts)) for _ in range(rng.randint(0, 50)))
        ids = own.encode(text)
        assert ids == ",".join(map(str, known.encode_ordinary(text))), text
        assert own.decode(ids) == text.encode()


def test_all_planes_of_unicode(known, own):
    rng = random.Random(7)
    ranges = [(0, 0x2FF), (0, 0xD7FF), (0xE000, 0x1FFFF), (0x20000, 0x10FFFF)]
    for _ in range(3000):
        text = "".join(chr(rng.randint(*rng.choice(ranges))) for _ in range(rng.randint(0, 30)))
        assert own.encode(text) == ",".join(map(str, known.encode_ordinary(text))), ascii(text)


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 10_000, " " * 20_000, "é" * 10_000, "thetion" * 3000])
def test_long_pieces(known, own, text):
    assert own.encode(text) == ",".join(map(str, known.encode_ordinary(text)))


def test_query_over_all_documents(spark, known):
    got = edges.in_order(queries.QUERIES["op2_byte_bpe"](spark, SF_DIR).collect())
    want = []
    for r in table(spark, SF_DIR, "documents").collect():
        ids = known.encode_ordinary(r["text"] or "")
        joined = ",".join(map(str, ids)).encode()
        want.append((r["doc_id"], len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == edges.in_order(want)


def test_odd_rows(spark, known):
    docs = edges.documents(spark)
    want = [(i, known.encode_ordinary(t)) for i, t in edges.texts_of(docs)]
    encoded = bpe_tables.encode(docs)
    assert edges.in_order((r[0], r[1], list(r[2])) for r in encoded.collect()) == edges.in_order((i, len(x), x) for i, x in want)
    decoded = bpe_tables.decode(encoded)
    assert edges.in_order((r[0], bytes(r[1]).decode()) for r in decoded.collect()) == edges.in_order(edges.texts_of(docs))
    assert bpe_tables.digests(docs).count() == docs.count()
    assert bpe_tables.digests(edges.empty(spark)).count() == 0
