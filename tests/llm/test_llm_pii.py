import hashlib
import random
import re
import time

import edges
from tablecraft.llm import pii, pii_tables

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, found):
    digits = re.findall("[0-9]", found)
    if kind == "ip":
        return all(int(part) <= 255 for part in found.split("."))
    if kind == "card":
        total = sum(int(d) if k % 2 == 0 else sum(map(int, str(2 * int(d)))) for k, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if holds(k, m[0])]


def test_base_spans():
    rng = random.Random(1)
    found = 0
    for _ in range(30_000):
        kinds = ["0123456789. -", "ab@.c-d@.", "+12 ()-.3", "4 1-2@"]
        text = "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute(text), text
        found += len(brute(text))
    for n in range(15, 21):
        for _ in range(300):
            digits = "".join(rng.choice("0123456789") for _ in range(n))
            text = "x " + rng.choice([" ", "-", ""]).join(re.findall(".{1,4}", digits)) + " y"
            assert pii.base_spans(text) == brute(text), text
    assert found > 1000


def test_added_spans_need_checks_or_context():
    kinds = lambda text: [s[0] for s in pii.spans(text)]
    assert kinds("account GB82 WEST 1234 5698 7654 32.") == ["iban"]
    assert kinds("account GB82 WEST 1234 5698 7654 33.") == []
    assert kinds("my ssn 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert kinds("amex card 378282246310005") == ["short_card"] and kinds("no 378282246310005") == []
    assert kinds("call (212) 555-8457") == ["local_phone"] and kinds("(212) 555-8457") == []
    assert kinds("call +1 (212) 555-8457") == ["phone"]


def test_time_is_linear():
    start = time.perf_counter()
    for unit in ("a", "1", "1.", "@", "+1", "A1", "1 ", "a@", "AB12", "(", "AB12 ", "1-"):
        pii.spans(unit * (100_000 // len(unit)))
    assert time.perf_counter() - start < 20


def test_table(spark):
    docs = edges.documents(spark, [*edges.TEXTS, "é a@b.co 1.2.3.4 4111 1111 1111 1111, +1 (212) 555-0000"])
    rows = []
    for i, text in edges.texts_of(docs):
        base = brute(text)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        rows.append((i, *(sum(b[0] == k for b in base) for k in PATTERNS), hashlib.sha256(joined.encode()).hexdigest()))
    got = pii_tables.find(docs)
    assert edges.in_order(tuple(r)[:6] for r in got.collect()) == edges.in_order(rows)
    assert all(b in s["spans"] for s in got.where("n_email = 1").collect() for b in ["email:"])
    masked = pii_tables.redact(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    assert masked.where("text LIKE '%@%'").count() == 0
    assert masked.where("text IS NULL").count() == docs.where("text IS NULL").count()
    assert pii_tables.find(edges.empty(spark)).count() == 0


def test_mask_of_overlapping_spans():
    text = "a 1.2.3.4@b.co z"
    assert pii.mask(text, pii.spans(text)) == "a <EMAIL> z"
