import hashlib
import random
import re
import zlib

import pytest

import edges
from tablecraft.llm import dialogue, dialogue_tables
from tablecraft.llm.common import table

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, kind int, audit string, n int, `gone` boolean"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def brute_damage(rows):
    out = []
    for conv, turn, role, text in sorted(
        rows,
        key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " ", hashlib.md5((" " if r[3] is None else r[3]).encode()).digest()),
    ):
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        role = "user" if hit == 4 else role
        out += [(turn, role, text)] * (2 if hit == 3 else 1)
    return out


def brute_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        letters = WORD.findall(text)
        out.append("blank" if not letters else "duplicate" if (role, text) in seen
                   else "truncated" if letters[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_repair(rows, faults):
    """Cheapest edits by trying all of them row by row, keeping all strings of roles that can still be completed."""
    def closed(best):
        # Insertions: at most two in a row are ever of use before the next row.
        for _ in range(3):
            for (roles, turns), (cost, audit) in list(best.items()):
                for role in ("user", "assistant"):
                    put(best, roles, turns, role, "", cost + 5, audit + "I")
        return best

    def put(best, roles, turns, role, text, cost, audit):
        # Only the end of the string of roles matters from here on.
        if roles + (role[:1] or " ") in ("s", "u", "su", "ua", "au"):
            add(best, role[0], turns + (f"{role}:{text}",), cost, audit)

    def add(best, roles, turns, cost, audit):
        for key in [k for k in best if k[0] == roles]:
            if best[key] <= (cost, audit):
                return
            del best[key]
        best[roles, turns] = (cost, audit)

    best = closed({("", ()): (0, "")})
    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for (roles, turns), (cost, audit) in best.items():
            add(after, roles, turns, cost + 2, audit + "D")
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                put(after, roles, turns, role, text, cost + more, audit + "K")
                for other in ("user", "assistant"):
                    put(after, roles, turns, other, text, cost + 1 + more, audit + "R")
        best = closed(after)
    (cost, audit), turns = min((v, k[1]) for k, v in best.items() if k[0] in ("", "a"))
    return cost, audit, turns


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        left = brute_damage([r for r in rows if r[0] == conv])
        faults = brute_faults(left)
        turns = [t for t, _, _ in left if t is not None]
        initials = [role[:1] or " " for _, role, _ in left]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, kept = brute_repair(left, faults)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest))
    return edges.in_order(out)


def plain(frame):
    return [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in frame.collect()]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "User", "", " ", None, "unknown"]
    texts = ["Yes.", "No!", "cut", "", " \n", None, "a. ", "Why?\n", "x" * 40_000, "b", "naïve – 漢字", "naïve – 漢字。"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, None if rng.random() < 0.1 else turn + (turn > 4), rng.choice(roles[:5] if conv % 2 else roles),
                         rng.choice(texts) if conv % 3 else f"{rng.choice(texts)} {turn}."))
    rows += [(None, k, "user", "hello.") for k in range(3)]
    rows += [(7, 1, "user", "twice the same.")] * 3
    # A long conversation, over several stretches and tasks.
    rows += [(1000, k, rng.choice(roles[:3]), rng.choice([f"t{k}.", f"t{k}", "same."])) for k in range(700)]
    return spark.createDataFrame([(*r, 1, "K", None, None) for r in rows], SCHEMA)


def test_same_as_trying_all_edits(spark, odd):
    for rows in (table(spark, SF_DIR, "conversations"), odd):
        assert edges.in_order(dialogue_tables.report(rows).collect()) == brute(plain(rows))


def test_stretches_chain_to_the_whole():
    rng = random.Random(5)
    for _ in range(300):
        rows = [(rng.choice("suax"), rng.choice(["", "", "", "blank", "truncated", "duplicate"])) for _ in range(rng.randrange(0, 14))]
        want = dialogue.goal({(0, k): v for k, v in dialogue.lightest(rows, 0, dialogue.ACCEPTED, any_goal=True).items()})
        cut = rng.randrange(len(rows) + 1)
        paths = dialogue.extended({(s, s): (0, "") for s in dialogue.STATES}, rows[:cut])
        assert dialogue.goal(dialogue.extended(paths, rows[cut:])) == want
        later = dialogue.extended({(s, s): (0, "") for s in dialogue.STATES}, rows[cut:])
        assert dialogue.goal(dialogue.chained(paths, later)) == want


def test_one_conversation_over_many_tasks(spark, odd):
    """A conversation that holds most rows is dealt over tasks and chained."""
    held = dialogue_tables.ORDERED_ROWS
    rows = odd.where("conv_id = 1000 OR conv_id < 5")
    want = brute(plain(rows))
    try:
        dialogue_tables.ORDERED_ROWS = 40
        assert edges.in_order(dialogue_tables.report(rows).collect()) == want
    finally:
        dialogue_tables.ORDERED_ROWS = held


def test_repaired_rows(spark, odd):
    got = {}
    for r in dialogue_tables.repair(odd).collect():
        got.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    for turns in got.values():
        turns.sort()
        assert [t for t, _, _ in turns] == list(range(len(turns)))
        assert re.fullmatch("s?(ua)+", "".join(r[0] for _, r, _ in turns))
    clean = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")], "conv_id long, turn long, role string, text string")
    assert edges.in_order(dialogue_tables.repair(clean).collect()) == edges.in_order(clean.collect())


def test_no_rows(spark, odd):
    assert dialogue_tables.report(odd.limit(0)).count() == 0
    assert dialogue_tables.repair(odd.limit(0)).count() == 0
    # All rows dropped.
    turn = next(k for k in range(1000) if zlib.crc32(f"1:{k}".encode()) % 20 == 0)
    alone = spark.createDataFrame([(1, turn, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in dialogue_tables.report(alone).collect()] == [
        (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    ]
