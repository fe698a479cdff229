"""The lightest repair of a conversation, by Knuth's agenda over weighted deductions.

An item (place, state) says that the first ``place`` rows are dealt with and what the
turns kept so far end in. A deduction takes an item and the next row, or an inserted
turn, to another item, adds a cost of 0 or more and appends one letter. Items leave the
agenda in the order of (cost, letters), and the first time one leaves it its value is
final: a deduction never makes (cost, letters) smaller, and it keeps the order of two
values of one item. It does keep it, because of two equally cheap values of one item
neither can begin with the other: the longer one would hold the same edits of the same
rows, and insertions besides, which cost more.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

#: What the turns kept so far end in: nothing yet, a system turn, a user turn, an answer.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: States a repaired conversation may end in.
ACCEPTED = (START, ASSISTANT)
#: Fixed costs of the edits Keep, Rerole, Delete and Insert, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

FINE, BLANK, DUPLICATE, CUT = "", "blank", "duplicate", "truncated"

#: (initial of the role, fault) of a row.
Row = tuple[str, str]
#: (cost, letters) of a derivation.
Value = tuple[int, str]
#: Lightest derivations by the states they start and end in.
Paths = dict[tuple[int, int], Value]

_NEXT = {
    START: {"s": SYSTEM, "u": USER},
    SYSTEM: {"u": USER},
    USER: {"a": ASSISTANT},
    ASSISTANT: {"u": USER},
}


def deductions(state: int, row: Row | None) -> Iterator[tuple[int, int, int, str]]:
    """(rows taken, state, cost, letter) of what follows from an item; ``row`` is None at the end."""
    for role, to in _NEXT[state].items():
        if role != "s":
            yield 0, to, INSERT, "I"
    if row is None:
        return
    initial, fault = row
    yield 1, state, DELETE, "D"
    if fault in (BLANK, DUPLICATE):
        return
    stays = TRUNCATED if fault == CUT else 0
    for role, to in _NEXT[state].items():
        if role == initial:
            yield 1, to, KEEP + stays, "K"
        if role != "s":
            yield 1, to, REROLE + stays, "R"


def lightest(rows: Sequence[Row], entry: int, goals: Sequence[int], any_goal: bool = False) -> dict[int, Value]:
    """(cost, letters) of the lightest way from ``entry`` over all rows to each of ``goals``.

    With ``any_goal`` the search ends with the first, lightest goal. Goals that cannot
    be reached are left out.
    """
    end = len(rows)
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, entry)]
    best: dict[tuple[int, int], Value] = {(0, entry): (0, "")}
    final: set[tuple[int, int]] = set()
    found: dict[int, Value] = {}
    while agenda:
        cost, letters, place, state = heapq.heappop(agenda)
        if (place, state) in final:
            continue
        final.add((place, state))
        if place == end and state in goals:
            found[state] = (cost, letters)
            if any_goal or len(found) == len(goals):
                break
        for taken, to, price, letter in deductions(state, rows[place] if place < end else None):
            item, value = (place + taken, to), (cost + price, letters + letter)
            if item not in final and value < best.get(item, (value[0] + 1, "")):
                best[item] = value
                heapq.heappush(agenda, (*value, *item))
    return found


def extended(paths: Paths, rows: Sequence[Row]) -> Paths:
    """``paths``, carried on over the next rows of the conversation."""
    between = {middle for _, middle in paths}
    return chained(paths, {(m, to): v for m in between for to, v in lightest(rows, m, STATES).items()})


def chained(first: Paths, second: Paths) -> Paths:
    """The lightest ways through two stretches of a conversation, one after the other."""
    out: Paths = {}
    for (entry, middle), (cost, letters) in first.items():
        for (start, to), (more, rest) in second.items():
            if start == middle:
                value = (cost + more, letters + rest)
                if (entry, to) not in out or value < out[entry, to]:
                    out[entry, to] = value
    return out


def goal(paths: Paths) -> Value:
    """The lightest way from the start of a conversation to an accepted end."""
    return min(value for (entry, to), value in paths.items() if entry == START and to in ACCEPTED)


class Repaired:
    """Applies the letters of a repair to rows given one after the other; yields (role, text) of the result.

    Turns that stay alternate between user and assistant after at most one system turn,
    so their number says who comes first.
    """

    def __init__(self, letters: str):
        self.letters = letters
        self.at = 0
        self.kept = 0
        self.shift = (len(letters) - letters.count("D")) % 2

    def _role(self) -> str:
        role = ("user", "assistant")[(self.kept - self.shift) % 2]
        self.kept += 1
        return role

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.letters[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._role(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        letter = self.letters[self.at]
        self.at += 1
        if letter != "D":
            due = self._role()
            yield (role if letter == "K" else due), text
