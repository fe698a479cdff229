"""Benchmark passages in documents: Wu-Manber search over words.

Words are runs of a to z (A to Z lower-cased first), digits and all characters
beyond ASCII. A window is ten consecutive words of an item, or the whole item if it
has fewer. Windows of equal length form a pattern set. Its shift table says for a
block of words how far the scan may move on without passing an occurrence; blocks
that end a window lead to a bucket, whose windows are compared with the text word by
word. A scan looks at about one block per window length of text without benchmark
words in it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

WINDOW = 10
BLOCK = 2

_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)

Words = list[bytes]


def words(text: str | None) -> Words:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def windows(item: Words, length: int = WINDOW) -> Iterable[tuple[bytes, ...]]:
    if item:
        n = min(length, len(item))
        for i in range(len(item) - n + 1):
            yield tuple(item[i : i + n])


class PatternSet:
    """Windows of one length, each with the items it comes from."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[str]]):
        self.length = length
        self.block = min(BLOCK, length)
        self.longest_shift = length - self.block + 1
        self.items = patterns
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], list[tuple[bytes, ...]]] = defaultdict(list)
        for pattern in patterns:
            for end in range(self.block, length + 1):
                key = pattern[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.longest_shift), length - end)
            self.bucket[pattern[length - self.block :]].append(pattern)

    def scan(self, text: Words) -> Iterable[tuple[int, tuple[bytes, ...]]]:
        """(first word, window) of every occurrence, from left to right."""
        end, n, length, block = self.length, len(text), self.length, self.block
        shift, longest = self.shift.get, self.longest_shift
        while end <= n:
            key = tuple(text[end - block : end])
            step = shift(key, longest)
            if step:
                end += step
                continue
            start = end - length
            found = tuple(text[start:end])
            for pattern in self.bucket[key]:
                if pattern == found:
                    yield start, pattern
            end += 1


class Benchmark:
    """All windows of some items, by length."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], length: int = WINDOW):
        by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
        for item_id, text in items:
            for window in windows(words(text), length):
                known = by_length[len(window)][window]
                if item_id is not None:
                    known.add(item_id)
        self.sets = [PatternSet(n, patterns) for n, patterns in sorted(by_length.items())]

    def search(self, text: Words) -> tuple[list[tuple[int, int]], set[str]]:
        """Occurrences as word intervals, end exclusive, and the items with an occurrence."""
        intervals, items = [], set()
        for patterns in self.sets:
            for start, window in patterns.scan(text):
                intervals.append((start, start + patterns.length))
                items |= patterns.items[window]
        return intervals, items


def covered(intervals: Iterable[tuple[int, int]]) -> int:
    """Words in at least one interval."""
    total, reached = 0, 0
    for start, end in sorted(intervals):
        total += max(0, end - max(start, reached))
        reached = max(reached, end)
    return total
