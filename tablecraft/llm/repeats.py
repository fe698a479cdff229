"""Repeated byte strings inside tasks: runs of windows, and hashes of growing strings.

Every window of LENGTH bytes starts at one place and has one anchor: the place of its
least GRAM-byte string by hash, the first of equals. The anchor depends on the bytes of
the window alone. Windows with the same anchor start next to each other and form a run,
so that a run stands for all of its places; the distance of a window's start from its
anchor is its offset, and a node is a run's anchor with a range of offsets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import xxhash

LENGTH = 400
GRAM = 128
#: Ranges of offsets of the later rounds; in the last one a node is a single window.
BLOCKS = (64, 8, 1)
#: Window starts handled at once; bounds memory for long texts.
CHUNK = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_PLACES = np.uint64((1 << 20) - 1)


class Node(NamedTuple):
    anchor: int
    low: int
    high: int


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of the ``gram`` bytes (a power of two) at each place, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _MIX
    n, power = 1, _BASE
    while n < gram:
        h = h[:-n] * power + h[n:]
        power = power * power
        n *= 2
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    n = 1
    while 2 * n <= width:
        values = np.minimum(values[:-n], values[n:])
        n *= 2
    return values if n == width else np.minimum(values[: n - width], values[width - n :])


def runs(data: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[Node, int]]:
    """All runs of windows with the hash of the string at their anchor (a signed long)."""
    codes = np.frombuffer(data, np.uint8)
    for first in range(0, len(codes) - length + 1, CHUNK):
        part = codes[first : first + CHUNK + length - 1]
        with np.errstate(over="ignore"):
            grams = _grams(part, gram)
        places = np.arange(len(grams), dtype=np.uint64)
        anchors = (_least((grams & ~_PLACES) | places, length - gram + 1) & _PLACES).astype(np.int64)
        cuts = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(anchors)])) - 1
        found = anchors[starts]
        hashes = grams[found].view(np.int64)
        for anchor, start, end, code in zip(
            found.tolist(), starts.tolist(), ends.tolist(), hashes.tolist()
        ):
            yield Node(anchor + first, anchor - end, anchor - start), code


def blocks(node: Node, size: int) -> Iterator[Node]:
    """The node cut at multiples of ``size`` of the offset, the same places for all texts."""
    low = node.low
    while low <= node.high:
        high = min(node.high, low // size * size + size - 1)
        yield Node(node.anchor, low, high)
        low = high + 1


def _pair(string: bytes) -> tuple[int, int]:
    n = xxhash.xxh3_128_intdigest(string)
    high, low = n >> 64, n & ((1 << 64) - 1)
    return high - (1 << 64) if high >> 63 else high, low - (1 << 64) if low >> 63 else low


def whole(data: bytes, node: Node, length: int = LENGTH) -> tuple[int, int]:
    """Rank pair of the string that all windows of the node cover together."""
    return _pair(data[node.anchor - node.high : node.anchor - node.low + length])


def common(data: bytes, node: Node, size: int, length: int = LENGTH) -> tuple[int, int]:
    """Rank pair of the string inside every window of the node's block of offsets, whole or not."""
    low = node.low // size * size
    return _pair(data[node.anchor - low : max(node.anchor - low, node.anchor - (low + size - 1) + length)])


def merged(intervals: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of byte intervals, as maximal runs in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(intervals):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def without(data: bytes, removed: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for start, end in removed:
        kept.append(data[at:start])
        at = end
    return b"".join([*kept, data[at:]])


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
