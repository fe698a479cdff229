"""SimHash fingerprints and their exact comparison, with numpy inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

SHINGLE = 4
SEED = 42
BITS = 64
RADIUS = 4
#: Rows of fingerprints compared at once.
TILE = 1024

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half the hashes of all shingles, repeats included.

    Words are runs of bytes other than space and U+0009 to U+000D, with A to Z in
    lower case. Fewer words than a shingle give one shingle of all; none give 0.
    """
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    width = min(shingle, n)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    view, hashed = memoryview(line), xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (hashed(view[a:b], SEED) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist())),
        np.uint64,
        n - width + 1,
    )
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > len(hashes)).tobytes(), "big")


def close_pairs(
    left: np.ndarray, right: np.ndarray, same: bool, radius: int = RADIUS
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i in left, j in right) of fingerprints that differ in at most ``radius`` bits.

    Both sides are uint64, sorted by their number of set bits. Tiles are skipped if
    their numbers of set bits are further apart than the radius, as two fingerprints
    differ in at least that many bits. With ``same`` both sides are one table, and
    each pair is given once.
    """
    left_bits, right_bits = np.bitwise_count(left), np.bitwise_count(right)
    for i in range(0, len(left), TILE):
        a, low, high = left[i : i + TILE], left_bits[i], left_bits[min(i + TILE, len(left)) - 1]
        for j in range(i if same else 0, len(right), TILE):
            b = right[j : j + TILE]
            first, last = right_bits[j], right_bits[min(j + TILE, len(right)) - 1]
            if int(first) - int(high) > radius:
                break
            if int(low) - int(last) > radius:
                continue
            near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
            if same and i == j:
                near = np.triu(near, 1)
            x, y = np.nonzero(near)
            if len(x):
                yield x + i, y + j


class Forest:
    """Union-find over places 0 to n-1; keeps only the links that join two trees."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def add(self, xs: np.ndarray, ys: np.ndarray) -> None:
        for x, y in zip(xs.tolist(), ys.tolist()):
            a, b = self.root(x), self.root(y)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                self.links.append((x, y))
