"""Sets of word n-grams as numbers in one global order, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
#: The global order is kept by slots of n-gram hashes; a slot is the leading bits of a hash.
SLOT_BITS = 17
SLOTS = 1 << SLOT_BITS
_REST = np.uint64(64 - SLOT_BITS)
_REST_MASK = np.uint64((1 << (64 - SLOT_BITS)) - 1)

#: Two sets are linked when SHARE_OF * shared >= SHARE * all of both.
SHARE, SHARE_OF = 80, 100

_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of x on every bit of the result, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Powers of the bases, as far as texts have needed them.
_POWERS: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    held = _POWERS.get(int(base))
    if held is None or len(held) < n:
        steps = np.full(1 << max(12, (n - 1).bit_length()), base, np.uint64)
        steps[0] = 1
        held = _POWERS[int(base)] = np.cumprod(steps)
    return held[:n]


def hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the n-grams of a text, in rising order.

    Words are runs of bytes other than space and U+0009 to U+000D, with A to Z in lower
    case. Fewer words than ``shingle`` are one n-gram; no words give no hash. A word's
    hash is a polynomial of its bytes, an n-gram's a sum of its words' with a factor for
    the place.
    """
    data = _LOWER[np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)]
    space = _SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64)
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=running[1:])
    words = (running[ends] - running[starts]) * _power(_INVERSE, len(data) + 1)[starts]
    words = _mixed(words + (ends - starts).astype(np.uint64))
    width = min(shingle, n)
    found = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        found += words[k : n - width + 1 + k] * np.uint64((0xD6E8FEB86659FD93 * (2 * k + 3)) % (1 << 64) | 1)
    return np.unique(_mixed(found + np.uint64(width)))


def slots(found: np.ndarray) -> np.ndarray:
    return (found >> _REST).astype(np.int64)


def ranks(counts: np.ndarray) -> np.ndarray:
    """Place of every slot in the global order: slots with few n-grams first, ties by number."""
    order = np.lexsort((np.arange(SLOTS), counts))
    out = np.empty(SLOTS, np.uint64)
    out[order] = np.arange(SLOTS, dtype=np.uint64)
    return out


def ordered(found: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """N-grams as numbers whose order is the global order, in that order; one number per hash."""
    return np.sort((rank[slots(found)] << _REST) | (found & _REST_MASK))


def cuts(counts: np.ndarray, fragments: int) -> np.ndarray:
    """Borders that cut the global order into ``fragments`` of about equally many n-grams."""
    running = np.cumsum(np.sort(counts))
    wanted = running[-1] * np.arange(1, fragments) // fragments
    return np.searchsorted(running, wanted, "right").astype(np.uint64) << _REST


def prefix(n: int) -> int:
    """How many first n-grams of a set of n any set linked with it must share one of."""
    return n - (SHARE * n + SHARE_OF - 1) // SHARE_OF + 1 if n else 0


def least_shared(total: int | np.ndarray) -> int | np.ndarray:
    """The least number of shared n-grams that links two sets of ``total`` n-grams together."""
    return (SHARE * total + SHARE + SHARE_OF - 1) // (SHARE + SHARE_OF)


def parity(found: np.ndarray) -> np.ndarray:
    """A bitmap in which every n-gram flips one bit, as uint64 words; twice as many bits as n-grams, or more.

    Two bitmaps differ in at most as many bits as the sets differ in n-grams.
    """
    bits = 1 << max(7, (2 * len(found) - 1).bit_length())
    flips = np.bincount((_mixed(found) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bitmaps: np.ndarray) -> np.ndarray:
    """Bitmaps of half as many bits that the same sets would have."""
    half = bitmaps.shape[1] // 2
    return bitmaps[:, :half] ^ bitmaps[:, half:]


def name(numbers: np.ndarray) -> int:
    """64 bits that stand for a set given in order."""
    return xxhash.xxh3_64_intdigest(numbers.tobytes())


def close_pairs(
    sizes: np.ndarray, bitmaps: list[np.ndarray], groups: np.ndarray, side: np.ndarray | None = None, tile: int = 256
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, most shared) of sets of different groups that bitmaps and sizes do not rule out.

    No linked pair is missed. With ``side`` only pairs of different sides are compared.
    """
    widths = np.array([len(b) for b in bitmaps])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # Sizes of linked sets are so close that their bitmaps are equally wide, or one twice the other.
    level = {w: np.flatnonzero(widths == w) for w in np.unique(widths).tolist()}
    maps = {w: np.stack([bitmaps[k] for k in own]) for w, own in level.items()}
    for width, own in level.items():
        own_order = own[np.argsort(sizes[own], kind="stable")]
        mine = maps[width][np.argsort(sizes[own], kind="stable")]
        for other in (width, 2 * width):
            if other not in level:
                continue
            same = other == width
            their_sort = np.argsort(sizes[level[other]], kind="stable")
            their, theirs = level[other][their_sort], maps[other][their_sort]
            theirs = theirs if same else folded(theirs)
            for a in range(0, len(own_order), tile):
                i, x = own_order[a : a + tile], mine[a : a + tile]
                for b in range(a if same else 0, len(their), tile):
                    j, y = their[b : b + tile], theirs[b : b + tile]
                    if SHARE * int(sizes[j[0]]) > SHARE_OF * int(sizes[i[-1]]):
                        break
                    if SHARE * int(sizes[i[0]]) > SHARE_OF * int(sizes[j[-1]]):
                        continue
                    differ = np.zeros((len(i), len(j)), np.int64)
                    for w in range(0, width, 16):
                        differ += np.bitwise_count(x[:, None, w : w + 16] ^ y[None, :, w : w + 16]).sum(2, dtype=np.int64)
                    total = sizes[i][:, None] + sizes[j][None, :]
                    shared = np.minimum((total - differ) // 2, np.minimum(sizes[i][:, None], sizes[j][None, :]))
                    fits = (shared >= least_shared(total)) & (groups[i][:, None] != groups[j][None, :])
                    if side is not None:
                        fits &= side[i][:, None] != side[j][None, :]
                    if same and a == b:
                        fits = np.triu(fits, 1)
                    p, q = np.nonzero(fits)
                    if len(p):
                        out.append((i[p], j[q], shared[p, q]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*out))
