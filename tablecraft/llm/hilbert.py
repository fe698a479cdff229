"""Places along a Hilbert curve, interval bounds of inner products, and exact tops of a block."""

from __future__ import annotations

import numpy as np

#: Whole numbers below this are exact as doubles.
EXACT = 2**53


def places(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of ``cells`` (whole numbers below 2^bits), as uint64.

    Dimensions times bits must be 64 at most. By Skilling's transformation: the bits of
    each level are rotated and reflected as the curve turns, and then read as a Gray code.
    """
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    if dims * bits > 64:
        raise ValueError("dimensions times bits must be 64 at most")
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        high = one << np.uint64(level)
        low = high - one
        for k in range(dims):
            turned = (x[k] & high) != 0
            swap = np.where(turned, np.uint64(0), (x[0] ^ x[k]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[k] ^= swap
    for k in range(1, dims):
        x[k] ^= x[k - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        high = one << np.uint64(level)
        flip = np.where(x[-1] & high, flip ^ (high - one), flip)
    x ^= flip
    place = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for k in range(dims):
            place = (place << one) | (x[k] >> np.uint64(level) & one)
    return place


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers; by doubles where they are exact, else by long numbers."""
    reach = a.shape[1] * _reach(a) * _reach(b)
    if reach < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if reach < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise OverflowError("scores do not fit 64 bits")


def _reach(a: np.ndarray) -> int:
    return max(abs(int(a.max())), abs(int(a.min())), 1) if a.size else 1


def bounds(anchors: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the inner products of anchors with all vectors inside boxes.

    One row per anchor and column per box; a box is given by the least and the greatest
    value of every dimension. By intervals: a positive factor takes the greatest value
    to its upper bound, a negative one the least.
    """
    above, below = np.maximum(anchors, 0), np.minimum(anchors, 0)
    lower = _product(above, least) + _product(below, most)
    upper = _product(above, most) + _product(below, least)
    return lower, upper


def scores(anchors: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return _product(anchors, vectors)


def first_of(query: np.ndarray, score: np.ndarray, ident: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    """Places of the first ``n`` entries of each query, by falling score, ties by smaller id."""
    order = np.lexsort((ident, -score, query))
    sorted_query = query[order]
    starts = np.searchsorted(sorted_query, sorted_query)
    rank = np.arange(len(order)) - starts
    return order[rank < n]
