"""Karmarkar-Karp differencing for any number of shards."""

from __future__ import annotations

import heapq
from collections.abc import Sequence


def difference(parts: Sequence[Sequence[int]], shards: int) -> list[list[int]]:
    """The shard of every entry of every partial partition in ``parts``.

    A part has at most ``shards`` entries, which stay in different shards; a single
    group is a part of one entry. The two parts with the largest spread (largest sum
    less smallest, 0 if a shard is empty) are combined again and again, the largest
    sums of one with the smallest of the other. Ties go by order of creation.
    """
    first = [0]
    for part in parts:
        first.append(first[-1] + len(part))
    follower = [-1] * first[-1]
    # A partial partition: (sum, first entry, last entry) by falling sum; missing ones are 0.
    heap: list[tuple[int, int, list[tuple[int, int, int]]]] = []

    def push(slots: list[tuple[int, int, int]], number: int) -> None:
        slots.sort(key=lambda s: (-s[0], s[1]))
        low = slots[-1][0] if len(slots) == shards else 0
        heapq.heappush(heap, (low - slots[0][0], number, slots))

    number = 0
    for at, part in zip(first, parts):
        if len(part) > shards:
            raise ValueError(f"a part of {len(part)} entries for {shards} shards")
        if part:
            push([(size, at + k, at + k) for k, size in enumerate(part)], number)
            number += 1
    while len(heap) > 1:
        *_, a = heapq.heappop(heap)
        *_, b = heapq.heappop(heap)
        both = max(0, len(a) + len(b) - shards)
        joined = a[: len(a) - both] + b[: len(b) - both]
        for k in range(both):
            x, y = a[len(a) - both + k], b[len(b) - 1 - k]
            follower[x[2]] = y[1]
            joined.append((x[0] + y[0], x[1], y[2]))
        push(joined, number)
        number += 1
    shard_of = [0] * first[-1]
    for shard, (_, entry, _) in enumerate(heap[0][2] if heap else []):
        while entry >= 0:
            shard_of[entry] = shard
            entry = follower[entry]
    return [shard_of[a:b] for a, b in zip(first, first[1:])]
