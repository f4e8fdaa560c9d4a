"""Karmarkar-Karp multiway differencing in numpy."""

from __future__ import annotations

import heapq

import numpy as np


def partition(sizes: np.ndarray, k: int) -> list[list[int]]:
    """Deal items of the given positive sizes into k sets of near-equal sums.

    Every item begins as a partial partition with one loaded set.  The two partial partitions
    of the largest imbalance are merged, the heaviest set of one with the lightest of the
    other, until one is left.  A partial partition keeps only its loaded sets, heaviest first,
    less what all k have in common; its members are chains in ``after``.
    """
    n = len(sizes)
    if n <= k:
        return [[i] for i in range(n)] + [[] for _ in range(k - n)]
    after = np.full(n, -1, np.int64)
    heap = [(-int(s), i, np.array([s]), np.array([i]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, a, a_head, a_tail = heapq.heappop(heap)
        _, _, b, b_head, b_tail = heapq.heappop(heap)
        both = max(0, len(a) + len(b) - k)  # sets that are loaded in either
        load = np.concatenate((a, b[::-1][both:]))
        head, tail = np.concatenate((a_head, b_head[::-1][both:])), np.concatenate((a_tail, b_tail[::-1][both:]))
        if both:
            at = slice(len(a) - both, len(a))
            load[at] += b[::-1][:both]
            after[tail[at]] = b_head[::-1][:both]
            tail[at] = b_tail[::-1][:both]
        by = np.argsort(-load, kind="stable")
        load, head, tail = load[by], head[by], tail[by]
        low = load[-1] if len(load) == k else 0
        load = load - low
        heapq.heappush(heap, (-int(load[0] - (load[-1] if len(load) == k else 0)), order, load, head, tail))
        order += 1
    _, _, _, head, _ = heap[0]
    sets = []
    for i in head:
        members = []
        while i != -1:
            members.append(int(i))
            i = after[i]
        sets.append(members)
    return sets


def pack(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Sets of sums up to ``capacity``; the number of sets rises until all fit."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        sets = partition(sizes, k)
        if max(int(sizes[s].sum()) for s in sets) <= capacity:
            return sets
        k += 1
