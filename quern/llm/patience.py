"""Patience alignment of two word sequences."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np


def rising(places: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence."""
    piles: list[int] = []
    tops: list[int] = []
    below = [-1] * len(places)
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        below[i] = piles[k - 1] if k else -1
        if k == len(piles):
            piles.append(i)
            tops.append(p)
        else:
            piles[k], tops[k] = i, p
    out, i = [], piles[-1] if piles else -1
    while i != -1:
        out.append(i)
        i = below[i]
    return out[::-1]


def align(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Matching positions (i, j), rising in both.

    Equal ends are matched; between them words that occur once in each part are anchors if
    they lie on a longest increasing subsequence; the gaps between anchors are aligned in the
    same way.  A gap without such words stays unmatched.
    """
    x, y = a.tolist(), b.tolist()
    pairs: list[tuple[int, int]] = []
    gaps = [(0, len(x), 0, len(y))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and x[a0] == y[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and x[a1 - 1] == y[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once: dict[int, list[int]] = {}
        for i in range(a0, a1):
            once.setdefault(x[i], [0, 0, i, 0])[0] += 1
        for j in range(b0, b1):
            if x_seen := once.get(y[j]):
                x_seen[1] += 1
                x_seen[3] = j
        anchors = sorted((i, j) for n, m, i, j in once.values() if n == m == 1)
        if not anchors:
            continue
        at = [anchors[k] for k in rising([j for _, j in anchors])]
        pairs += at
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *at], [*at, (a1, b1)], strict=True):
            gaps.append((i + 1, k, j + 1, m))
    return sorted(pairs)
