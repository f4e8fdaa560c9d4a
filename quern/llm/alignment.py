"""Smith-Waterman local alignment of word sequences, a row at a time in numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

MATCH, MISMATCH, GAP = 2, -1, -1


class Alignment(NamedTuple):
    """score is the part, 0 to 1, of what an exact copy of the whole item would score;
    start:end is the aligned part of the text, in words."""

    score: float
    start: int
    end: int


def smith_waterman(item: np.ndarray, text: np.ndarray) -> Alignment:
    """The best local alignment of ``item`` in ``text`` (arrays of word keys)."""
    n, m = len(item), len(text)
    if not n or not m:
        return Alignment(0.0, 0, 0)
    if m >= n:
        for at in np.flatnonzero(text[: m - n + 1] == item[0]):
            if np.array_equal(text[at : at + n], item):
                return Alignment(1.0, int(at), int(at) + n)
    columns = np.arange(m + 1)
    above, came = np.zeros(m + 1, np.int64), columns.copy()  # scores, and where each began
    best, span = 0, (0, 0)
    for word in item:
        diagonal = above[:-1] + np.where(text == word, MATCH, MISMATCH)
        up = above[1:] + GAP
        row, start = np.zeros(m + 1, np.int64), columns.copy()
        take = diagonal >= up
        row[1:] = np.maximum(np.where(take, diagonal, up), 0)
        start[1:] = np.where(row[1:] > 0, np.where(take, came[:-1], came[1:]), columns[1:])
        # Gaps in the item: the best of all columns to the left, less a gap for each step.
        lifted = row - GAP * columns
        reach = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == reach, columns, 0))
        row, start = reach + GAP * columns, start[source]
        end = int(row.argmax())
        if row[end] > best:
            best, span = int(row[end]), (int(start[end]), end)
        above, came = row, start
    return Alignment(best / (MATCH * n), *span)
