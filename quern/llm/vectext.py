"""Vectorised text kernels over UTF-8 bytes: word spans, XXH64 of many spans, n-gram keys.

All of them work on groups of whole documents of about a megabyte, so that their numpy
temporaries stay small however many rows an Arrow batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

GROUP_BYTES = 1 << 20
_BLOCK = 1 << 17

# XXH64's primes (fixed values of the published algorithm).
_P1 = np.uint64(11400714785074694791)
_P2 = np.uint64(14029467366897019727)
_P3 = np.uint64(1609587929392839161)
_P4 = np.uint64(9650029242287828579)
_P5 = np.uint64(2870177450012600261)

#: ``[\x20\x09-\x0D]``, what bytes.split() splits at.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: UTF-8 bytes that begin a code point.
IS_LEAD = (np.arange(256) & 0xC0) != 0x80


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column's UTF-8, null as empty, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def groups(sizes: list[int], most: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about ``most``; a larger row comes alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


class Lanes:
    """The little-endian 8-byte word that begins at each byte of a buffer."""

    def __init__(self, data: bytes):
        self.data = data
        padded = data + bytes(8)
        self.words = np.ascontiguousarray(np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,)))


def xxh64(lanes: Lanes, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each span ``data[start:end]``, in blocks."""
    out = np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), _BLOCK):
        out[i : i + _BLOCK] = _xxh64(lanes, starts[i : i + _BLOCK], ends[i : i + _BLOCK], seed)
    return out


def _xxh64(lanes: Lanes, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    words, size = lanes.words, ends - starts
    h = np.full(len(starts), (seed + int(_P5)) % (1 << 64), np.uint64)
    pos = starts.copy()
    wide = np.flatnonzero((size >= 32) & (size < 512))
    if len(wide):
        s, n = starts[wide], size[wide]
        p1, p2 = int(_P1), int(_P2)
        acc = [np.full(len(wide), v % (1 << 64), np.uint64) for v in (seed + p1 + p2, seed + p2, seed, seed - p1)]
        for k in range(int(n.max()) // 32):
            on = np.flatnonzero(n >= 32 * (k + 1))
            at = s[on] + 32 * k
            for j in range(4):
                acc[j][on] = _round(acc[j][on], words[at + 8 * j])
        merged = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            merged = (merged ^ _round(np.zeros_like(a), a)) * _P1 + _P4
        h[wide] = merged
        pos[wide] += n // 32 * 32
    h += size.astype(np.uint64)
    left = ends - pos
    for k in range(3):
        on = np.flatnonzero(left >= 8)
        if not len(on):
            break
        h[on] = _rotl(h[on] ^ _round(np.zeros(len(on), np.uint64), words[pos[on]]), 27) * _P1 + _P4
        pos[on] += 8
        left[on] -= 8
    on = np.flatnonzero((left >= 4) & (left < 8))
    h[on] = _rotl(h[on] ^ ((words[pos[on]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    pos[on] += 4
    left[on] -= 4
    for k in range(3):
        on = np.flatnonzero((left >= 1) & (left < 4))
        if not len(on):
            break
        h[on] = _rotl(h[on] ^ ((words[pos[on]] & np.uint64(0xFF)) * _P5), 11) * _P1
        pos[on] += 1
        left[on] -= 1
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(size >= 512):
        h[i] = xxhash.xxh64_intdigest(lanes.data[starts[i] : ends[i]], seed=seed)
    return h


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a group of texts, in one buffer.

    ``start`` and ``end`` are byte spans in ``buf``; ``first[d]:first[d + 1]`` are the words
    of text d.
    """

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts)
        self.buf = np.frombuffer(self.data, np.uint8)
        space = np.ones(len(self.buf) + 2, bool)
        space[1:-1] = IS_SPACE[self.buf]
        edge = np.flatnonzero(space[1:] != space[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_start = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.start, self.text_start)
        self.first[-1] = len(self.start)
        self.count = np.diff(self.first)
        self.of = np.repeat(np.arange(len(texts)), self.count)

    def hashes(self) -> np.ndarray:
        return xxh64(Lanes(self.data), self.start, self.end)

    def code_points(self) -> np.ndarray:
        """Code points of each word."""
        lead = np.concatenate(([0], np.cumsum(IS_LEAD[self.buf], dtype=np.int64)))
        return lead[self.end] - lead[self.start]


class Rolling:
    """Rolling keys of runs of words: a polynomial in an odd base, modulo 2^64, of their hashes.

    With the sums of all words before each place, the key of any run is one subtraction and one
    product, whatever its length; it depends on the run's words alone.  Runs over text borders
    get keys too; the caller masks those.
    """

    def __init__(self, word_hashes: np.ndarray):
        size = len(word_hashes)
        powers = np.ones((2, size + 1), np.uint64)
        for row, base in zip(powers, (int(_P1), pow(int(_P1), -1, 1 << 64)), strict=True):
            row[1:] = base
            np.multiply.accumulate(row, out=row)
        self.back = powers[1]
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(word_hashes * powers[0][:size], dtype=np.uint64)))

    def keys(self, n: int, at: np.ndarray | None = None) -> np.ndarray:
        """The keys of the runs of n words from each position of ``at`` (None: from all)."""
        if at is None:
            at = slice(0, max(0, len(self.sums) - n))
            key = (self.sums[n:] - self.sums[: len(self.sums) - n]) * self.back[at] if len(self.sums) > n else np.empty(0, np.uint64)
        else:
            key = (self.sums[at + n] - self.sums[at]) * self.back[at]
        key ^= key >> np.uint64(29)
        key *= _P2
        return key ^ (key >> np.uint64(32))
