"""Content-defined chunking by a Rabin fingerprint over a 64-byte window, in numpy.

The fingerprint is linear over GF(2): that of a window is the XOR of a table entry for each
of its bytes.  All windows of a buffer are computed at once; only the choice of cuts walks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WINDOW, MASK, MIN_CHUNK, MAX_CHUNK = 64, 0x7FF, 64, 64 << 10
#: An irreducible polynomial of degree 53, long published with another chunking library (a
#: parameter of the method, not of the format).
POLYNOMIAL = 0x3DA3358B4DC173
_DEGREE = POLYNOMIAL.bit_length() - 1


def _mod(value: int) -> int:
    while value.bit_length() > _DEGREE:
        value ^= POLYNOMIAL << (value.bit_length() - 1 - _DEGREE)
    return value


def _tables() -> np.ndarray:
    """[k, b]: the contribution of byte b that is k bytes from the window's end."""
    table = np.zeros((WINDOW, 256), np.uint64)
    for k in range(WINDOW):
        single = [_mod(1 << (8 * k + j)) for j in range(8)]
        for j, s in enumerate(single):
            table[k, (np.arange(256) >> j & 1).astype(bool)] ^= np.uint64(s)
    return table


_TABLES = _tables()
#: The bits that decide a cut; as the fingerprint is linear, they need no others.
_LOW = (_TABLES & np.uint64(MASK)).astype(np.uint16)
_TWO = np.arange(1 << 16)
#: [j, later byte << 8 | earlier byte]: those bits of two bytes in a row, the later 2 j from the end.
_PAIRS = np.stack([_LOW[k][_TWO >> 8] ^ _LOW[k + 1][_TWO & 255] for k in range(0, WINDOW, 2)])
_SLICE, _GROUP = 1 << 18, 4 << 20
_GAP = bytes(WINDOW - 1)


def fingerprints(data: bytes, tables: np.ndarray = _TABLES) -> np.ndarray:
    """The fingerprint after each byte; before 64 bytes the window is filled with zeros."""
    padded = np.frombuffer(_GAP + data, np.uint8)
    out = np.zeros(len(data), tables.dtype)
    for k in range(WINDOW):
        out ^= tables[k][padded[WINDOW - 1 - k : WINDOW - 1 - k + len(data)]]
    return out


def _marked(data: np.ndarray) -> np.ndarray:
    """Places of ``data`` behind its first 63 bytes whose window asks for a cut."""
    size = len(data) - WINDOW + 1
    found = []
    for at in range(0, size, _SLICE):
        n = min(_SLICE, size - at)
        part = data[at : at + n + WINDOW - 1].astype(np.intp)
        both = part[1:] << 8 | part[:-1]
        low, more = np.zeros(n, np.uint16), np.empty(n, np.uint16)
        for j in range(WINDOW // 2):
            first = WINDOW - 2 - 2 * j
            np.take(_PAIRS[j], both[first : first + n], out=more, mode="clip")
            low ^= more
        found.append(np.flatnonzero(low == MASK) + at)
    return np.concatenate(found) if found else np.empty(0, np.int64)


def _walk(places: np.ndarray, size: int) -> list[int]:
    """Ends of the chunks of ``size`` bytes, from the places that ask for a cut."""
    ends, start = [], 0
    while True:
        # A cut at byte p leaves data[start:p]; it needs MIN_CHUNK bytes with byte p.
        i = int(np.searchsorted(places, start + MIN_CHUNK - 1))
        far = start + MAX_CHUNK - 1
        cut = min(int(places[i]) if i < len(places) else far, far)
        if cut >= size:
            break
        ends.append(cut)
        start = cut
    if start < size:
        ends.append(size)
    return ends


def cuts(contents: list[bytes]) -> Iterator[list[int]]:
    """Ends of the chunks of each content.  The byte that completes a cut begins the next chunk,
    so all but the last have 63 bytes to one less than the maximum; the window is not reset at a
    cut.  Contents are fingerprinted some megabytes at a time, parted by a window of zeros."""
    at = 0
    while at < len(contents):
        group, held = [], 0
        while at < len(contents) and (not group or held + len(contents[at]) <= _GROUP):
            group.append(contents[at])
            held += len(contents[at]) + len(_GAP)
            at += 1
        places = _marked(np.frombuffer(_GAP + _GAP.join(group), np.uint8))
        start = 0
        for content in group:
            low, high = np.searchsorted(places, (start, start + len(content)))
            yield _walk(places[low:high] - start, len(content))
            start += len(content) + len(_GAP)


def chunked(contents: list[bytes]) -> Iterator[list[bytes]]:
    """The chunks of each content."""
    for content, ends in zip(contents, cuts(contents), strict=True):
        yield [content[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def chunks(data: bytes) -> list[bytes]:
    return next(chunked([data]))
