"""FSST symbol tables: parse, write, decode."""

from __future__ import annotations

import struct

from quern.model import ImageError

# Fixed values of the format.
VERSION, MAX_SYMBOLS, MAX_LENGTH, ESCAPE = 20190218, 255, 8, 0xFF
#: Lengths in the order in which symbols are stored.
LENGTH_ORDER = (2, 3, 4, 5, 6, 7, 8, 1)
#: What an unused code stands for.
FILLER = b"corrupt"


def parse(data: bytes) -> list[bytes]:
    if len(data) < 17:
        raise ImageError("fsst", "symbol table ends early")
    version = struct.unpack("<Q", data[:8])[0]
    if version & 0xFF == 0:
        version = struct.unpack(">Q", data[:8])[0]
    if version >> 32 != VERSION:
        raise ImageError("fsst", "invalid magic")
    if data[8] & 1:
        raise ImageError("fsst", "zero-terminated mode is unsupported")
    symbols, at = [], 17
    for length in LENGTH_ORDER:
        for _ in range(data[8 + length]):
            if at + length > len(data):
                raise ImageError("fsst", "symbol table ends early")
            symbols.append(data[at : at + length])
            at += length
    if len(symbols) > MAX_SYMBOLS:
        raise ImageError("fsst", "too many symbols")
    return symbols


def to_bytes(symbols: list[bytes]) -> bytes:
    if len(symbols) > MAX_SYMBOLS:
        raise ImageError("fsst", "too many symbols")
    ranks = []
    for s in symbols:
        if not 1 <= len(s) <= MAX_LENGTH or 0 in s:
            raise ImageError("fsst", "invalid symbol")
        ranks.append(LENGTH_ORDER.index(len(s)))
    if ranks != sorted(ranks):
        raise ImageError("fsst", "symbols are not in the order of lengths")
    counts = bytes(sum(len(s) == n for s in symbols) for n in range(1, 9))
    return struct.pack("<QB", VERSION << 32 | 1, 0) + counts + b"".join(symbols)


def max_decoded(length: int) -> int:
    return MAX_LENGTH * length


def decode(symbols: list[bytes], data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        code = data[at]
        if code == ESCAPE:
            if at + 1 == len(data):
                raise ImageError("fsst", "input ends in an escape")
            out.append(data[at + 1 : at + 2])
            at += 2
        else:
            out.append(symbols[code] if code < len(symbols) else FILLER)
            at += 1
    return b"".join(out)


def encode(symbols: list[bytes], data: bytes) -> bytes:
    """Longest symbol first, other bytes escaped."""
    codes = {s: i for i, s in enumerate(symbols)}
    out, at = bytearray(), 0
    while at < len(data):
        for n in range(min(MAX_LENGTH, len(data) - at), 0, -1):
            if data[at : at + n] in codes:
                out.append(codes[data[at : at + n]])
                at += n
                break
        else:
            out += bytes((ESCAPE, data[at]))
            at += 1
    return bytes(out)


def train(samples: list[bytes], most: int = MAX_SYMBOLS) -> list[bytes]:
    """A table of the substrings that save most over the samples, for tests and small tables."""
    gain: dict[bytes, int] = {}
    for s in samples:
        for n in range(1, MAX_LENGTH + 1):
            for i in range(len(s) - n + 1):
                part = s[i : i + n]
                if 0 not in part:
                    gain[part] = gain.get(part, 0) + n
    best = sorted(gain, key=lambda p: (-gain[p], p))[:most]
    return sorted(best, key=lambda p: (LENGTH_ORDER.index(len(p)), p))
