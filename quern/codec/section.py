"""Sections: headers, checksums, compression, sealing, and the section index."""

from __future__ import annotations

import hashlib
import lzma
import struct
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import xxhash

from quern.model import HEADER_BYTES, MAGIC, OFFSET_BITS, SECTION_TYPES, VERSIONS, ImageError

_HEAD = struct.Struct("<6sBB32s8sIHHQ")
_CHECKED = struct.Struct("<IHHQ")
NONE, LZMA, ZSTD, LZ4, LZ4HC = 0, 1, 2, 3, 4
BLOCK, SCHEMA, METADATA, INDEX, HISTORY = 0, 7, 8, 9, 10
#: Reads ``size`` bytes at ``offset``.
ReadAt = Callable[[int, int], bytes]


@dataclass(frozen=True)
class Header:
    number: int
    type: int
    algo: int
    size: int
    fast: bytes = bytes(8)
    slow: bytes = bytes(32)
    version: tuple[int, int] = (2, 5)

    def pack(self) -> bytes:
        return _HEAD.pack(MAGIC, *self.version, self.slow, self.fast, self.number, self.type, self.algo, self.size)

    def checked(self) -> bytes:
        return _CHECKED.pack(self.number, self.type, self.algo, self.size)


def parse_header(data: bytes) -> Header:
    if len(data) < HEADER_BYTES:
        raise ImageError("eof", "section header ends early")
    magic, major, minor, slow, fast, number, kind, algo, size = _HEAD.unpack(data[:HEADER_BYTES])
    if magic != MAGIC or not VERSIONS[0] <= (major, minor) <= VERSIONS[-1]:
        raise ImageError("unsupported_version", f"unsupported image {magic!r} {major}.{minor}")
    return Header(number, kind, algo, size, fast, slow, (major, minor))


def fast_hash(header: Header, payload: bytes) -> bytes:
    """XXH3-64 of the header's end and the payload, little-endian."""
    return xxhash.xxh3_64_digest(header.checked() + payload)[::-1]


def slow_hash(header: Header, fast: bytes, payload: bytes) -> bytes:
    """SHA-512/256 from the fast hash on."""
    return hashlib.new("sha512_256", fast + header.checked() + payload).digest()


def verify(header: Header, payload: bytes, how: str = "fast") -> None:
    """``how`` is fast, slow (both) or none."""
    if how != "none" and fast_hash(header, payload) != header.fast:
        raise ImageError("checksum", f"fast checksum of section {header.number} differs")
    if how == "slow" and slow_hash(header, header.fast, payload) != header.slow:
        raise ImageError("checksum", f"slow checksum of section {header.number} differs")


def compress(data: bytes, algo: int, level: int | None = None) -> bytes:
    if algo == NONE:
        return data
    if algo == ZSTD:
        import zstandard

        return zstandard.ZstdCompressor(level=3 if level is None else level).compress(data)
    if algo == LZMA:
        return lzma.compress(data, lzma.FORMAT_XZ, lzma.CHECK_CRC64, preset=6 if level is None else level)
    if algo in (LZ4, LZ4HC):
        return struct.pack("<I", len(data)) + pa.Codec("lz4_raw").compress(data, asbytes=True)
    raise ImageError("unsupported_compression", f"cannot compress with algorithm {algo}")


def decompress(data: bytes, algo: int, limit: int) -> bytes:
    if algo == NONE:
        out = data
    elif algo == ZSTD:
        stream = pa.CompressedInputStream(pa.BufferReader(data), "zstd")
        out = stream.read(limit + 1)
    elif algo == LZMA:
        out = lzma.LZMADecompressor(lzma.FORMAT_XZ).decompress(data, limit + 1)
    elif algo in (LZ4, LZ4HC):
        size = struct.unpack("<I", data[:4])[0]
        if size > limit:
            raise ImageError("size_limit", f"section is larger than {limit} bytes")
        out = pa.Codec("lz4_raw").decompress(data[4:], size, asbytes=True)
    else:
        raise ImageError("unsupported_compression", f"unsupported compression algorithm {algo}")
    if len(out) > limit:
        raise ImageError("size_limit", f"section is larger than {limit} bytes")
    return out


def seal(number: int, kind: int, payload: bytes, algo: int = NONE, level: int | None = None) -> bytes:
    """Header and payload; stored as is if compression does not fit into the payload's size."""
    packed = compress(payload, algo, level)
    if len(packed) > len(payload):
        algo, packed = NONE, payload
    bare = Header(number, kind, algo, len(packed))
    fast = fast_hash(bare, packed)
    return Header(number, kind, algo, len(packed), fast, slow_hash(bare, fast, packed)).pack() + packed


def read_header(read: ReadAt, offset: int) -> Header:
    return parse_header(read(offset, HEADER_BYTES))


def read_section(read: ReadAt, offset: int, limit: int, how: str = "fast") -> tuple[Header, bytes]:
    header = read_header(read, offset)
    if header.size > max(limit, HEADER_BYTES) and header.algo == NONE or header.size > 2 * limit + HEADER_BYTES:
        raise ImageError("size_limit", f"section {header.number} is larger than {limit} bytes")
    raw = read(offset + HEADER_BYTES, header.size)
    if len(raw) < header.size:
        raise ImageError("eof", f"section {header.number} ends early")
    verify(header, raw, how)
    return header, decompress(raw, header.algo, limit)


def pack_entry(kind: int, offset: int) -> int:
    if offset >= 1 << OFFSET_BITS:
        raise ImageError("offset", "a section begins beyond 2^48 bytes")
    return kind << OFFSET_BITS | offset


def unpack_entry(entry: int) -> tuple[int, int]:
    return entry >> OFFSET_BITS, entry & (1 << OFFSET_BITS) - 1


def scan_index(read: ReadAt, length: int, limit: int, start: int = 0) -> list[tuple[int, int]]:
    """(type, offset) of all sections, from header to header."""
    found, at = [], start
    while at < length:
        header = read_header(read, at)
        found.append((header.type, at - start))
        if 8 * len(found) > limit:
            raise ImageError("size_limit", f"section index is larger than {limit} bytes")
        at += HEADER_BYTES + header.size
    if at != length:
        raise ImageError("eof", "the last section ends early")
    return found


def embedded_index(read: ReadAt, length: int, limit: int, start: int = 0, how: str = "fast") -> list[tuple[int, int]] | None:
    """The index at the end of the image; None if there is none.  A wrong one is an error."""
    if read_header(read, start).version < (2, 4) or length - start < HEADER_BYTES + 8:
        return None
    kind, offset = unpack_entry(struct.unpack("<Q", read(length - 8, 8))[0])
    if kind != INDEX or start + offset + HEADER_BYTES > length:
        return None
    try:
        header = read_header(read, start + offset)
    except ImageError:
        return None
    count, odd = divmod(header.size, 8)
    if odd or start + offset + HEADER_BYTES + header.size != length or header.algo != NONE or header.type != INDEX or header.number != count - 1:
        return None
    if header.size > limit:
        raise ImageError("size_limit", f"section index is larger than {limit} bytes")
    payload = read(start + offset + HEADER_BYTES, header.size)
    verify(header, payload, "fast" if how == "none" else how)
    entries = [unpack_entry(e) for e in struct.unpack(f"<{count}Q", payload)]
    if any(k not in SECTION_TYPES for k, _ in entries):
        raise ImageError("section_index", "unknown section type in the section index")
    if any(b[1] <= a[1] for a, b in zip(entries, entries[1:], strict=False)):
        raise ImageError("section_index", "section offsets do not rise")
    return entries


def seal_index(entries: list[tuple[int, int]], offset: int) -> bytes:
    """The index section, its own entry included."""
    rows = [pack_entry(k, o) for k, o in entries] + [pack_entry(INDEX, offset)]
    return seal(len(rows) - 1, INDEX, struct.pack(f"<{len(rows)}Q", *rows))
