"""The metadata section: bit-packed columns read through a schema, by numpy.

A kind is "bool", "u32", "u64", "bytes", ("seq", kind), ("opt", kind), ("map", key, value) or
("struct", {name: kind}), fields numbered from 1 in order.  Sequences of numbers are arrays;
sequences of structs are dicts of arrays, a column for each field.
"""

from __future__ import annotations

from typing import Any

import numpy as np

from quern.codec.thrift import Layout, Schema
from quern.model import ImageError

_U32S = ("seq", "u32")
CHUNK = ("struct", {k: "u32" for k in ("block", "offset", "size")})
DIRECTORY = ("struct", {k: "u32" for k in ("parent_entry", "first_entry", "self_entry")})
INODE = ("struct", {k: "u32" for k in ("name_index", "mode_index", "inode", "owner_index", "group_index", "atime_offset", "mtime_offset", "ctime_offset")})
DIR_ENTRY = ("struct", {k: "u32" for k in ("name_index", "inode_num")})
OPTIONS = (
    "struct",
    {"mtime_only": "bool", "time_resolution_sec": ("opt", "u32"), "packed_chunk_table": "bool", "packed_directories": "bool", "packed_shared_files_table": "bool"},
)
STRINGS = ("struct", {"buffer": "bytes", "symtab": ("opt", "bytes"), "index": _U32S, "packed_index": "bool"})
SIZES = ("struct", {"lookup": ("map", "u32", "u64"), "min_chunk_count": "u64"})
#: The root, fields in the order of their numbers (fixed by the format).
METADATA = (
    "struct",
    {
        "chunks": ("seq", CHUNK),
        "directories": ("seq", DIRECTORY),
        "inodes": ("seq", INODE),
        "chunk_table": _U32S,
        "entry_table": _U32S,
        "symlink_table": _U32S,
        "uids": _U32S,
        "gids": _U32S,
        "modes": _U32S,
        "names": ("seq", "bytes"),
        "symlinks": ("seq", "bytes"),
        "timestamp_base": "u64",
        "chunk_inode_offset": "u32",
        "link_inode_offset": "u32",
        "block_size": "u32",
        "total_fs_size": "u64",
        "devices": ("opt", ("seq", "u64")),
        "options": ("opt", OPTIONS),
        "dir_entries": ("opt", ("seq", DIR_ENTRY)),
        "shared_files_table": ("opt", _U32S),
        "total_hardlink_size": ("opt", "u64"),
        "writer_version": ("opt", "bytes"),
        "create_timestamp": ("opt", "u64"),
        "compact_names": ("opt", STRINGS),
        "compact_symlinks": ("opt", STRINGS),
        "preferred_path_separator": ("opt", "u32"),
        "features": ("opt", ("seq", "bytes")),
        "category_names": ("opt", ("seq", "bytes")),
        "block_categories": ("opt", ("seq", "bytes")),
        "reg_file_size_cache": ("opt", SIZES),
    },
)
_WIDTH = {"bool": 1, "u32": 4, "u64": 8}
_NUMBERS = tuple(_WIDTH)


def _is(kind: Any, name: str) -> bool:
    return kind == name or isinstance(kind, tuple) and kind[0] == name


def padded(data: bytes) -> np.ndarray:
    return np.frombuffer(data + bytes(9), np.uint8)


def load_bits(data: bytes, at: np.ndarray, bits: int, raw: np.ndarray | None = None) -> np.ndarray:
    """Numbers of ``bits`` bits (1 to 64) that begin at the bit positions ``at``; ``raw`` is what
    ``padded`` makes of ``data``."""
    if not len(at) or not bits:
        return np.zeros(len(at), np.uint64)
    if bits > 64 or int(at.max()) + bits > 8 * len(data):
        raise ImageError("metadata", "bits location overflow")
    raw = padded(data) if raw is None else raw
    first, shift = at // 8, (at % 8).astype(np.uint64)
    low = np.zeros(len(at), np.uint64)
    for k in range(8):
        low |= raw[first + k].astype(np.uint64) << np.uint64(8 * k)
    value = low >> shift
    over = shift > 0
    value[over] |= raw[first[over] + 8].astype(np.uint64) << (np.uint64(64) - shift[over])
    return value & np.uint64((1 << bits) - 1)


class _Decoder:
    def __init__(self, schema: Schema, data: bytes):
        self.layouts, self.data, self.raw = schema.layouts, data, padded(data)

    def field(self, layout: Layout | None, at: np.ndarray, number: int) -> tuple[Layout | None, np.ndarray]:
        if layout is None or number not in layout.fields:
            return None, at
        target, offset = layout.fields[number]
        return self.layouts[target], at + (offset * 8 if offset >= 0 else -offset)

    def numbers(self, layout: Layout | None, at: np.ndarray, bits: int | None = None) -> np.ndarray:
        """A missing layout reads as zero."""
        if layout is None:
            return np.zeros(len(at), np.uint64)
        if layout.fields:
            raise ImageError("metadata", "a number has a layout with fields")
        return load_bits(self.data, at, layout.bits if bits is None else bits, self.raw)

    def values(self, kind: Any, layout: Layout | None, at: np.ndarray, base: int) -> Any:
        """Column of values of one kind whose inline parts begin at bits ``at``; distances
        count from byte ``base``."""
        if kind == "bool":
            return self.numbers(layout, at, 1).astype(bool)
        if kind in ("u32", "u64"):
            return self.numbers(layout, at)
        if _is(kind, "struct"):
            return {name: self.values(k, *self.field(layout, at, i), base) for i, (name, k) in enumerate(kind[1].items(), 1)}
        if _is(kind, "opt"):
            some = self.values("bool", *self.field(layout, at, 1), base)
            inner, place = self.field(layout, at, 2)
            return [self.one(kind[1], inner, int(p), base) if s else None for s, p in zip(some, place, strict=True)]
        starts = (self.numbers(*self.field(layout, at, 1)) + np.uint64(base)).tolist()
        counts = self.numbers(*self.field(layout, at, 2)).tolist()
        if kind == "bytes" and self.field(layout, at, 1)[0] is None:
            return [bytes(n) for n in counts]  # without a distance: all NUL
        if kind == "bytes":
            if any(s + n > len(self.data) for s, n in zip(starts, counts, strict=True)):
                raise ImageError("metadata", "string offset or length overflow")
            return [self.data[s : s + n] for s, n in zip(starts, counts, strict=True)]
        element = self.layouts[layout.fields[3][0]] if layout and 3 in layout.fields else None
        return [self.sequence(kind, element, s, n) for s, n in zip(starts, counts, strict=True)]

    def sequence(self, kind: Any, element: Layout | None, start: int, count: int) -> Any:
        stride = element.bits if element else 0
        if stride and start * 8 + stride * count > 8 * len(self.data) or not stride and count > 1 << 32:
            raise ImageError("metadata", "collection overflow")
        at = start * 8 + stride * np.arange(count, dtype=np.int64)
        if _is(kind, "map"):
            pairs = self.values(("struct", {"key": kind[1], "value": kind[2]}), element, at, start)
            return dict(zip(*(list(map(int, pairs[k])) for k in ("key", "value")), strict=True))
        return self.values(kind[1], element, at, start)

    def one(self, kind: Any, layout: Layout | None, at: int, base: int) -> Any:
        column = self.values(kind, layout, np.array([at], np.int64), base)
        if _is(kind, "struct"):
            return {k: v[0] for k, v in column.items()}
        return column[0]


def decode(schema: Schema, data: bytes, kind: Any = METADATA) -> dict[str, Any]:
    return _Decoder(schema, data).one(kind, schema.layouts[schema.root], 0, 0)


# Writing: a plan holds what the widest value needs; parts that are always zero take no room.


class _Plan:
    def __init__(self) -> None:
        self.width, self.parts, self.element = 0, [], None  # element: of a sequence

    def close(self) -> int:
        if self.parts:
            self.width = sum(p.close() for p in self.parts)
        if self.element is not None and self.width:
            self.element.close()
        return self.width


def _plan(kind: Any, columns: Any, plan: _Plan) -> None:
    """Widen ``plan`` for a column of values."""
    if kind in _NUMBERS:
        if np.any(np.asarray(columns, np.uint64)):
            plan.width = _WIDTH[kind]
        return
    count = {"struct": len(kind[1]) if _is(kind, "struct") else 0, "opt": 2}.get(kind[0] if isinstance(kind, tuple) else kind, 2)
    while len(plan.parts) < count:
        plan.parts.append(_Plan())
    if _is(kind, "struct"):
        for part, (name, k) in zip(plan.parts, kind[1].items(), strict=True):
            _plan(k, columns[name], part)
    elif _is(kind, "opt"):
        some = [v for v in columns if v is not None]
        _plan("bool", [v is not None for v in columns], plan.parts[0])
        for v in some:
            _plan(kind[1], _column(kind[1], v), plan.parts[1])
    else:
        plan.element = plan.element or _Plan()
        for v in columns:
            size = _length(kind, v)
            _plan("u32", [size], plan.parts[1])
            if kind == "bytes":
                plan.element.width |= int(any(v))
            else:
                _plan(_item(kind), _items(kind, v), plan.element)
        plan.element.close()
        _plan("u32", [plan.element.width], plan.parts[0])


def _column(kind: Any, value: Any) -> Any:
    return {k: _column(t, value[k]) for k, t in kind[1].items()} if _is(kind, "struct") else [value]


def _item(kind: Any) -> Any:
    return ("struct", {"key": kind[1], "value": kind[2]}) if _is(kind, "map") else kind[1]


def _items(kind: Any, value: Any) -> Any:
    return {"key": sorted(value), "value": [value[k] for k in sorted(value)]} if _is(kind, "map") else value


def _length(kind: Any, value: Any) -> int:
    if _is(kind, "seq") and isinstance(value, dict):
        return len(next(iter(value.values())))
    return len(value)


class _Encoder:
    def __init__(self) -> None:
        self.out = bytearray()

    def put(self, kind: Any, columns: Any, plan: _Plan, at: int, stride: int, base: int, count: int) -> None:
        """Write a column of ``count`` values, ``stride`` bytes apart from byte ``at``."""
        if not plan.width:
            return
        if kind in _NUMBERS:
            raw = np.asarray(columns, np.uint64).astype(f"<u{plan.width}").view(np.uint8).reshape(count, plan.width)
            room = np.ndarray((count, plan.width), np.uint8, self.out, at, (stride, 1))
            room[:] = raw
            del room  # else the buffer can't grow
            return
        if _is(kind, "struct"):
            for part, (name, k) in zip(plan.parts, kind[1].items(), strict=True):
                self.put(k, columns[name], part, at, stride, base, count)
                at += part.width
            return
        for i in range(count):
            place, value = at + i * stride, columns[i]
            first, second = plan.parts
            if _is(kind, "opt"):
                self.put("bool", [value is not None], first, place, first.width, base, 1)
                if value is not None:
                    self.put(kind[1], _column(kind[1], value), second, place + first.width, max(second.width, 1), base, 1)
                continue
            size, start = _length(kind, value), len(self.out)
            self.put("u32", [start - base], first, place, first.width, base, 1)
            self.put("u32", [size], second, place + first.width, second.width, base, 1)
            if kind == "bytes":
                self.out += value if first.width else b""
            elif plan.element.width:
                self.out += bytes(size * plan.element.width)
                self.put(_item(kind), _items(kind, value), plan.element, start, plan.element.width, start, size)


def _layouts(plan: _Plan, schema: Schema, seen: dict) -> int:
    fields, offset = {}, 0
    for number, part in enumerate(plan.parts, 1):
        if part.width:
            fields[number] = (_layouts(part, schema, seen), offset)
            offset += part.width
    if plan.element is not None and plan.element.width and plan.parts[0].width:
        if plan.element.width > 1 or plan.element.parts or plan.element.element is not None:
            fields[3] = (_layouts(plan.element, schema, seen), 0)
    key = (plan.width, tuple(sorted(fields.items())))
    if key not in seen:
        seen[key] = len(seen)
        schema.layouts[seen[key]] = Layout(plan.width, plan.width * 8, fields)
    return seen[key]


def encode(value: dict[str, Any], kind: Any = METADATA) -> tuple[Schema, bytes]:
    plan = _Plan()
    _plan(kind, _column(kind, value), plan)
    plan.close()
    encoder = _Encoder()
    encoder.out += bytes(plan.width)
    encoder.put(kind, _column(kind, value), plan, 0, plan.width, 0, 1)
    schema = Schema()
    schema.root = _layouts(plan, schema, {})
    return schema, bytes(encoder.out)


def empty() -> dict[str, Any]:
    """A value of METADATA with nothing in it."""
    blank = lambda k: (
        {"bool": False, "u32": 0, "u64": 0, "bytes": b""}[k]
        if isinstance(k, str)
        else None if k[0] == "opt"
        else {} if k[0] == "map"
        else {n: blank(t) for n, t in k[1].items()} if k[0] == "struct"
        else {n: np.zeros(0, np.uint64) for n in k[1][1]} if _is(k[1], "struct")
        else []
    )
    return blank(METADATA)
