"""The schema section: layouts in a subset of Thrift's compact protocol."""

from __future__ import annotations

from dataclasses import dataclass, field

from quern.model import ImageError

# Type tags of the compact protocol (fixed values).
TRUE, FALSE, I16, I32, BINARY, MAP, STRUCT = 1, 2, 4, 5, 8, 11, 12
FILE_VERSION = 1


@dataclass
class Layout:
    size: int = 0
    bits: int = 0
    fields: dict[int, tuple[int, int]] = field(default_factory=dict)  # id: (layout id, offset: bytes, or bits if negative)
    type_name: str = ""


@dataclass
class Schema:
    relax: bool = True
    layouts: dict[int, Layout] = field(default_factory=dict)
    root: int = 0
    file_version: int = FILE_VERSION


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def zigzag(n: int) -> int:
    return (n << 1 ^ n >> 31) & 0xFFFFFFFF


def unzigzag(n: int) -> int:
    return n >> 1 ^ -(n & 1)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ImageError("schema", "schema ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def varint(self) -> int:
        value = 0
        for shift in range(0, 35, 7):
            byte = self.take(1)[0]
            value |= (byte & 127) << shift
            if byte < 128:
                return value
        raise ImageError("schema", "varint is too long")

    def value(self, tag: int, inside: bool) -> object:
        """A value of any type; ``inside`` a collection, booleans have a byte of their own."""
        if tag in (TRUE, FALSE):
            return (self.take(1)[0] == TRUE) if inside else tag == TRUE
        if tag in (I16, I32):
            return unzigzag(self.varint())
        if tag == BINARY:
            return self.take(self.varint())
        if tag == STRUCT:
            return self.struct()
        if tag == MAP:
            count = self.varint()
            kinds = self.take(1)[0] if count else 0
            return {self.value(kinds >> 4, True): self.value(kinds & 15, True) for _ in range(count)}
        raise ImageError("schema", f"unknown type {tag}")

    def struct(self) -> dict[int, object]:
        found, number = {}, 0
        while head := self.take(1)[0]:
            number = number + (head >> 4) if head >> 4 else unzigzag(self.varint())
            found[number] = self.value(head & 15, False)
        return found


def parse(data: bytes) -> Schema:
    reader = _Reader(data)
    top = reader.struct()
    if reader.at != len(data):
        raise ImageError("schema", "bytes after the schema")
    layouts = {}
    for key, raw in top.get(2, {}).items():
        parts = {k: (v.get(1, 0), v.get(2, 0)) for k, v in raw.get(3, {}).items()}
        layouts[key] = Layout(raw.get(1, 0), raw.get(2, 0), parts, raw.get(4, b"").decode())
    schema = Schema(top.get(1, False), layouts, top.get(3, 0), top.get(4, 0))
    validate(schema)
    return schema


def validate(schema: Schema) -> None:
    if schema.file_version != FILE_VERSION:
        raise ImageError("schema", f"unsupported schema file_version {schema.file_version}")
    if schema.root not in schema.layouts:
        raise ImageError("schema", "missing root_layout")
    for number, layout in schema.layouts.items():
        if not layout.fields and layout.bits > 64:
            raise ImageError("schema", f"layout {number}: a primitive of {layout.bits} bits")
        for name, (target, offset) in layout.fields.items():
            held = schema.layouts.get(target)
            at = offset * 8 if offset >= 0 else -offset
            if held is None or held.bits < 0 or at + held.bits >= 1 << 16:
                raise ImageError("schema", f"field {name} of layout {number} is out of range")


class _Writer:
    """Fields of one struct; zero numbers are left out."""

    def __init__(self) -> None:
        self.out, self.last = bytearray(), 0

    def _head(self, number: int, tag: int) -> None:
        self.out.append(number - self.last << 4 | tag)
        self.last = number

    def integer(self, number: int, tag: int, value: int) -> None:
        if value:
            self._head(number, tag)
            self.out += varint(zigzag(value))

    def raw(self, number: int, tag: int, data: bytes) -> None:
        self._head(number, tag)
        self.out += data

    def end(self) -> bytes:
        return bytes(self.out) + b"\0"


def _map(values: dict[int, bytes]) -> bytes:
    if not values:
        return b"\0"
    return varint(len(values)) + bytes([I16 << 4 | STRUCT]) + b"".join(varint(zigzag(k)) + v for k, v in sorted(values.items()))


def to_bytes(schema: Schema) -> bytes:
    layouts = {}
    for key, layout in schema.layouts.items():
        parts = {}
        for k, (target, offset) in layout.fields.items():
            w = _Writer()
            w.integer(1, I16, target)
            w.integer(2, I16, offset)
            parts[k] = w.end()
        w = _Writer()
        w.integer(1, I32, layout.size)
        w.integer(2, I16, layout.bits)
        w.raw(3, MAP, _map(parts))
        name = layout.type_name.encode()
        w.raw(4, BINARY, varint(len(name)) + name)
        layouts[key] = w.end()
    w = _Writer()
    w.raw(1, TRUE if schema.relax else FALSE, b"")
    w.raw(2, MAP, _map(layouts))
    w.integer(3, I16, schema.root)
    w.integer(4, I32, schema.file_version)
    return w.end()
