"""An opened image: its section index and its catalogue, unpacked, as Arrow tables."""

from __future__ import annotations

import copy
from collections import OrderedDict
from typing import Any

import numpy as np
import pyarrow as pa

from quern.codec import frozen, fsst, section, thrift
from quern.model import LIMITS, ImageError

STRATEGIES = ("use_embedded", "use_embedded_if_exists", "build")


class Image:
    """Reads the index, then only the two metadata sections."""

    def __init__(self, read: section.ReadAt, length: int, start: int = 0, strategy: str = "use_embedded_if_exists", verify: str = "fast", **limits: int):
        if strategy not in STRATEGIES:
            raise ImageError("option", f"unknown section index strategy {strategy}")
        self.read, self.start, self.verify, self.limits = read, start, verify, {**LIMITS, **limits}
        index = None
        if strategy != "build":
            index = section.embedded_index(read, length, self.limits["section_index_size_limit"], start, verify)
        if index is None and strategy == "use_embedded":
            raise ImageError("missing_section", "missing section SECTION_INDEX")
        self.index = section.scan_index(read, length, self.limits["section_index_size_limit"], start) if index is None else index
        self._metadata: dict[str, Any] | None = None
        #: Blocks read last, the latest at the end, and how often one was read from the file.
        self._blocks: OrderedDict[int, bytes] = OrderedDict()
        self._held = self.block_reads = 0

    def unique(self, kind: int, name: str) -> int:
        places = [offset for k, offset in self.index if k == kind]
        if len(places) != 1:
            raise ImageError("duplicate_section" if places else "missing_section", f"{'duplicate' if places else 'missing'} section {name}")
        return places[0]

    def section(self, number: int, limit: int) -> tuple[section.Header, bytes]:
        return section.read_section(self.read, self.start + self.index[number][1], limit, self.verify)

    def headers(self, start: int = 0, end: int | None = None) -> list[section.Header]:
        return [section.read_header(self.read, self.start + offset) for _, offset in self.index[start:end]]

    def catalogue_bytes(self) -> int:
        """Stored bytes of the catalogue and the section index, at least 1."""
        sizes = [section.read_header(self.read, self.start + offset).size for kind, offset in self.index if kind == section.METADATA]
        return sum(sizes) + 8 * len(self.index) or 1

    @property
    def metadata(self) -> dict[str, Any]:
        if self._metadata is None:
            get = lambda kind, name, limit: section.read_section(self.read, self.start + self.unique(kind, name), self.limits[limit], self.verify)[1]
            schema = thrift.parse(get(section.SCHEMA, "METADATA_V2_SCHEMA", "schema_size_limit"))
            self._metadata = unpack(frozen.decode(schema, get(section.METADATA, "METADATA_V2", "metadata_size_limit")))
        return self._metadata

    def block(self, number: int, block_size: int | None = None) -> bytes:
        """A block's bytes.  ``block_size``, where it is known, spares reading the catalogue.

        Blocks read last are kept, up to ``block_cache_size_limit`` bytes in all."""
        if number in self._blocks:
            self._blocks.move_to_end(number)
            return self._blocks[number]
        if not number < len(self.index) or self.index[number][0] != section.BLOCK:
            raise ImageError("section_type", f"section {number} is no block")
        data = self.section(number, int(self.metadata["block_size"]) if block_size is None else block_size)[1]
        self.block_reads += 1
        if len(data) <= self.limits["block_cache_size_limit"]:
            self._blocks[number] = data
            self._held += len(data)
            while self._held > self.limits["block_cache_size_limit"]:
                self._held -= len(self._blocks.popitem(last=False)[1])
        return data

    def chunk(self, number: int, offset: int, size: int, block_size: int | None = None) -> bytes:
        """Bytes of a block, through the kept blocks."""
        data = self.block(number, block_size)[offset : offset + size]
        if len(data) < size:
            raise ImageError("chunk", f"a chunk exceeds section {number}")
        return data


    def fresh(self, **limits: int) -> Image:
        """The same opened image under further limits, no block of it kept or read so far."""
        other = copy.copy(self)
        other.limits, other._blocks, other._held, other.block_reads = {**self.limits, **limits}, OrderedDict(), 0, 0
        return other


def strings(table: dict[str, Any] | None, loose: list[bytes]) -> list[str]:
    """A string table's values; each must be UTF-8."""
    if table is None:
        raw = loose
    else:
        index = table["index"].astype(np.int64)
        ends = np.cumsum(index) if table["packed_index"] else index[1:]
        starts = ends - index if table["packed_index"] else index[:-1]
        if len(ends) and (ends.max() > len(table["buffer"]) or (ends < starts).any()):
            raise ImageError("string_table", "string offsets are out of order or bounds")
        raw = [table["buffer"][a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        if table["symtab"] is not None:
            symbols = fsst.parse(table["symtab"])
            raw = [fsst.decode(symbols, r) for r in raw]
    try:
        return [r.decode() for r in raw]
    except UnicodeDecodeError as e:
        raise ImageError("utf8", "a string is not UTF-8") from e


def unpack(meta: dict[str, Any]) -> dict[str, Any]:
    """Undo delta, prefix and run packing."""
    if meta["features"]:
        raise ImageError("features", f"unsupported features {meta['features']}")
    options = meta["options"] or {}
    if options.get("packed_chunk_table"):
        meta["chunk_table"] = np.cumsum(meta["chunk_table"], dtype=np.uint64)
    if options.get("packed_directories"):
        meta["directories"]["first_entry"] = np.cumsum(meta["directories"]["first_entry"], dtype=np.uint64)
    shared = meta["shared_files_table"]
    if shared is not None and options.get("packed_shared_files_table"):
        meta["shared_files_table"] = np.repeat(np.arange(len(shared), dtype=np.uint64), shared.astype(np.int64) + 2)
    if any(len(t) and t.max() > 0xFFFFFFFF for t in (meta["chunk_table"], meta["directories"]["first_entry"])):
        raise ImageError("overflow", "a packed table exceeds 32 bits")
    meta["names"] = strings(meta["compact_names"], meta["names"])
    meta["symlinks"] = strings(meta["compact_symlinks"], meta["symlinks"])
    return meta


def kinds(meta: dict[str, Any]) -> np.ndarray:
    """The kind of each inode by number ranges."""
    n = len(meta["inodes"]["mode_index"])
    shared = meta["shared_files_table"]
    slots = len(meta["chunk_table"]) - 1
    unique = slots - (int(shared[-1]) + 1 if shared is not None and len(shared) else 0)
    sizes = [len(meta["directories"]["first_entry"]) - 1, len(meta["symlink_table"]), unique, len(shared) if shared is not None else 0, len(meta["devices"]) if meta["devices"] is not None else 0]
    if min(sizes) < 0 or sum(sizes) > n:
        raise ImageError("inodes", "the kinds of inodes do not fit their number")
    return np.repeat(["dir", "symlink", "file", "shared", "device", "ipc"], [*sizes, n - sum(sizes)])


def sections(image: Image, start: int = 0, end: int | None = None) -> pa.Table:
    """The table of sections, or some of its rows; other headers are not read."""
    heads = image.headers(start, end)
    return pa.table(
        {
            "section_idx": pa.array(range(start, start + len(heads)), pa.int64()),
            "section_type": pa.array([h.type for h in heads], pa.int32()),
            "compress_algo": pa.array([h.algo for h in heads], pa.int32()),
            "section_number": pa.array([h.number for h in heads], pa.int64()),
            "offset": pa.array([o for _, o in image.index[start:end]], pa.int64()),
            "payload_size": pa.array([h.size for h in heads], pa.int64()),
            "fast_hash": pa.array([h.fast for h in heads], pa.binary()),
            "slow_hash": pa.array([h.slow for h in heads], pa.binary()),
        }
    )


def table(image: Image, name: str) -> pa.Table:
    """One table of the catalogue."""
    if name == "sections":
        return sections(image)
    meta = image.metadata
    longs = lambda v: pa.array(np.asarray(v).astype(np.int64))
    rows = lambda v: pa.array(np.arange(len(v), dtype=np.int64))
    if name == "inodes":
        i = meta["inodes"]
        columns = {k: longs(i[k]) for k in ("mode_index", "owner_index", "group_index", "mtime_offset", "atime_offset", "ctime_offset")}
        return pa.table({"inode_num": rows(i["mode_index"]), "kind": pa.array(kinds(meta).tolist(), pa.string()), **columns})
    if name == "dir_entries":
        e = meta["dir_entries"] or {"name_index": [], "inode_num": []}
        return pa.table({"entry_idx": rows(e["name_index"]), "name_index": longs(e["name_index"]), "inode_num": longs(e["inode_num"])})
    if name == "directories":
        d = meta["directories"]
        return pa.table({"inode_num": rows(d["first_entry"]), **{k: longs(d[k]) for k in ("parent_entry", "first_entry", "self_entry")}})
    if name == "chunk_table":
        return pa.table({"file_idx": rows(meta["chunk_table"]), "first_chunk": longs(meta["chunk_table"])})
    if name == "chunks":
        c = meta["chunks"]
        return pa.table({"chunk_idx": rows(c["block"]), "section_idx": longs(c["block"]), "offset": longs(c["offset"]), "size": longs(c["size"])})
    if name in ("modes", "uids", "gids"):
        return pa.table({"pos": rows(meta[name]), "value": longs(meta[name])})
    if name in ("names", "symlinks"):
        return pa.table({"pos": rows(meta[name]), "value": pa.array(meta[name], pa.string())})
    if name == "symlink_table":
        return pa.table({"pos": rows(meta["symlink_table"]), "target_index": longs(meta["symlink_table"])})
    if name == "devices":
        d = meta["devices"] if meta["devices"] is not None else np.zeros(0, np.uint64)
        return pa.table({"pos": rows(d), "device_id": pa.array([int(x) for x in d], pa.decimal128(20, 0))})
    if name == "shared_files":
        s = meta["shared_files_table"] if meta["shared_files_table"] is not None else np.zeros(0, np.uint64)
        return pa.table({"pos": rows(s), "file_slot": longs(s)})
    if name == "options":
        o = meta["options"]
        resolution = int((o or {}).get("time_resolution_sec") or 1)
        return pa.table(
            {
                "mtime_only": pa.array([bool((o or {}).get("mtime_only", False))]),
                "time_resolution_sec": pa.array([resolution]),
                "timestamp_base": pa.array([int(meta["timestamp_base"])]),
                "block_size": pa.array([int(meta["block_size"])]),
                "scaled": pa.array([o is not None]),
            }
        )
    raise ImageError("option", f"unknown table {name}")


def metadata_sections(meta: dict[str, Any]) -> tuple[bytes, bytes]:
    """Schema and metadata payloads of a catalogue's value."""
    schema, data = frozen.encode(meta)
    return thrift.to_bytes(schema), data
