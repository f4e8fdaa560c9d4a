"""Golden bytes, round trips and refusals of the byte formats."""

import os
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.codec import cdc, frozen, fsst, section, thrift
from quern.codec.image import Image, metadata_sections, strings, table, unpack
from quern.model import ImageError
from quern.sources.image_writer import SectionFile


def written(**parts):
    meta = frozen.empty()
    meta.update(parts)
    schema, data = frozen.encode(meta)
    return thrift.parse(thrift.to_bytes(schema)), data


def test_schema_bytes():
    schema = thrift.Schema(True, {0: thrift.Layout(1, 0, {}, "")}, 0, 1)
    golden = bytes.fromhex("111b014c0015022b00180000250200")
    assert thrift.to_bytes(schema) == golden
    assert thrift.parse(golden) == schema


def test_schema_refusals():
    for bad in (thrift.Schema(True, {0: thrift.Layout(1, 65)}), thrift.Schema(True, {}), thrift.Schema(True, {0: thrift.Layout()}, 0, 2), thrift.Schema(True, {0: thrift.Layout(1, 8, {1: (5, 0)})})):
        with pytest.raises(ImageError):
            thrift.validate(bad)
    with pytest.raises(ImageError):
        thrift.parse(b"\x11\x1b\x01")


def test_packed_bits_and_missing_field():
    schema = thrift.Schema(True, {0: thrift.Layout(0, 4), 1: thrift.Layout(1, 8, {1: (0, 0), 3: (0, -4)})}, 1)
    found = frozen.decode(schema, bytes.fromhex("4200"), ("struct", {"a": "u32", "b": "u32", "c": "u32"}))
    assert {k: int(v) for k, v in found.items()} == {"a": 2, "b": 0, "c": 4}


@given(st.integers(1, 64), st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=20))
def test_load_bits(bits, values):
    values = [v & ((1 << bits) - 1) for v in values]
    whole = sum(v << (bits * i) for i, v in enumerate(values))
    data = whole.to_bytes((bits * len(values) + 7) // 8, "little")
    assert frozen.load_bits(data, np.arange(len(values)) * bits, bits).tolist() == values


@pytest.mark.parametrize(
    "parts,golden",
    [
        ({"options": {"mtime_only": True, "time_resolution_sec": 42, "packed_chunk_table": False, "packed_directories": False, "packed_shared_files_table": False}}, "0101012a000000"),
        ({"writer_version": b"abc"}, "010900000003000000616263"),
        ({"writer_version": b"\0\0"}, "0102000000"),
        ({"chunks": {"block": [0, 0], "offset": [0, 100], "size": [42, 42]}, "symlink_table": [0, 0, 0]}, "0c0000000200000003000000000000002a000000640000002a000000"),
    ],
)
def test_metadata_bytes(parts, golden):
    schema, data = written(**parts)
    assert data.hex() == golden
    found = frozen.decode(schema, data)
    for k, v in parts.items():
        if isinstance(v, dict):
            assert {a: np.asarray(b).tolist() for a, b in found[k].items()} == v
        else:
            assert (found[k] if isinstance(v, bytes) else found[k].tolist()) == v


def test_metadata_round_trip():
    parts = dict(
        names=[b"a", b"", b"xyz"], devices=[0, 2**64 - 1], modes=[2**32 - 1, 0], features=[b"f"], timestamp_base=2**40, block_categories=[b"p"],
        reg_file_size_cache={"lookup": {3: 4, 1: 2**40}, "min_chunk_count": 9}, compact_names={"buffer": b"abc", "symtab": None, "index": [1, 2], "packed_index": True},
    )
    found = frozen.decode(*written(**parts))
    assert found["names"] == parts["names"] and found["devices"].tolist() == parts["devices"] and found["modes"].tolist() == parts["modes"]
    assert found["reg_file_size_cache"]["lookup"] == {1: 2**40, 3: 4} and found["compact_names"]["index"].tolist() == [1, 2]
    with pytest.raises(ImageError):
        unpack(found)  # features


def test_packed_tables():
    meta = frozen.empty()
    meta["options"] = {"mtime_only": False, "time_resolution_sec": None, "packed_chunk_table": True, "packed_directories": True, "packed_shared_files_table": True}
    meta["chunk_table"], meta["shared_files_table"] = np.array([0, 1, 2], np.uint64), np.array([0, 1], np.uint64)
    meta["directories"]["first_entry"] = np.array([1, 3, 0], np.uint64)
    found = unpack(meta)
    assert found["chunk_table"].tolist() == [0, 1, 3] and found["directories"]["first_entry"].tolist() == [1, 4, 4]
    assert found["shared_files_table"].tolist() == [0, 0, 1, 1, 1]


def test_string_tables():
    table_ = {"buffer": b"ab\xc3\xa9", "symtab": None, "index": np.array([0, 2, 4], np.uint64), "packed_index": False}
    assert strings(table_, []) == ["ab", "é"]
    with pytest.raises(ImageError):
        strings(None, [b"\xff"])
    symbols = [b"he", b"llo"]
    coded = [fsst.encode(symbols, b"hello"), fsst.encode(symbols, b"x")]
    packed = {"buffer": b"".join(coded), "symtab": fsst.to_bytes(symbols), "index": np.array(list(map(len, coded)), np.uint64), "packed_index": True}
    assert strings(packed, []) == ["hello", "x"]


def test_fsst():
    assert fsst.decode([b"hello"] * 255, bytes([0, 0xFF, 0x2C, 0])) == b"hello,hello"
    symbols = [b"hello", b"world", b"!"]
    assert fsst.decode(fsst.parse(fsst.to_bytes(symbols)), bytes([0, 0xFF, 0x2C, 1, 2])) == b"hello,world!"
    assert fsst.decode([], b"\x05") == fsst.FILLER and fsst.max_decoded(3) == 24
    for bad in ([b"!", b"hello"], [b"123456789"], [b"a"] * 256, [b"a\0"]):
        with pytest.raises(ImageError):
            fsst.to_bytes(bad)
    for bad in (b"", bytes(17), b"\x01" * 30):
        with pytest.raises(ImageError):
            fsst.parse(bad)
    with pytest.raises(ImageError):
        fsst.decode(symbols, b"\xff")


@given(st.binary(max_size=300))
def test_fsst_round_trip(data):
    symbols = fsst.train([data, b"abcabc"])
    assert fsst.decode(symbols, fsst.encode(symbols, data)) == data


@settings(deadline=None)
@given(st.binary(max_size=2000), st.sampled_from([0, 1, 2, 3]))
def test_seal(data, algo):
    sealed = section.seal(7, section.BLOCK, data, algo)
    header, back = section.read_section(lambda o, n: sealed[o : o + n], 0, max(len(data), 1), "slow")
    assert back == data and header.number == 7 and header.size <= len(data)


def test_section_refusals():
    sealed = section.seal(0, section.BLOCK, b"x" * 500, section.ZSTD)
    read = lambda o, n: sealed[o : o + n]
    with pytest.raises(ImageError, match="larger"):
        section.read_section(read, 0, 100)
    hurt = sealed[:-1] + bytes([sealed[-1] ^ 1])
    with pytest.raises(ImageError, match="checksum"):
        section.read_section(lambda o, n: hurt[o : o + n], 0, 1000)
    with pytest.raises(ImageError, match="unsupported"):
        section.parse_header(section.MAGIC + b"\x02\x02" + bytes(56))
    with pytest.raises(ImageError, match="unsupported compression"):
        section.decompress(b"", 5, 10)
    with pytest.raises(ImageError):
        section.pack_entry(0, 1 << 48)


class Memory:
    def __init__(self):
        self.data = bytearray()

    def write(self, part):
        self.data += part


def small_image(index=True, before=b""):
    out = Memory()
    image = SectionFile(out)
    image.add(section.BLOCK, b"bar" * 10)
    meta = frozen.empty()
    meta["block_size"], meta["chunk_table"] = 1 << 10, [0]
    meta["directories"] = {k: [0, 0] for k in ("parent_entry", "first_entry", "self_entry")}
    meta["inodes"] = {k: [0] for k in frozen.INODE[1]}
    meta["dir_entries"], meta["modes"] = {"name_index": [0], "inode_num": [0]}, [0o40755]
    schema, data = metadata_sections(meta)
    image.add(section.SCHEMA, schema, section.ZSTD)
    image.add(section.METADATA, data, section.LZMA)
    if index:
        image.finish()
    return before + bytes(out.data)


@pytest.mark.parametrize("index", [True, False])
@pytest.mark.parametrize("strategy", ["use_embedded", "use_embedded_if_exists", "build"])
@pytest.mark.parametrize("before", [b"", b"#!/bin/sh\n"])
def test_section_index(index, strategy, before):
    data = small_image(index, before)
    opened = lambda: Image(lambda o, n: data[o : o + n], len(data), len(before), strategy, "slow")
    if strategy == "use_embedded" and not index:
        with pytest.raises(ImageError, match="missing section SECTION_INDEX"):
            opened()
        return
    image = opened()
    assert [k for k, _ in image.index] == [0, 7, 8, 9][: 3 + index]
    assert image.block(0) == b"bar" * 10
    assert table(image, "inodes").column("kind").to_pylist() == ["dir"]
    with pytest.raises(ImageError, match="no block"):
        image.block(1)


def test_broken_index_is_an_error():
    data = small_image()
    offset = struct.unpack("<Q", data[-8:])[0] & ((1 << 48) - 1)
    hurt = bytearray(data)
    hurt[offset + 64] ^= 1
    with pytest.raises(ImageError, match="checksum"):
        Image(lambda o, n: bytes(hurt[o : o + n]), len(hurt))
    with pytest.raises(ImageError, match="larger"):
        Image(lambda o, n: data[o : o + n], len(data), metadata_size_limit=4).metadata


@settings(deadline=None, max_examples=20)
@given(st.integers(0, 300_000), st.integers(0, 3))
def test_cdc(size, seed):
    data = np.random.default_rng(seed).integers(0, 256 if seed else 1, size, dtype=np.uint8).tobytes()
    parts = cdc.chunks(data)
    assert b"".join(parts) == data
    assert all(cdc.MIN_CHUNK - 1 <= len(p) < cdc.MAX_CHUNK for p in parts[:-1])


def test_cdc_finds_moved_content():
    data = os.urandom(200_000)
    a, b = set(cdc.chunks(data)), set(cdc.chunks(b"inserted" + data))
    assert len(a - b) <= 2


@given(st.binary(min_size=70, max_size=300))
def test_cdc_window(data):
    whole = cdc.fingerprints(data)
    assert whole[-1] == cdc.fingerprints(data[-64:])[-1]
