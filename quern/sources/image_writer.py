"""Writing an image: blocks are filled, compressed and sealed by tasks, which write them to their
places in the one file; the driver appends metadata and index."""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import Any, BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.codec import cdc, frozen, section
from quern.codec.image import metadata_sections
from quern.model import LIMITS, ImageError
from quern.operators import build, chunks, scans
from quern.scratch import materialize

CREATOR = b"quern"


def content_pieces(entries: DataFrame, chunker: str = "basic") -> DataFrame:
    """(seq, idx, piece): whole contents, or content-defined chunks."""
    files = entries.where("kind = 'file'").select("seq", F.coalesce("content", F.lit(b"")).alias("content"))
    if chunker == "basic":
        return files.select("seq", F.lit(0).cast("long").alias("idx"), F.col("content").alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seq, found in zip(batch.column(0).to_pylist(), cdc.chunked(batch.column(1).to_pylist()), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([seq] * len(found), pa.int64()), pa.array(range(len(found)), pa.int64()), pa.array(found, pa.binary())], ["seq", "idx", "piece"])

    return files.mapInArrow(run, "seq long, idx long, piece binary")


def plan(entries: DataFrame, block_size: int, chunker: str = "cdc") -> tuple[DataFrame, DataFrame]:
    """(chunks, slices): the chunks of each file (seq, idx, section_idx, offset, size), and the
    bytes of each block in order (section_idx, offset, data).

    Equal pieces are stored once, where the first of them lies; adjacent chunks that follow on
    in one block are one chunk.
    """
    cut = content_pieces(entries, chunker).where(F.length("piece") > 0).withColumn("digest", F.sha2("piece", 256))
    pieces = materialize(scans.ranked(cut, ["seq", "idx"], "at"), "pieces")
    firsts = pieces.groupBy("digest").agg(F.min("at").alias("at"))
    stored = pieces.join(firsts, ["digest", "at"]).select("at", "digest", "piece")
    slices = materialize(chunks.block_slices(stored.withColumn("n", F.length("piece")), "at", "n", block_size), "slices")
    begins = slices.groupBy("at").agg(F.min("block").alias("first"))
    placed = slices.join(begins, "at").join(stored, "at")
    # How much of the piece earlier slices hold: what came before the first cut, then whole blocks.
    head = F.min_by("offset", "block").alias("head")
    heads = slices.groupBy("at").agg(head)
    skip = F.when(F.col("block") == F.col("first"), 0).otherwise((F.col("block") - F.col("first")) * block_size - F.col("head"))
    data = placed.join(heads, "at").select(F.col("block").alias("section_idx"), "offset", F.substring(F.col("piece"), (skip + 1).cast("int"), F.col("size").cast("int")).alias("data"))
    where = firsts.withColumnRenamed("at", "store").join(slices.withColumnRenamed("at", "store"), "store").select("digest", F.col("block").alias("section_idx"), "offset", "size")
    of_files = pieces.select("seq", "idx", "digest").join(where, "digest").select("seq", "idx", "section_idx", "offset", "size")
    return coalesced(of_files), data


def coalesced(parts: DataFrame) -> DataFrame:
    """Chunks of a file in order, merged where one goes on at the end of the one before."""
    from pyspark.sql import Window

    order = Window.partitionBy("seq").orderBy("idx", "section_idx")
    same = (F.lag("section_idx").over(order) == F.col("section_idx")) & (F.lag(F.col("offset") + F.col("size")).over(order) == F.col("offset"))
    islands = parts.withColumn("begins", F.when(same, 0).otherwise(1)).withColumn("island", F.sum("begins").over(order))
    return islands.groupBy("seq", F.col("island").alias("idx")).agg(F.min("section_idx").alias("section_idx"), F.min("offset").alias("offset"), F.sum("size").alias("size"))


def sealed_blocks(slices: DataFrame, algo: int, level: int | None) -> DataFrame:
    """(section_number, bytes, sealed): one task row holds one block, at most a block's size."""
    blocks = slices.groupBy("section_idx").agg(F.array_sort(F.collect_list(F.struct("offset", "data"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, parts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sealed = section.seal(number, section.BLOCK, b"".join(p["data"] for p in parts.as_py()), algo, level)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(sealed)], pa.int64()), pa.array([sealed], pa.binary())], ["section_number", "bytes", "sealed"])

    return blocks.mapInArrow(run, "section_number long, bytes long, sealed binary")


def metadata_value(c: dict[str, DataFrame], block_size: int, created: int | None = None) -> dict[str, Any]:
    """The catalogue as one value; it must fit the metadata limit, so the driver may hold it.

    Numbers are 32 bits in the format and on their way: less 2^31, as Spark's are signed."""

    def column(name: str, key: str, *columns: str) -> dict[str, np.ndarray]:
        rows = c[name].orderBy(key).select(*[(F.col(k) - (1 << 31)).cast("int").alias(k) for k in columns]).toArrow()
        return {k: (rows.column(k).to_numpy().astype(np.int64) + (1 << 31)).astype(np.uint32) for k in columns}

    def packed(name: str) -> dict[str, Any] | None:
        values = c[name].orderBy("pos").select(F.col("value").cast("binary").alias("value")).toArrow().column("value")
        if not len(values):
            return None
        buffer = b"".join(v for part in values.chunks for v in part.to_pylist())
        return {"buffer": buffer, "symtab": None, "index": pc.binary_length(values).to_numpy().astype(np.uint64), "packed_index": True}

    options = c["options"].first()
    meta = frozen.empty()
    stored = column("chunks", "chunk_idx", "section_idx", "offset", "size")
    meta["chunks"] = {"block": stored["section_idx"], "offset": stored["offset"], "size": stored["size"]}
    meta["directories"] = column("directories", "inode_num", "parent_entry", "first_entry", "self_entry")
    inodes = column("inodes", "inode_num", "mode_index", "owner_index", "group_index", "atime_offset", "mtime_offset", "ctime_offset")
    zeros = np.zeros(len(inodes["mode_index"]), np.uint32)
    meta["inodes"] = {"name_index": zeros, "inode": zeros, **inodes}
    meta["chunk_table"] = column("chunk_table", "file_idx", "first_chunk")["first_chunk"]
    meta["symlink_table"] = column("symlink_table", "pos", "target_index")["target_index"]
    for name in ("uids", "gids", "modes"):
        meta[name] = column(name, "pos", "value")["value"]
    meta["block_size"] = block_size
    devices = [int(r["device_id"]) for r in c["devices"].orderBy("pos").select("device_id").collect()]
    meta["devices"] = devices or None
    resolution = options["time_resolution_sec"]
    meta["options"] = {
        "mtime_only": options["mtime_only"], "time_resolution_sec": resolution if resolution != 1 else None,
        "packed_chunk_table": False, "packed_directories": False, "packed_shared_files_table": False,
    }
    meta["dir_entries"] = column("dir_entries", "entry_idx", "name_index", "inode_num")
    meta["writer_version"], meta["create_timestamp"] = CREATOR, created
    for table, field in (("names", "compact_names"), ("symlinks", "compact_symlinks")):
        meta[field] = packed(table)
    return meta


class SectionFile:
    """Appends sealed sections to a file and keeps their offsets."""

    def __init__(self, out: BinaryIO):
        self.out, self.entries, self.at = out, [], 0

    def skip(self, kind: int, size: int) -> None:
        """A section whose bytes are put in their place otherwise."""
        section.pack_entry(kind, self.at)
        self.entries.append((kind, self.at))
        self.at += size

    def append(self, kind: int, sealed: bytes) -> None:
        self.skip(kind, len(sealed))
        self.out.write(sealed)

    def add(self, kind: int, payload: bytes, algo: int = section.NONE, level: int | None = None) -> None:
        self.append(kind, section.seal(len(self.entries), kind, payload, algo, level))

    def finish(self) -> None:
        self.out.write(section.seal_index(self.entries, self.at))


def place_blocks(blocks: DataFrame, name: str, starts: np.ndarray, end: int, mark: bytes) -> int:
    """Blocks (section_number, sealed) written by tasks to where they begin in the file ``name``;
    how many were.

    A task that does not find ``mark`` at ``end`` sees no such file, or another, and writes
    nothing; a task that runs twice writes the same bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = None
        try:
            if os.path.exists(name):
                file = os.open(name, os.O_RDWR)
            ours = file is not None and os.pread(file, len(mark) + 1, end) == mark
            for batch in batches:
                for number, sealed in zip(batch.column(0).to_pylist() if ours else (), batch.column(1), strict=False):
                    data, at = memoryview(sealed.as_buffer()), int(starts[number])
                    while len(data):
                        done = os.pwrite(file, data, at)
                        data, at = data[done:], at + done
                yield pa.RecordBatch.from_arrays([pa.array([len(batch) if ours else 0], pa.int64())], ["n"])
        finally:
            if file is not None:
                os.close(file)

    return blocks.select("section_number", "sealed").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_image(
    entries: DataFrame,
    path: str,
    block_size: int = 1 << 20,
    chunker: str = "cdc",
    algo: int = section.ZSTD,
    level: int | None = None,
    metadata_limit: int = LIMITS["metadata_size_limit"],
    **config: object,
) -> dict[str, DataFrame]:
    """Write an image of ``entries`` to ``path``, on any file system that pyarrow knows; returns
    its catalogue.

    Where the tasks see the file, they write its blocks; of them the driver gets the sizes alone.
    On another file system, or in a folder of the driver's own, the driver streams the blocks."""
    parts, slices = plan(entries, block_size, chunker)
    catalogue = build.catalogue(entries, parts, block_size, **config)
    blocks = materialize(sealed_blocks(slices, algo, level), "blocks")
    schema, data = metadata_sections(metadata_value(catalogue, block_size))
    if len(data) > metadata_limit:
        raise ImageError("size_limit", f"metadata is larger than {metadata_limit} bytes")
    sizes = blocks.select("section_number", "bytes").toArrow().sort_by("section_number").column("bytes").to_numpy()
    starts = np.cumsum(sizes) - sizes
    end = int(sizes.sum())
    fs, name = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
    placed = 0
    if local := isinstance(fs, pyarrow.fs.LocalFileSystem):
        name, mark = os.path.abspath(name), os.urandom(16)
        with open(name, "wb") as out:
            out.seek(end)
            out.write(mark)
        placed = place_blocks(blocks, name, starts, end, mark)
    with open(name, "r+b") if local else fs.open_output_stream(name) as out:
        image = SectionFile(out)
        if placed == len(sizes):
            for size in sizes.tolist():
                image.skip(section.BLOCK, size)
            if local:
                out.seek(end)
        else:
            for row in blocks.repartitionByRange("section_number").sortWithinPartitions("section_number").toLocalIterator():
                image.append(section.BLOCK, bytes(row["sealed"]))
        image.add(section.SCHEMA, schema, algo, level)
        image.add(section.METADATA, data, algo, level)
        image.finish()
    return catalogue


def extract(c: dict[str, DataFrame], blocks: DataFrame) -> DataFrame:
    """(file_idx, content): chunks of all files cut from their blocks and joined in order.

    The blocks meet the chunks by section; each block is read once.
    """
    from quern.operators.tree import file_chunks

    wanted = file_chunks(c["chunk_table"], c["chunks"])
    cut = wanted.join(blocks, "section_idx").select("file_idx", F.col("chunk_idx").alias("idx"), F.substring(F.col("data"), (F.col("offset") + 1).cast("int"), F.col("size").cast("int")).alias("piece"))
    files = c["chunk_table"].select("file_idx").where(F.col("file_idx") < c["chunk_table"].agg(F.max("file_idx")).first()[0])
    return files.join(chunks.reassemble(cut, "file_idx"), "file_idx", "left").select("file_idx", F.coalesce(F.col("content"), F.lit("")).cast("binary").alias("content"))
