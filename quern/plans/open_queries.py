"""Queries of how images are opened, limited and refused, and of trees of the operating system.

Images are written with whole contents and stored blocks, so that SQL can state where each byte
lies."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.codec import cdc, section, thrift
from quern.functions import columns as C
from quern.model import LIMITS, ImageError
from quern.operators import build, scans, tree
from quern.plans import virtual
from quern.plans.image_queries import _BYTES, _TREE, BLOCK, ROOM, _catalogue, _docs
from quern.plans.registry import query
from quern.scratch import materialize, new_path
from quern.sources.files import scan_tree
from quern.sources.image import open_image, read_catalogue, read_table
from quern.sources.image_writer import write_image

#: Stored texts (the first of equal ones), and their slices over the blocks.
_STORED = f"""WITH u AS (SELECT min(doc_id) AS first_id, text, {_BYTES} AS n FROM documents WHERE text <> '' GROUP BY text),
    r AS (SELECT first_id, text, n, (sum(n) OVER (ORDER BY first_id ROWS UNBOUNDED PRECEDING))::BIGINT AS stop FROM u),
    s AS (SELECT first_id, text, stop - n AS start, stop, unnest(range((stop - n) // {BLOCK}, (stop - 1) // {BLOCK} + 1)) AS block FROM r),
    x AS (SELECT first_id, text, block::BIGINT AS block, (greatest(start, block * {BLOCK}) - block * {BLOCK})::BIGINT AS chunk_offset,
      (least(stop, (block + 1) * {BLOCK}) - greatest(start, block * {BLOCK}))::BIGINT AS size FROM s)"""


def _plain(spark: SparkSession, d: str) -> str:
    """The path of an image of the documents: whole contents, blocks stored as they are."""
    path = new_path(spark, "image") + ".img"
    write_image(materialize(virtual.entries(_docs(spark, d), content=True), "entries"), path, BLOCK, chunker="basic", algo=section.NONE, metadata_limit=ROOM["metadata_size_limit"])
    return path


def _copied(path: str, name: str, before: int, index: bool) -> str:
    """The image behind ``before`` other bytes, with or without its index section."""
    fs, source = pyarrow.fs.FileSystem.from_uri(path)
    image = open_image({"path": path})
    left = image.index[-1][1] if not index else fs.get_file_info(source).size
    with fs.open_input_stream(source) as data, fs.open_output_stream(f"{source}.{name}") as out:
        out.write(b"#" * before)
        while left and (part := data.read(min(left, 1 << 20))):
            out.write(part)
            left -= len(part)
    return f"{path}.{name}"


def _kind(f: Callable[[], object]) -> str:
    try:
        f()
    except ImageError as e:
        return e.kind
    return "ok"


_OPENED = f"""{_TREE}, o AS (SELECT * FROM (VALUES (true), (false)) a(indexed), (VALUES (0), (4096)) b(image_offset), (VALUES ('use_embedded'), ('use_embedded_if_exists'), ('build')) c(strategy))
    SELECT indexed, image_offset::BIGINT AS image_offset, strategy, CASE WHEN strategy = 'use_embedded' AND NOT indexed THEN 'missing_section' ELSE 'ok' END AS outcome,
      CASE WHEN strategy = 'use_embedded' AND NOT indexed THEN NULL ELSE (SELECT count(*) FROM t) END AS inodes FROM o"""


@query("s04_open_strategies", _OPENED)
def s04(spark: SparkSession, d: str) -> DataFrame:
    """Images with and without an index, behind other bytes or not, opened by each
    strategy; only asking for an index that isn't there fails."""
    path, found = _plain(spark, d), None
    for indexed in (True, False):
        for before in (0, 4096):
            copy = _copied(path, f"{indexed}-{before}", before, indexed)
            for strategy in ("use_embedded", "use_embedded_if_exists", "build"):
                how = {"image_offset": before, "section_index": strategy, **ROOM}
                outcome = _kind(lambda c=copy, h=how: open_image({"path": c, **h}).metadata)
                head = [F.lit(indexed).alias("indexed"), F.lit(before).cast("long").alias("image_offset"), F.lit(strategy).alias("strategy"), F.lit(outcome).alias("outcome")]
                one = spark.range(1).select(*head, F.lit(None).cast("long").alias("inodes"))
                if outcome == "ok":
                    one = read_table(spark, copy, "inodes", **how).agg(F.count("*").alias("inodes")).select(*head, "inodes")
                found = one if found is None else found.unionByName(one)
    return found


@query(
    "s03_limits",
    "SELECT * FROM (VALUES ('section_index_size_limit', 'size_limit', 'ok'), ('schema_size_limit', 'size_limit', 'ok'), ('metadata_size_limit', 'size_limit', 'ok'), ('block_cache_size_limit', 'ok', 'ok')) t(name, small, large)",
)
def s03(spark: SparkSession, d: str) -> DataFrame:
    """An image opened with each limit too small and large enough (a cache that is too
    small only keeps less)."""
    path = _plain(spark, d)
    how = lambda name, size: _kind(lambda: open_image({"path": path, **ROOM, name: size}).metadata)
    return spark.createDataFrame([(name, how(name, 16), how(name, (LIMITS | ROOM)[name])) for name in LIMITS], "name string, small string, large string")


_CASES: dict[str, Callable[[], object]] = {
    "version 2.2": lambda: section.parse_header(section.MAGIC + b"\x02\x02" + bytes(56)),
    "version 2.3": lambda: section.parse_header(section.MAGIC + b"\x02\x03" + bytes(56)),
    "other magic": lambda: section.parse_header(b"NOTIMG" + b"\x02\x05" + bytes(56)),
    "short header": lambda: section.parse_header(section.MAGIC),
    "offset 2^48": lambda: section.pack_entry(0, 1 << 48),
    "section of 500 bytes, limit 100": lambda: section.decompress(section.compress(bytes(500), section.ZSTD), section.ZSTD, 100),
    "section of 500 bytes, limit 500": lambda: section.decompress(section.compress(bytes(500), section.ZSTD), section.ZSTD, 500),
    **{f"decompress {a}": lambda a=a: section.decompress(b"", a, 10) for a in (5, 6, 7, 99)},
    **{f"compress {a}": lambda a=a: section.compress(b"x", a) for a in (1, 5, 6, 7)},
    "schema ends early": lambda: thrift.parse(b"\x11\x1b\x01"),
    "schema of 65 bits": lambda: thrift.validate(thrift.Schema(True, {0: thrift.Layout(1, 65)})),
    "schema without root": lambda: thrift.validate(thrift.Schema(True, {})),
    "schema version 2": lambda: thrift.validate(thrift.Schema(True, {0: thrift.Layout()}, 0, 2)),
    "schema field out of range": lambda: thrift.validate(thrift.Schema(True, {0: thrift.Layout(1, 8, {1: (5, 0)})})),
    "schema": lambda: thrift.validate(thrift.Schema(True, {0: thrift.Layout(1, 0)}, 0, 1)),
}


@query(
    "f12_refusals",
    """SELECT * FROM (VALUES ('version 2.2', 'unsupported_version'), ('version 2.3', 'ok'), ('other magic', 'unsupported_version'), ('short header', 'eof'), ('offset 2^48', 'offset'),
    ('section of 500 bytes, limit 100', 'size_limit'), ('section of 500 bytes, limit 500', 'ok'), ('decompress 5', 'unsupported_compression'), ('decompress 6', 'unsupported_compression'),
    ('decompress 7', 'unsupported_compression'), ('decompress 99', 'unsupported_compression'), ('compress 1', 'ok'), ('compress 5', 'unsupported_compression'), ('compress 6', 'unsupported_compression'),
    ('compress 7', 'unsupported_compression'), ('schema ends early', 'schema'), ('schema of 65 bits', 'schema'), ('schema without root', 'schema'), ('schema version 2', 'schema'),
    ('schema field out of range', 'schema'), ('schema', 'ok')) t(input, outcome)""",
)
def f12(spark: SparkSession, d: str) -> DataFrame:
    """What is refused, and as what."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_kind(_CASES[n]) for n in batch.column(0).to_pylist()], pa.string())], ["input", "outcome"])

    return spark.createDataFrame([(n,) for n in _CASES], "input string").mapInArrow(run, "input string, outcome string")


_BLOCKS = f"SELECT unnest(range((total + {BLOCK - 1}) // {BLOCK}))::BIGINT AS k, total FROM (SELECT sum(n)::BIGINT AS total FROM u)"


@query(
    "f10_section_types",
    f"""{_STORED}, b AS ({_BLOCKS}) SELECT k AS section_idx, 'ok' AS outcome, least({BLOCK}, total - k * {BLOCK})::BIGINT AS bytes FROM b
    UNION ALL SELECT (SELECT count(*) FROM b) + i, 'section_type', NULL FROM range(4) t(i)""",
)
def f10(spark: SparkSession, d: str) -> DataFrame:
    """every section, and one that isn't there, read as a block: only blocks are."""
    path = _plain(spark, d)
    count = read_table(spark, path, "sections").count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image = open_image({"path": path, "block_cache_size_limit": BLOCK})
        for batch in batches:
            numbers, outcomes, sizes = batch.column(0).to_pylist(), [], []
            for n in numbers:
                outcomes.append(_kind(lambda n=n: image.block(n, BLOCK)))
                sizes.append(len(image.block(n, BLOCK)) if outcomes[-1] == "ok" else None)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(outcomes, pa.string()), pa.array(sizes, pa.int64())], ["section_idx", "outcome", "bytes"])

    return spark.range(count + 1).withColumnRenamed("id", "section_idx").mapInArrow(run, "section_idx long, outcome string, bytes long")


#: Blocks whose chunks a reader with room for all of them gets.
_GROUP = 256


def _row(source: str, *numbers: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"source": [source], **dict(zip(("part", "first", "last", "chunks", "digest", "reads"), ([n] for n in numbers), strict=True))})


@query(
    "x09_block_cache",
    f"""{_STORED}, a AS (SELECT source, block, lag(block) OVER (PARTITION BY source ORDER BY doc_id, block) AS last FROM documents JOIN x USING (text))
    SELECT source, count(*) AS chunks, count(*) FILTER (last IS DISTINCT FROM block) AS reads_of_one, count(DISTINCT block) AS reads_of_all FROM a GROUP BY 1""",
)
def x09_cache(spark: SparkSession, d: str) -> DataFrame:
    """Each source's files read in order through the kept blocks: with room for one block, a
    read for every change of block; with room for all, one for each block.

    The order is cut into ranges, each read by itself; a range that begins with the block its
    source had last would not have read it again.  With room for all, a block's reads don't
    depend on other blocks: a reader gets the chunks of _GROUP blocks, and room for these."""
    path = _plain(spark, d)
    slots = scans.positions(_docs(spark, d).select("doc_id", "source"), "doc_id", "file_idx")
    wanted = tree.file_chunks(read_table(spark, path, "chunk_table", **ROOM), read_table(spark, path, "chunks", **ROOM)).join(slots, "file_idx")
    rows = materialize(wanted.select("source", "doc_id", "section_idx", "offset", "size"), "wanted")
    order = ["source", "doc_id", "section_idx"]
    out = "source string, part long, first long, last long, chunks long, digest long, reads long"

    def read(room: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """A row for each run of one source and part: its first and last block, chunks and reads."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            opened, reader, now, done = None, None, None, None
            for batch in batches:
                for source, part, number, offset, size in zip(*(batch.column(c).to_pylist() for c in ("source", "part", "section_idx", "offset", "size")), strict=True):
                    opened = opened or open_image({"path": path})
                    if (source, part) != now:
                        if now is not None:
                            yield _row(*done, reader.block_reads)
                        now, done, reader = (source, part), [source, part, number, number, 0, 0], opened.fresh(block_cache_size_limit=room)
                    done[3], done[4] = number, done[4] + 1
                    done[5] ^= xxhash.xxh3_64_intdigest(reader.chunk(number, offset, size, BLOCK), number * BLOCK + offset) >> 1
            if now is not None:
                yield _row(*done, reader.block_reads)

        return run

    ranged = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id().cast("long")).sortWithinPartitions(*order)
    one = materialize(ranged.mapInArrow(read(BLOCK), out), "reads")
    again = F.lag("last").over(Window.partitionBy("source").orderBy("part")) == F.col("first")
    one = one.withColumn("reads", F.col("reads") - F.coalesce(again.cast("long"), F.lit(0)))
    dealt = rows.withColumn("part", F.expr(f"section_idx div {_GROUP}")).repartition("source", "part").sortWithinPartitions("source", "part", "doc_id", "section_idx")
    every = dealt.mapInArrow(read(_GROUP * BLOCK), out)

    def sums(df: DataFrame, chunks: str, reads: str, digest: str) -> DataFrame:
        return df.groupBy("source").agg(F.sum("chunks").alias(chunks), F.sum("reads").alias(reads), F.bit_xor("digest").alias(digest))

    both = sums(one, "chunks", "reads_of_one", "digest").join(sums(every, "n", "reads_of_all", "other"), "source")
    same = (F.col("n") == F.col("chunks")) & (F.col("digest") == F.col("other"))
    return both.select("source", F.when(same, F.col("chunks")).otherwise(F.raise_error(F.lit("readers differ")).cast("long")).alias("chunks"), "reads_of_one", "reads_of_all")


@query("p10_chunk_accessors", f"{_STORED} SELECT doc_id, block AS section_idx, chunk_offset, size FROM documents JOIN x USING (text)")
def p10(spark: SparkSession, d: str) -> DataFrame:
    """Section, offset and size of every file's chunks in a written image."""
    path = _plain(spark, d)
    slots = scans.positions(_docs(spark, d).select("doc_id"), "doc_id", "file_idx")
    found = tree.file_chunks(read_table(spark, path, "chunk_table", **ROOM), read_table(spark, path, "chunks", **ROOM)).join(slots, "file_idx")
    return found.select("doc_id", "section_idx", F.col("offset").alias("chunk_offset"), "size")


@query("o08_section_order", f"{_STORED} SELECT k AS section_number, k * {BLOCK + 64} AS section_offset, least({BLOCK}, total - k * {BLOCK})::BIGINT AS payload_size FROM ({_BLOCKS})")
def o08(spark: SparkSession, d: str) -> DataFrame:
    """Blocks sealed in parallel stand in the file in their order."""
    sections = read_table(spark, _plain(spark, d), "sections", section_index="build", verify="slow")
    return sections.where("section_type = 0").select("section_number", F.col("offset").alias("section_offset"), "payload_size")


@query("s15_section_types", f"{_STORED} SELECT 'BLOCK' AS section_type, count(*) AS n FROM ({_BLOCKS}) UNION ALL SELECT 'METADATA_V2', 1 UNION ALL SELECT 'METADATA_V2_SCHEMA', 1 UNION ALL SELECT 'SECTION_INDEX', 1")
def s15(spark: SparkSession, d: str) -> DataFrame:
    """The sections of a written image, from its index."""
    sections = read_table(spark, _plain(spark, d), "sections", section_index="use_embedded")
    return sections.groupBy(C.section_type_name(F.col("section_type")).alias("section_type")).agg(F.count("*").alias("n"))


@query("a07_compression_ratio", f"{_STORED} SELECT sum({_BYTES})::BIGINT AS bytes, (SELECT sum(n)::BIGINT FROM u) AS stored, (SELECT sum(n)::BIGINT FROM u)::DOUBLE / sum({_BYTES})::BIGINT AS ratio FROM documents")
def a07(spark: SparkSession, d: str) -> DataFrame:
    """What an image stores for the bytes of its files, equal contents once."""
    path = _plain(spark, d)
    stored = read_table(spark, path, "sections").where("section_type = 0").agg(F.sum("payload_size").alias("stored"))
    total = _docs(spark, d).agg(F.sum(F.octet_length("text")).cast("long").alias("bytes"))
    return total.crossJoin(stored).withColumn("ratio", F.col("stored") / F.col("bytes"))


@query("b12_accessors", f"SELECT {BLOCK}::BIGINT AS block_size, 0::BIGINT AS inode_num, 'dir' AS kind, count(DISTINCT lang) AS entries FROM documents")
def b12(spark: SparkSession, d: str) -> DataFrame:
    """The block size and the root of a catalogue, and what the root lists."""
    c = _catalogue(spark, d)
    listed = tree.directory_entries(c["directories"], c["dir_entries"]).groupBy(F.col("dir_inode").alias("inode_num")).agg(F.count("*").alias("entries"))
    return build.root(c).join(listed, "inode_num").select(F.lit(build.block_size(c)).cast("long").alias("block_size"), "inode_num", "kind", "entries")


# Contents: checksums and content-defined chunks.


@query(
    "f07_checksums",
    """SELECT doc_id, damage, verify, CASE WHEN damage = 'payload' AND verify <> 'none' OR damage = 'forged' AND verify = 'slow' THEN 'checksum' ELSE 'ok' END AS outcome
    FROM documents, (VALUES ('none'), ('payload'), ('forged')) a(damage), (VALUES ('none'), ('fast'), ('slow')) b(verify) WHERE text <> ''""",
)
def f07(spark: SparkSession, d: str) -> DataFrame:
    """A sealed text, one with a changed byte, and one whose fast checksum was
    made to fit the change, read with each way to verify: the last is found by the slow one alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = section.seal(3, section.BLOCK, text.encode())
                header, payload = section.parse_header(whole), whole[64:]
                hurt = bytes([payload[0] ^ 1]) + payload[1:]
                forged = section.Header(header.number, header.type, header.algo, header.size, section.fast_hash(header, hurt), header.slow)
                for damage, data in (("none", whole), ("payload", header.pack() + hurt), ("forged", forged.pack() + hurt)):
                    for how in ("none", "fast", "slow"):
                        rows.append((doc_id, damage, how, _kind(lambda x=data, h=how: section.read_section(lambda o, n: x[o : o + n], 0, len(x), h))))
            if rows:
                kinds = [pa.int64(), *[pa.string()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "damage", "verify", "outcome"])

    return _docs(spark, d).where("text <> ''").select("doc_id", "text").mapInArrow(run, "doc_id long, damage string, verify string, outcome string")


@query("x03_cdc_boundaries")
def x03_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Where the content-defined chunks of each text begin, their sizes, and their SHA-512/256
    digests as deduplication keys them (no SQL; held against a bitwise version)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, parts in zip(batch.column(0).to_pylist(), cdc.chunked([t.encode() for t in batch.column(1).to_pylist()]), strict=True):
                start = 0
                for part in parts:
                    rows.append((doc_id, start, len(part), hashlib.new("sha512_256", part).hexdigest()))
                    start += len(part)
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "size", "digest"])

    return _docs(spark, d).where("text <> ''").select("doc_id", "text").mapInArrow(run, "doc_id long, start long, size long, digest string")


@query("a09_sha512_256")
def a09_long(spark: SparkSession, d: str) -> DataFrame:
    """The SHA-512/256 of each file, read back from an image (DuckDB has no such digest)."""
    path = _plain(spark, d)
    from quern.sources.image_writer import extract

    content = extract(read_catalogue(spark, path, **ROOM), read_table(spark, path, "blocks", **ROOM))
    slots = scans.positions(_docs(spark, d).select("doc_id"), "doc_id", "file_idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashlib.new("sha512_256", c).hexdigest() for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "digest"])

    return slots.join(content, "file_idx").select("doc_id", "content").mapInArrow(run, "doc_id long, digest string")


# Trees of the operating system.


def _written_tree(spark: SparkSession, d: str) -> str:
    """The documents as files lang/source/id.txt in the shared folder."""
    root = new_path(spark, "tree").removeprefix("file://")
    os.makedirs(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Texts are written from their batch, none of them a Python value.
            for doc_id, lang, source, text in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3).cast(pa.binary()), strict=True):
                os.makedirs(f"{root}/{lang}/{source}", exist_ok=True)
                name = f"{root}/{lang}/{source}/{doc_id}.txt"
                with open(name, "wb") as f:
                    f.write(text.as_buffer())
                os.chmod(name, 0o4640 | doc_id % 8)
                os.utime(name, (doc_id * 60 + 7, doc_id * 60))
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["doc_id"])

    # Arrow's batches count rows, 10,000 of any size, each of which every task would hold.
    held = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = spark.conf.get(held)
    spark.conf.set(held, "256")
    try:
        _docs(spark, d).select("doc_id", "lang", "source", "text").mapInArrow(run, "doc_id long").count()
    finally:
        spark.conf.set(held, rows)
    return root


@query(
    "s16_tree_scan",
    f"{_TREE} SELECT t.path, t.kind, CASE WHEN t.kind = 'file' THEN {_BYTES}::BIGINT END AS bytes, CASE WHEN t.kind = 'file' THEN sha256(text) END AS digest FROM t LEFT JOIN documents ON t.kind = 'file' AND t.seq = doc_id + 1000000000",
)
def s16(spark: SparkSession, d: str) -> DataFrame:
    """S16, D: a tree of the operating system, listed and read by tasks."""
    entries = materialize(scan_tree(spark, _written_tree(spark, d)), "scanned").withColumnsRenamed({"seq": "node", "parent_seq": "parent"})
    rows = tree.paths(entries.select("node", "parent", "name", "kind", "content"))
    return rows.select("path", "kind", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("digest"))


@query("s17_os_metadata", "SELECT doc_id || '.txt' AS name, (416 + doc_id % 8)::BIGINT AS mode, doc_id * 60 AS mtime FROM documents")
def s17(spark: SparkSession, d: str) -> DataFrame:
    """Permission bits (the set-user bit is left out) and modification times, as the system has
    them (reading changes the times of access)."""
    files = scan_tree(spark, _written_tree(spark, d)).where("kind = 'file'")
    return files.select("name", "mode", "mtime")
