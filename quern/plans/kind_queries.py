"""Queries over an image of all kinds of entries, made of the part table, and of the codecs'
number formats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.codec import frozen, thrift
from quern.functions import columns as C
from quern.model import TABLES
from quern.operators import build, tree, validate
from quern.plans.image_queries import _TREE, _tree
from quern.plans.registry import query, table
from quern.scratch import materialize

_KINDS = ("dir", "file", "symlink", "blkdev", "chardev", "fifo", "hardlink")


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """A root (seq 0) and an entry for each part, its kind by the key; links lead to files."""
    key = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (key % 7 + 1).cast("int"))
    none = lambda t: F.lit(None).cast(t)
    rows = table(spark, d, "part").select(
        (key + 1).alias("seq"), F.lit(0).cast("long").alias("parent_seq"), F.concat(F.lit("n"), key.cast("string")).alias("name"), kind.alias("kind"),
        F.when(key % 7 == 6, key - 4).alias("link_to"), (F.col("p_size").cast("long") % 512).alias("mode"), (key % 11).alias("uid"), (key % 5).alias("gid"),
        (key * 100).alias("mtime"), (key * 100 + 1).alias("atime"), (key * 100 + 2).alias("ctime"), F.when(key % 7 == 2, F.col("p_type")).alias("target"),
        F.when((key % 7).isin(3, 4), key.cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("decimal(20,0)").alias("device_id"), none("binary").alias("content"),
    )
    zero = F.lit(0).cast("long")
    root = spark.range(1).select(
        zero.alias("seq"), none("long").alias("parent_seq"), F.lit("").alias("name"), F.lit("dir").alias("kind"), none("long").alias("link_to"), F.lit(493).cast("long").alias("mode"),
        zero.alias("uid"), zero.alias("gid"), zero.alias("mtime"), zero.alias("atime"), zero.alias("ctime"), none("string").alias("target"), none("decimal(20,0)").alias("device_id"), none("binary").alias("content"),
    )
    return materialize(root.unionByName(rows), "entries")


def _catalogue(spark: SparkSession, d: str, **config: object) -> dict[str, DataFrame]:
    chunks = spark.createDataFrame([], "seq long, idx long, section_idx long, offset long, size long")
    return build.catalogue(_entries(spark, d), chunks, **config)


def _named(c: dict[str, DataFrame]) -> DataFrame:
    names = c["names"].select(F.col("pos").alias("name_index"), F.col("value").alias("name"))
    return c["dir_entries"].where("entry_idx > 0").join(names, "name_index").select("name", "inode_num")


_DIRS = "(SELECT count(*) FROM part WHERE p_partkey % 7 = 0) + 1"


@query("p08_symlink_targets", "SELECT 'n' || p_partkey AS name, p_type AS target FROM part WHERE p_partkey % 7 = 2")
def p08(spark: SparkSession, d: str) -> DataFrame:
    """Targets through the symlink table and its dictionary."""
    c = _catalogue(spark, d)
    start = build.tally(c)["symlink"]
    placed = c["symlink_table"].select((F.col("pos") + start).alias("inode_num"), F.col("target_index").alias("t"))
    targets = c["symlinks"].select(F.col("pos").alias("t"), F.col("value").alias("target"))
    return _named(c).join(placed, "inode_num").join(targets, "t").select("name", "target")


@query("b05_device_nodes", "SELECT 'n' || p_partkey AS name, (p_partkey::HUGEINT + 9223372036854775808)::DECIMAL(20,0) AS device_id FROM part WHERE p_partkey % 7 IN (3, 4)")
def b05(spark: SparkSession, d: str) -> DataFrame:
    """Ids of devices, beyond 63 bits."""
    c = _catalogue(spark, d)
    start = build.tally(c)["device"]
    return _named(c).join(c["devices"].select((F.col("pos") + start).alias("inode_num"), "device_id"), "inode_num").select("name", "device_id")


@query("b07_hard_links", "SELECT 'n' || p_partkey AS name, 'n' || (p_partkey - 5) AS target FROM part WHERE p_partkey % 7 = 6")
def b07(spark: SparkSession, d: str) -> DataFrame:
    """Entries that share an inode."""
    listed = materialize(_named(_catalogue(spark, d)), "listed").withColumn("key", F.substring("name", 2, 20).cast("long"))
    other = listed.where("key % 7 = 1").select("inode_num", F.col("name").alias("target"))
    return listed.where("key % 7 = 6").join(other, "inode_num").select("name", "target")


@query(
    "f01_kinds_of_inodes",
    f"SELECT 'dir' AS kind, {_DIRS} AS n, true AS as_stored UNION ALL SELECT CASE p_partkey % 7 WHEN 1 THEN 'file' WHEN 2 THEN 'symlink' WHEN 5 THEN 'ipc' ELSE 'device' END, count(*), true FROM part WHERE p_partkey % 7 NOT IN (0, 6) GROUP BY 1",
)
def f01_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds by number ranges agree with what the builder was given."""
    c = _catalogue(spark, d)
    kind = C.classify(F.col("inode_num"), {k: F.lit(v) for k, v in build.tally(c).items()})
    return c["inodes"].groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.min(kind == F.col("kind")).alias("as_stored"))


@query(
    "b09_builder_config",
    "SELECT 'n' || p_partkey AS name, least(p_partkey * 100, 90000) // 60 AS mtime_offset, 0::BIGINT AS atime_offset FROM part WHERE p_partkey % 7 <> 6",
)
def b09(spark: SparkSession, d: str) -> DataFrame:
    """Modification times only, in minutes, clamped to the build's epoch."""
    c = _catalogue(spark, d, mtime_only=True, time_resolution_sec=60, source_date_epoch=90000)
    stored = c["inodes"].select("inode_num", "mtime_offset", "atime_offset")
    return _named(c).where(F.substring("name", 2, 20).cast("long") % 7 != 6).join(stored, "inode_num").select("name", "mtime_offset", "atime_offset")


@query("b11_string_table", "SELECT sum(octet_length(encode('n' || p_partkey)))::BIGINT AS bytes, count(*) AS n FROM part")
def b11(spark: SparkSession, d: str) -> DataFrame:
    """The packed table of names: a value for each, and its length."""
    return _catalogue(spark, d)["names"].agg(F.sum(F.octet_length("value")).alias("bytes"), F.count("*").alias("n"))


#: What breaks each rule: a table, and values of a row besides its key; the key is its place here.
_FAR = 1 << 31
_BROKEN = [
    ("chunks", {"section_idx": _FAR}, ["chunk_section"]),
    ("chunks", {"offset": 49_000, "size": 153}, ["chunk_in_block"]),
    ("directories", {"first_entry": _FAR}, ["directory_first_entry"]),
    ("directories", {"parent_entry": _FAR}, ["directory_parent_entry"]),
    ("directories", {"self_entry": _FAR}, ["directory_self_entry"]),
    ("inodes", {"mode_index": _FAR}, ["inode_mode"]),
    ("inodes", {"owner_index": _FAR}, ["inode_owner"]),
    ("inodes", {"group_index": _FAR}, ["inode_group"]),
    ("inodes", {"mtime_offset": 1 << 32}, ["mtime_overflow"]),
    ("inodes", {"atime_offset": 1 << 32}, ["atime_overflow", "mtime_only"]),
    ("inodes", {"ctime_offset": 1 << 32}, ["ctime_overflow", "mtime_only"]),
    ("inodes", {"atime_offset": 1}, ["mtime_only"]),
    ("inodes", {"mtime_offset": (1 << 32) - 1}, []),
    ("chunks", {"offset": 49_000, "size": 152}, []),
    ("chunk_table", {"first_chunk": _FAR}, ["chunk_table"]),
    ("symlink_table", {"target_index": _FAR}, ["symlink_target"]),
    ("dir_entries", {"inode_num": _FAR}, ["entry_inode"]),
    ("dir_entries", {"name_index": _FAR}, ["entry_name"]),
]
_RULES = ", ".join(f"('{rule}', {900_000 + i})" for i, (_, _, rules) in enumerate(_BROKEN) for rule in rules)


@query("f06_catalogue_rules", f"SELECT rule, place::BIGINT AS \"at\" FROM (VALUES ('block_size_power_of_two', 0), ('root_entry', 0), {_RULES}) t(rule, place)")
def f06_rules(spark: SparkSession, d: str) -> DataFrame:
    """an image of all kinds, with rows that break a rule each (or just do not): each is found
    where it is, and nothing else."""
    c = _catalogue(spark, d, mtime_only=True)
    c["sections"] = spark.createDataFrame([(0, 0, 0, 0, 0, 0, None, None)], TABLES["sections"])
    for i, (name, values, _) in enumerate(_BROKEN):
        fields = TABLES[name].fields
        row = [900_000 + i if k == 0 else values.get(f.name, "file" if f.name == "kind" else 0) for k, f in enumerate(fields)]
        c[name] = c[name].unionByName(spark.createDataFrame([tuple(row)], TABLES[name]))
    c["dir_entries"] = c["dir_entries"].unionByName(spark.createDataFrame([(0, 0, 5)], TABLES["dir_entries"]))
    c["options"] = c["options"].withColumn("block_size", F.lit(49_152).cast("long"))
    return validate.violations(c)


@query("s14_directories", f"{_TREE} SELECT path FROM t WHERE kind = 'dir'")
def s14(spark: SparkSession, d: str) -> DataFrame:
    """Directories alone."""
    return _tree(spark, d).where("kind = 'dir'").select("path")


@query("u01_root_union", f"{_TREE} SELECT path, seq = 0 AS is_root FROM t")
def u01(spark: SparkSession, d: str) -> DataFrame:
    """The root's own row in front of the entries."""
    listed = _tree(spark, d)
    return listed.where("parent is null").select("path", F.lit(True).alias("is_root")).unionByName(listed.where("parent is not null").select("path", F.lit(False).alias("is_root")))


@query("u04_distinct_layouts", "SELECT DISTINCT p_size % 3 * 4 AS width, length(p_type) % 2 = 0 AS nested FROM part")
def u04(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select((F.col("p_size") % 3 * 4).alias("width"), (F.length("p_type") % 2 == 0).alias("nested")).distinct()


def _batched(df: DataFrame, schema: str, f: object) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return df.mapInArrow(run, schema)


@query("c05_varint", "SELECT o_orderkey, CASE WHEN o_custkey * 1000 < 128 THEN 1 WHEN o_custkey * 1000 < 16384 THEN 2 WHEN o_custkey * 1000 < 2097152 THEN 3 WHEN o_custkey * 1000 < 268435456 THEN 4 ELSE 5 END AS bytes, o_custkey * 1000 AS back FROM orders")
def c05(spark: SparkSession, d: str) -> DataFrame:
    """Numbers as variable-length bytes and back."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coded = [thrift.varint(v * 1000) for v in batch.column(1).to_pylist()]
        back = [thrift._Reader(c).varint() for c in coded]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, coded), pa.int32()), pa.array(back, pa.int64())], ["o_orderkey", "bytes", "back"])

    return _batched(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey long, bytes int, back long", run)


@query("c08_bit_columns", "SELECT o_orderkey, o_custkey AS back FROM orders")
def c08(spark: SparkSession, d: str) -> DataFrame:
    """A column packed to as few bits as its widest value needs, and loaded at any bit."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = batch.column(1).to_numpy().astype(np.uint64)
        bits = max(1, int(values.max()).bit_length())
        packed = np.packbits(((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
        back = frozen.load_bits(packed, np.arange(len(values)) * bits, bits)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(back.astype(np.int64))], ["o_orderkey", "back"])

    return _batched(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey long, back long", run)


@query("c11_frozen_roundtrip", "SELECT p_partkey, p_name AS name, p_size::BIGINT AS size, p_partkey * 3 AS device FROM part")
def c11(spark: SparkSession, d: str) -> DataFrame:
    """Rows written as a metadata section with its schema, and decoded again."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, name, size = (c.to_pylist() for c in batch.columns)
        meta = frozen.empty()
        meta |= {"names": [n.encode() for n in name], "devices": [k * 3 for k in key], "chunks": {"block": key, "offset": [0] * len(key), "size": size}}
        schema, data = frozen.encode(meta)
        back = frozen.decode(thrift.parse(thrift.to_bytes(schema)), data)
        columns = [pa.array(back["chunks"]["block"].astype(np.int64)), pa.array([n.decode() for n in back["names"]]), pa.array(back["chunks"]["size"].astype(np.int64)), pa.array(back["devices"].astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, ["p_partkey", "name", "size", "device"])

    return _batched(table(spark, d, "part").select("p_partkey", "p_name", "p_size"), "p_partkey long, name string, size long, device long", run)


@query("j12_self_and_parent_entries", f"{_TREE} SELECT count(*) AS directories, 0::BIGINT AS wrong FROM t WHERE kind = 'dir'")
def j12(spark: SparkSession, d: str) -> DataFrame:
    """Each directory's own entry leads back to it, and its parent's to its parent."""
    from quern.plans.image_queries import _catalogue as of_documents

    c = of_documents(spark, d)
    at = c["dir_entries"].select(F.col("entry_idx").alias("self_entry"), F.col("inode_num").alias("own"))
    dirs = c["directories"].join(c["inodes"].where("kind = 'dir'").select("inode_num"), "inode_num").join(at, "self_entry")
    holder = tree.directory_entries(c["directories"], c["dir_entries"]).select(F.col("entry_idx").alias("self_entry"), "dir_inode")
    parent = c["dir_entries"].select(F.col("entry_idx").alias("parent_entry"), F.col("inode_num").alias("above"))
    checked = dirs.join(holder, "self_entry", "left").join(parent, "parent_entry", "left")
    wrong = (F.col("own") != F.col("inode_num")) | F.coalesce(F.col("above") != F.col("dir_inode"), F.col("inode_num") != 0)
    return checked.agg(F.count("*").alias("directories"), F.count_if(wrong).alias("wrong"))
