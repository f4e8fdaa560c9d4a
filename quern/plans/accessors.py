"""Queries of the accessors: modes, times, section entries, dictionaries, kinds and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import columns as C
from quern.model import COMPRESSIONS, SECTION_TYPES, dimension
from quern.operators import scans
from quern.plans.registry import query, table

_TYPES = (0o040000, 0o100000, 0o120000, 0o060000, 0o020000, 0o010000, 0o140000, 0o170000)
_MODES = "(CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_TYPES)) + " END + (p_partkey * 83 + p_size * 7) % 4096)"


def _modes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.expr(f"cast({_MODES} as long)").alias("mode"))


@query("p02_dictionary_modes", f"SELECT p_partkey, {_MODES}::BIGINT AS mode FROM part")
def p02(spark: SparkSession, d: str) -> DataFrame:
    """Modes stored as dictionary positions, read back through the dictionary."""
    coded = scans.encode(_modes(spark, d), "p_partkey", "mode", "mode_index")
    words = scans.dictionary(_modes(spark, d), "p_partkey", "mode")
    return coded.drop("mode").join(words, F.col("mode_index") == F.col("pos")).select("p_partkey", F.col("value").alias("mode"))


@query("p01_owner_lookup", "SELECT o_orderkey, o_custkey % 97 AS uid, o_custkey % 13 AS gid FROM orders")
def p01(spark: SparkSession, d: str) -> DataFrame:
    """Uid and gid through their dictionaries."""
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 97).alias("uid"), (F.col("o_custkey") % 13).alias("gid"))
    out = rows
    for name in ("uid", "gid"):
        words = scans.dictionary(rows, "o_orderkey", name)
        back = words.select(F.col("pos").alias(f"{name}_index"), F.col("value").alias(f"{name}_value"))
        out = out.join(words.select(F.col("value").alias(name), F.col("pos").alias(f"{name}_index")), name).drop(name).join(back, f"{name}_index").withColumnRenamed(f"{name}_value", name)
    return out.select("o_orderkey", "uid", "gid")


_STORED = "(o_orderkey % 100000)"


@query(
    "p03_time_scale",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN {_STORED} ELSE (500 + {_STORED}) * 60 END AS mtime,
      CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN {_STORED} + 1 ELSE (501 + {_STORED}) * 60 END AS atime FROM orders""",
)
def p03(spark: SparkSession, d: str) -> DataFrame:
    """Stored times with base and resolution, which count only with options."""
    key = F.col("o_orderkey")
    base, resolution, scaled, only = F.lit(500).cast("long"), F.lit(60).cast("long"), key % 3 != 0, key % 5 == 0
    return table(spark, d, "orders").select(
        "o_orderkey", C.entry_time(key % 100000, base, resolution, scaled).alias("mtime"), C.optional_time(key % 100000 + 1, base, resolution, scaled, only).alias("atime")
    )


@query("p04_mode_bits", f"SELECT p_partkey, {_MODES}::BIGINT & 61440 AS type_bits, {_MODES}::BIGINT & 4095 AS mode_bits, {_MODES}::BIGINT & 511 AS permission_bits FROM part")
def p04(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("mode")
    return _modes(spark, d).select("p_partkey", C.type_bits(m).alias("type_bits"), C.mode_bits(m).alias("mode_bits"), C.permission_bits(m).alias("permission_bits"))


_STRING_SQL = (
    "(CASE mode & 61440 WHEN 16384 THEN 'd' WHEN 32768 THEN '-' WHEN 40960 THEN 'l' WHEN 24576 THEN 'b' WHEN 8192 THEN 'c' WHEN 4096 THEN 'p' WHEN 49152 THEN 's' ELSE '?' END"
    + "".join(
        f" || CASE WHEN mode & {r} <> 0 THEN 'r' ELSE '-' END || CASE WHEN mode & {w} <> 0 THEN 'w' ELSE '-' END"
        f" || CASE WHEN mode & {s} <> 0 AND mode & {x} <> 0 THEN '{c}' WHEN mode & {s} <> 0 THEN '{c.upper()}' WHEN mode & {x} <> 0 THEN 'x' ELSE '-' END"
        for r, w, x, s, c in ((256, 128, 64, 2048, "s"), (32, 16, 8, 1024, "s"), (4, 2, 1, 512, "t"))
    )
    + ")"
)
_OCTAL_SQL = "ltrim(" + " || ".join(f"((mode >> {s}) & 7)::VARCHAR" for s in (15, 12, 9, 6, 3, 0)) + ", '0')"
_MODE_ROWS = f"(SELECT p_partkey, {_MODES}::BIGINT AS mode FROM part)"


@query("p05_mode_string", f"SELECT p_partkey, {_STRING_SQL} AS mode_string FROM {_MODE_ROWS}")
def p05(spark: SparkSession, d: str) -> DataFrame:
    return _modes(spark, d).select("p_partkey", C.mode_string(F.col("mode")).alias("mode_string"))


@query("p06_octal", f"SELECT p_partkey, {_OCTAL_SQL} AS octal, '0o' || {_OCTAL_SQL} || '/' || {_STRING_SQL} AS debug FROM {_MODE_ROWS}")
def p06(spark: SparkSession, d: str) -> DataFrame:
    return _modes(spark, d).select("p_partkey", C.octal(F.col("mode")).alias("octal"), C.mode_debug(F.col("mode")).alias("debug"))


@query("p09_device_ids", "SELECT o_orderkey, (o_orderkey::HUGEINT * 1229782938247 % 18446744073709551615)::DECIMAL(20,0) AS device_id FROM orders")
def p09(spark: SparkSession, d: str) -> DataFrame:
    """Unsigned 64-bit ids as decimals of 20 digits."""
    wide = F.col("o_orderkey").cast("decimal(20,0)") * F.lit("1229782938247").cast("decimal(14,0)")
    return table(spark, d, "orders").select("o_orderkey", (wide % F.lit("18446744073709551615").cast("decimal(20,0)")).cast("decimal(20,0)").alias("device_id"))


_ENTRY = "(l_linenumber::BIGINT * 281474976710656 + (l_orderkey * 1000 + l_partkey))"


@query("p11_index_entry_split", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber::BIGINT AS section_type, l_orderkey * 1000 + l_partkey AS section_offset FROM lineitem")
def p11(spark: SparkSession, d: str) -> DataFrame:
    """Section entries packed into 64 bits and split again."""
    packed = C.pack_index_entry(F.col("l_linenumber"), F.col("l_orderkey") * 1000 + F.col("l_partkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", packed.alias("entry")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.index_entry_type(F.col("entry")).alias("section_type"), C.index_entry_offset(F.col("entry")).alias("section_offset")
    )


@query("p12_index_entry_pack", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_ENTRY} AS entry FROM lineitem")
def p12(spark: SparkSession, d: str) -> DataFrame:
    packed = C.pack_index_entry(F.col("l_linenumber"), F.col("l_orderkey") * 1000 + F.col("l_partkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", packed.alias("entry"))


_NAMES = " ".join(f"WHEN {n} THEN '{v}'" for n, v in SECTION_TYPES.items())
_ALGOS = " ".join(f"WHEN {n} THEN '{v}'" for n, v in COMPRESSIONS.items())


@query(
    "p13_enum_names",
    f"SELECT p_partkey, CASE p_partkey % 12 {_NAMES} ELSE 'SectionType(' || (p_partkey % 12) || ')' END AS type_name, CASE p_size % 10 {_ALGOS} END AS algo_name FROM part",
)
def p13(spark: SparkSession, d: str) -> DataFrame:
    """Open enums; unknown algorithms have no name in the dimension."""
    algos = dimension(spark, COMPRESSIONS).select(F.col("number").alias("algo"), F.col("name").alias("algo_name"))
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 12).alias("t"), (F.col("p_size") % 10).alias("algo"))
    return rows.join(F.broadcast(algos), "algo", "left").select("p_partkey", C.section_type_name(F.col("t")).alias("type_name"), "algo_name")


@query("c06_zigzag", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN v >= 0 THEN 2 * v ELSE -2 * v - 1 END AS zigzag, v AS back FROM (SELECT *, l_partkey - 2 * l_suppkey - l_orderkey AS v FROM lineitem)")
def c06(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("v", F.expr("l_partkey - 2 * l_suppkey - l_orderkey")).withColumn("zigzag", C.zigzag(F.col("v")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "zigzag", C.unzigzag(F.col("zigzag")).alias("back"))


@query("c21_time_clamp", "SELECT o_orderkey, least(epoch(o_orderdate)::BIGINT, 852076800) // 3600 AS stored FROM orders")
def c21(spark: SparkSession, d: str) -> DataFrame:
    """Times clamped to the build's epoch and stored in hours."""
    return table(spark, d, "orders").select("o_orderkey", C.stored_time(F.unix_timestamp("o_orderdate"), 3600, 852076800).cast("long").alias("stored"))


@query("c22_mode_compose", "SELECT p_partkey, (CASE p_partkey % 3 WHEN 0 THEN 16384 WHEN 1 THEN 32768 ELSE 40960 END | (p_size * 11 % 512))::BIGINT AS mode FROM part")
def c22(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 3 == 0, "dir").when(F.col("p_partkey") % 3 == 1, "file").otherwise("symlink")
    return table(spark, d, "part").select("p_partkey", C.compose_mode(kind, F.col("p_size") * 11 % 512).alias("mode"))


@query("c23_hex_digest", "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def c23(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.lower(F.hex(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))).alias("digest"))


_ESCAPE_SQL = """array_to_string(list_transform(range(octet_length(encode(name))), lambda i:
  CASE WHEN b[i + 1] BETWEEN 33 AND 126 AND b[i + 1] NOT IN (35, 47, 92) THEN chr(b[i + 1]::INT)
    ELSE chr(92) || (b[i + 1] >> 6)::VARCHAR || ((b[i + 1] >> 3) & 7)::VARCHAR || (b[i + 1] & 7)::VARCHAR END), '')"""


@query(
    "c18_mtree_escape",
    f"""SELECT p_partkey, {_ESCAPE_SQL} AS escaped FROM (
      SELECT p_partkey, name, list_transform(range(octet_length(encode(name))), lambda i: ('0x' || substr(hex(encode(name)), (2 * i + 1)::INT, 2))::INT) AS b
      FROM (SELECT p_partkey, p_name || ' #é/' || p_type AS name FROM part))""",
)
def c18(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", C.mtree_escape(F.concat("p_name", F.lit(" #é/"), "p_type")).alias("escaped"))


@query("c19_path_split", "SELECT page_id, len(string_split(url, '/'))::BIGINT AS depth, string_split(url, '/')[-1] AS last, array_to_string(string_split(url, '/')[4:], '/') AS path FROM pages")
def c19(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split("url", "/")
    return table(spark, d, "pages").select("page_id", F.size(parts).cast("long").alias("depth"), F.element_at(parts, -1).alias("last"), F.array_join(F.slice(parts, 4, F.size(parts)), "/").alias("path"))


@query("f13_utf8_validity", "SELECT doc_id, true AS whole, octet_length(encode(text)) > length(text) AS multibyte FROM documents")
def f13(spark: SparkSession, d: str) -> DataFrame:
    """Validity of decoded strings; repairing a valid one changes nothing."""
    raw = F.col("text").cast("binary")
    return table(spark, d, "documents").select(
        "doc_id", (F.is_valid_utf8(F.col("text")) & (C.lossy_utf8(raw) == F.col("text"))).alias("whole"), (F.octet_length("text") > F.length("text")).alias("multibyte")
    )


_RANGES = "CASE WHEN doc_id < 10 THEN 'dir' WHEN doc_id < 25 THEN 'symlink' WHEN doc_id < 300 THEN 'file' WHEN doc_id < 350 THEN 'shared' WHEN doc_id < 380 THEN 'device' ELSE 'ipc' END"


@query("f01_classify_ranges", f"SELECT doc_id, {_RANGES} AS kind FROM documents")
def f01(spark: SparkSession, d: str) -> DataFrame:
    """F1, Q5: kinds by ranges of the inode number."""
    starts = {"symlink": 10, "file": 25, "shared": 300, "device": 350, "ipc": 380}
    return table(spark, d, "documents").select("doc_id", C.classify(F.col("doc_id"), {k: F.lit(v) for k, v in starts.items()}).alias("kind"))


@query("f02_is_file", f"SELECT doc_id FROM documents WHERE {_RANGES} IN ('file', 'shared')")
def f02(spark: SparkSession, d: str) -> DataFrame:
    return f01(spark, d).where(F.col("kind").isin("file", "shared")).select("doc_id")


@query("f03_get_inode", "SELECT doc_id, lang, source FROM documents WHERE doc_id IN (7, 100000000)")
def f03(spark: SparkSession, d: str) -> DataFrame:
    """a point lookup; a number out of range gives no row."""
    return table(spark, d, "documents").where(F.col("doc_id").isin(7, 100000000)).select("doc_id", "lang", "source")


@query("f05_version_check", "SELECT p_partkey FROM part WHERE 20 + p_size % 8 BETWEEN 23 AND 25")
def f05(spark: SparkSession, d: str) -> DataFrame:
    version = F.struct(F.lit(2).alias("a"), (F.col("p_size") % 8).alias("b"))
    low, high = (F.struct(F.lit(2).alias("a"), F.lit(n).alias("b")) for n in (3, 5))
    return table(spark, d, "part").where((version >= low) & (version <= high)).select("p_partkey")
