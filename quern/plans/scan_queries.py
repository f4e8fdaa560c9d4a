"""Queries of the prefix scans, deltas, runs, islands, dictionaries and renumbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import scans
from quern.plans.registry import query, table


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 7).alias("n"))


@query("w01_prefix_unpack", "SELECT o_orderkey, sum(o_custkey % 7) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS first_chunk FROM orders")
def w01(spark: SparkSession, d: str) -> DataFrame:
    return scans.prefix_sum(_orders(spark, d), "o_orderkey", F.col("n"), "first_chunk").select("o_orderkey", "first_chunk")


@query(
    "w02_directories_unpack",
    "SELECT c_custkey, sum(n) OVER (ORDER BY c_custkey ROWS UNBOUNDED PRECEDING)::BIGINT AS first_entry FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)",
)
def w02(spark: SparkSession, d: str) -> DataFrame:
    """Entries per directory, summed to where each directory's entries end."""
    sizes = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    dirs = table(spark, d, "customer").select("c_custkey").join(sizes, "c_custkey", "left").fillna(0, ["n"])
    return scans.prefix_sum(dirs, "c_custkey", F.col("n"), "first_entry").select("c_custkey", "first_entry")


@query(
    "w03_string_offsets",
    """SELECT pos, string_offset FROM (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pos, (sum(octet_length(encode(p_name))) OVER (ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) - octet_length(encode(p_name)))::BIGINT AS string_offset FROM part)
    UNION ALL SELECT count(*), coalesce(sum(octet_length(encode(p_name))), 0)::BIGINT FROM part""",
)
def w03(spark: SparkSession, d: str) -> DataFrame:
    """Exclusive offsets of a string table and, last, its total length."""
    return scans.offsets(table(spark, d, "part"), "p_partkey", "p_name").withColumnRenamed("offset", "string_offset")


@query("w04_delta_pack", "SELECT o_orderkey, o_totalprice::BIGINT - coalesce(lag(o_totalprice::BIGINT) OVER (ORDER BY o_orderkey), 0) AS stored FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders)")
def w04(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("v"))
    return scans.delta(rows, "o_orderkey", "v", "stored").select("o_orderkey", "stored")


@query("w05_rle_expand", "SELECT p_partkey AS slot, unnest(range(p_size % 5 + 2)) * 0 + p_partkey AS file_slot FROM part")
def w05(spark: SparkSession, d: str) -> DataFrame:
    """Each position repeated by its stored value and two."""
    return scans.expand_runs(table(spark, d, "part"), F.col("p_partkey"), F.col("p_size") % 5, "file_slot").select(F.col("p_partkey").alias("slot"), "file_slot")


@query("w05_rle_pack", "SELECT l_suppkey, count(*) - 2 AS stored FROM lineitem GROUP BY 1")
def w05_pack(spark: SparkSession, d: str) -> DataFrame:
    return scans.pack_runs(table(spark, d, "lineitem"), "l_suppkey")


@query("w06_string_slices", "SELECT p_partkey, p_name AS slice FROM part")
def w06(spark: SparkSession, d: str) -> DataFrame:
    """Names cut again out of a string table's buffer, which is kept in parts of as many rows:
    each slice meets the part that holds it."""
    names = scans.bucketed(table(spark, d, "part").select("p_partkey", "p_name", F.octet_length("p_name").cast("long").alias("bytes")), "p_partkey")
    total = scans.prefix_sum(names.select("p_partkey", "bytes", F.col("bucket").alias("part")), "p_partkey", F.col("bytes"), "start", inclusive=False)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda s: s["p_name"]), "").cast("binary")
    buffers = names.groupBy(F.col("bucket").alias("part")).agg(text.alias("buffer"))
    begins = total.groupBy("part").agg(F.min("start").alias("begin"))
    cut = F.substring(F.col("buffer"), (F.col("start") - F.col("begin") + 1).cast("int"), F.col("bytes").cast("int")).cast("string")
    return total.join(buffers.join(begins, "part"), "part").select("p_partkey", cut.alias("slice"))


@query("w07_section_offsets", "SELECT o_orderkey, (sum(64 + o_custkey) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) - 64 - o_custkey)::BIGINT AS section_offset FROM orders")
def w07(spark: SparkSession, d: str) -> DataFrame:
    """Where each section begins, headers counted."""
    return scans.prefix_sum(_orders(spark, d), "o_orderkey", F.col("o_custkey") + 64, "section_offset", inclusive=False).select("o_orderkey", "section_offset")


@query("w08_dictionary_encode", "SELECT o_orderpriority AS value, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS pos FROM orders GROUP BY 1")
def w08(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values numbered in order of first appearance."""
    return scans.dictionary(table(spark, d, "orders"), "o_orderkey", "o_orderpriority")


@query("j01_dictionary_join", "SELECT o_orderkey, pos AS code FROM orders JOIN (SELECT o_clerk, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS pos FROM (SELECT o_orderkey, o_custkey % 1000 AS o_clerk FROM orders) GROUP BY 1) ON o_custkey % 1000 = o_clerk")
def j01(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 1000).alias("clerk"))
    return scans.encode(rows, "o_orderkey", "clerk", "code").select("o_orderkey", "code")


@query("w09_renumber_by_kind", "SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey % 5, o_orderkey) - 1 AS inode_num FROM orders")
def w09(spark: SparkSession, d: str) -> DataFrame:
    """New numbers, sorted by kind and stable inside each."""
    return scans.renumber(table(spark, d, "orders"), F.col("o_custkey") % 5, "o_orderkey", "inode_num", 5).select("o_orderkey", "inode_num")


@query(
    "w10_first_entry",
    """WITH s AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)
    SELECT c_custkey, (1 + sum(n) OVER (ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS first_entry FROM s
    UNION ALL SELECT max(c_custkey) + 1, (1 + sum(n))::BIGINT FROM s""",
)
def w10(spark: SparkSession, d: str) -> DataFrame:
    """Each directory's first entry, and the sentinel."""
    sizes = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    dirs = table(spark, d, "customer").select("c_custkey").join(sizes, "c_custkey", "left").fillna(0, ["n"])
    placed = scans.prefix_sum(dirs, "c_custkey", F.col("n"), "end")
    sentinel = placed.agg((F.max("c_custkey") + 1).alias("c_custkey"), (F.max("end") + 1).alias("first_entry"))
    return placed.select("c_custkey", (1 + F.col("end") - F.col("n")).alias("first_entry")).unionByName(sentinel)


@query("w11_monotonic_violations", "SELECT event_id FROM (SELECT event_id, user_id, lag(user_id) OVER (ORDER BY event_id) AS before FROM events) WHERE before >= user_id")
def w11(spark: SparkSession, d: str) -> DataFrame:
    """Rows that do not rise."""
    return scans.not_rising(table(spark, d, "events"), "event_id", "user_id").select("event_id")


@query("w12_is_sorted", "SELECT count(*) FILTER (before > event_id) = 0 AS is_sorted FROM (SELECT event_id, lag(event_id) OVER (ORDER BY event_id) AS before FROM events)")
def w12(spark: SparkSession, d: str) -> DataFrame:
    return scans.is_sorted(table(spark, d, "events").withColumn("v", F.col("event_id")), "event_id", "v")


@query(
    "w13_coalesce_chunks",
    """WITH c AS (SELECT o_custkey % 20 AS section, o_orderkey // 2 * 4 + o_orderkey % 2 * 2 AS at, 2 AS size FROM orders),
    m AS (SELECT *, CASE WHEN lag(at + size) OVER (PARTITION BY section ORDER BY at) = at THEN 0 ELSE 1 END AS begins FROM c),
    i AS (SELECT *, sum(begins) OVER (PARTITION BY section ORDER BY at ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT section, min(at)::BIGINT AS chunk_offset, sum(size)::BIGINT AS size, count(*) AS merged FROM i GROUP BY section, island""".replace(" at", " pos").replace("(at", "(pos"),
)
def w13(spark: SparkSession, d: str) -> DataFrame:
    """Chunks merged where one goes on at the end of the one before."""
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("section"), F.expr("o_orderkey div 2 * 4 + o_orderkey % 2 * 2").alias("chunk_offset"), F.lit(2).cast("long").alias("size"))
    return scans.islands(rows, ["section"], "chunk_offset", "size")


@query("o01_sort_entries", "SELECT o_custkey, o_orderpriority, o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderpriority, o_orderkey) AS entry_idx FROM orders")
def o01(spark: SparkSession, d: str) -> DataFrame:
    """O1: entries by directory and name, each with its place."""
    placed = scans.ranked(table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), ["o_custkey", "o_orderpriority", "o_orderkey"], "place")
    return placed.select("o_custkey", "o_orderpriority", "o_orderkey", (F.col("place") + 1).alias("entry_idx"))


@query("o03_range_iterator", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")
def o03(spark: SparkSession, d: str) -> DataFrame:
    """O3: the iterator's skip and take, the feature itself."""
    return table(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").offset(25).limit(10)


@query("o04_reverse_iteration", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 10 OFFSET 5")
def o04(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey").orderBy(F.desc("o_orderkey")).offset(5).limit(10)
