"""Prefix scans over a global order, deltas, runs, islands and dictionaries.

A window without PARTITION BY runs in one task.  Here an order is cut into ranges of about as
many rows each, which are written: each is scanned by itself, and what comes before it is a scan
over one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.scratch import materialize


def bucketed(df: DataFrame, key: str, buckets: int | None = None) -> DataFrame:
    """``df`` with a column ``bucket`` that rises with ``key``, whose rows are dealt evenly
    however the key's values lie; rows of one value share a bucket.  There are ``buckets``, or as
    many as Spark sees fit."""
    ranged = df.repartitionByRange(buckets, key) if buckets else df.repartitionByRange(key)
    return materialize(ranged.withColumn("bucket", F.spark_partition_id().cast("long")), "buckets")


def before(df: DataFrame, value: Column) -> DataFrame:
    """(bucket, base): the sum of ``value`` in all earlier buckets; one row a bucket."""
    sums = df.groupBy("bucket").agg(F.sum(value).alias("total"))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("bucket", F.coalesce(F.sum("total").over(earlier), F.lit(0)).cast("long").alias("base"))


def prefix_sum(df: DataFrame, key: str, value: Column, out: str, inclusive: bool = True, buckets: int | None = None) -> DataFrame:
    """``df`` with the running sum of ``value`` in the order of the unique ``key``."""
    cut = bucketed(df, key, buckets)
    inside = Window.partitionBy("bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("base") + F.sum(value).over(inside) - (F.lit(0) if inclusive else value)
    return cut.join(before(cut, value), "bucket").withColumn(out, total.cast("long")).drop("bucket", "base")


def positions(df: DataFrame, key: str, out: str, buckets: int | None = None) -> DataFrame:
    """``df`` with its 0-based position in the order of the unique ``key``."""
    return prefix_sum(df, key, F.lit(1), out, inclusive=False, buckets=buckets)


def previous(df: DataFrame, key: str, value: str, out: str, buckets: int | None = None) -> DataFrame:
    """``df`` with ``value`` of the row before in the order of ``key``; null for the first."""
    cut = bucketed(df, key, buckets)
    lasts = cut.groupBy("bucket").agg(F.max_by(value, key).alias("last"))
    edge = lasts.select("bucket", F.lag("last").over(Window.orderBy("bucket")).alias("edge"))
    own = Window.partitionBy("bucket").orderBy(key)
    first = F.row_number().over(own) == 1
    lagged = cut.join(edge, "bucket").withColumn(out, F.when(first, F.col("edge")).otherwise(F.lag(value).over(own)))
    return lagged.drop("bucket", "edge")


def delta(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """What a delta-packed column stores: the difference to the row before, the first as is."""
    return previous(df, key, value, "earlier").withColumn(out, F.col(value) - F.coalesce("earlier", F.lit(0))).drop("earlier")


def not_rising(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose ``value`` isn't above that of the row before."""
    return previous(df, key, value, "earlier").where(F.col("earlier") >= F.col(value))


def is_sorted(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row: whether ``value`` never falls in the order of ``key``."""
    return previous(df, key, value, "earlier").agg((F.count_if(F.col("earlier") > F.col(value)) == 0).alias("is_sorted"))


def expand_runs(df: DataFrame, position: Column, stored: Column, out: str, least: int = 2) -> DataFrame:
    """Shared-file runs: ``position`` repeated ``stored`` + 2 times."""
    return df.withColumn(out, F.explode(F.array_repeat(position, (stored + least).cast("int"))))


def pack_runs(df: DataFrame, value: str, least: int = 2) -> DataFrame:
    """The inverse: how often each value occurs beyond two."""
    return df.groupBy(value).agg((F.count("*") - least).alias("stored"))


def islands(df: DataFrame, group: list[str], offset: str, size: str) -> DataFrame:
    """Chunks of a group merged where one begins at the end of the one before."""
    order = Window.partitionBy(*group).orderBy(offset)
    ends = F.lag(F.col(offset) + F.col(size)).over(order)
    begun = df.withColumn("begins", F.when(ends == F.col(offset), 0).otherwise(1))
    numbered = begun.withColumn("island", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*group, "island").agg(F.min(offset).alias(offset), F.sum(size).alias(size), F.count("*").alias("merged")).drop("island")


def dictionary(df: DataFrame, key: str, value: str) -> DataFrame:
    """(value, pos): distinct values in order of first appearance by ``key``."""
    firsts = df.groupBy(value).agg(F.min(key).alias("first"))
    return positions(firsts, "first", "pos").select(F.col(value).alias("value"), "pos")


def encode(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``df`` with the dictionary position of ``value``."""
    words = dictionary(df, key, value)
    return df.join(words.select(F.col("value").alias(value), F.col("pos").alias(out)), value)


def offsets(df: DataFrame, key: str, text: str) -> DataFrame:
    """Offsets of a string table: where each value begins in the buffer, and the total."""
    placed = prefix_sum(df.select(key, F.octet_length(text).cast("long").alias("bytes")), key, F.col("bytes"), "end")
    begins = positions(placed, key, "pos").select("pos", (F.col("end") - F.col("bytes")).alias("offset"))
    total = placed.agg(F.count("*").alias("pos"), F.coalesce(F.max("end"), F.lit(0)).alias("offset"))
    return begins.unionByName(total)


def renumber(df: DataFrame, rank: Column, key: str, out: str, ranks: int) -> DataFrame:
    """New numbers by (rank, key): a scan over the ranks, then one inside each."""
    ranked = df.withColumn("rank", rank.cast("long"))
    sizes = ranked.groupBy("rank").agg(F.count("*").alias("n"))
    base = sizes.select("rank", F.coalesce(F.sum("n").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("from"))
    cut = bucketed(ranked, key)
    per = cut.groupBy("rank", "bucket").agg(F.count("*").alias("n"))
    inside = per.select(
        "rank", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("skip")
    )
    local = F.row_number().over(Window.partitionBy("rank", "bucket").orderBy(key)) - 1
    joined = cut.join(inside, ["rank", "bucket"]).join(F.broadcast(base) if ranks <= 64 else base, "rank")
    return joined.withColumn(out, (F.col("from") + F.col("skip") + local).cast("long")).drop("rank", "bucket", "from", "skip")


def ranked(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """``df`` with its 0-based position in the order of any columns, however many rows share
    a leading key: rows are ranged over tasks, sorted there, written with their place, and
    each range is moved up by the sizes of those before it."""
    placed = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__place", F.monotonically_increasing_id()), "ranked")
    part, local = F.shiftrightunsigned("__place", 33), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    base = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__from"))
    return placed.withColumns({"__part": part, "__local": local}).join(base, "__part").withColumn(out, F.col("__from") + F.col("__local")).drop("__part", "__local", "__from", "__place")
