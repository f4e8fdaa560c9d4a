"""File contents as chunks of blocks: slicing, deduplication, coalescing and reassembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.columns import explode_range
from quern.operators.scans import prefix_sum


def block_slices(files: DataFrame, key: str, size: str, block_size: int) -> DataFrame:
    """(key, block, offset, size): files laid end to end in the order of ``key`` and cut where
    a block is full.  An empty file has no slice; the last block may be shorter."""
    laid = prefix_sum(files.select(key, F.col(size).cast("long").alias("bytes")), key, F.col("bytes"), "stop").withColumn("start", F.col("stop") - F.col("bytes"))
    block = lambda c: F.expr(f"cast({c} div {block_size} as long)")
    cut = explode_range(laid.where("bytes > 0"), block("start"), block("(stop - 1)") + 1, "block")
    begin = F.greatest(F.col("start"), F.col("block") * block_size)
    end = F.least(F.col("stop"), (F.col("block") + 1) * block_size)
    return cut.select(key, "block", (begin - F.col("block") * block_size).alias("offset"), (end - begin).alias("size"))


def fixed_pieces(files: DataFrame, key: str, content: str, length: int) -> DataFrame:
    """(key, idx, piece): a content cut into pieces of ``length`` characters (or bytes)."""
    count = F.ceil(F.length(content) / length).cast("long")
    return explode_range(files, F.lit(0).cast("long"), count, "idx").select(key, "idx", F.substring(F.col(content), F.col("idx") * length + 1, F.lit(length)).alias("piece"))


def reassemble(pieces: DataFrame, key: str) -> DataFrame:
    """(key, content): the pieces of each file joined in order; bounded by the file's size."""
    parts = F.array_sort(F.collect_list(F.struct("idx", F.col("piece").cast("string").alias("piece"))))
    joined = pieces.groupBy(key).agg(parts.alias("parts"))
    return joined.select(key, F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("content"))


def first_seen(chunks: DataFrame, digest: str, order: list[str]) -> DataFrame:
    """``chunks`` with ``is_first``: whether no equal chunk comes earlier.

    Digests are counted before they meet the chunks, so a popular chunk is not gathered.
    """
    firsts = chunks.groupBy(digest).agg(F.min(F.struct(*order)).alias("first"))
    return chunks.join(firsts, digest).withColumn("is_first", F.col("first") == F.struct(*order)).drop("first")


def saved(chunks: DataFrame, size: Column) -> Column:
    return F.coalesce(F.sum(F.when(~F.col("is_first"), size)), F.lit(0))


def file_sizes(files: DataFrame, chunks: DataFrame, key: str, size: str) -> DataFrame:
    """(key, size, n_chunks): a file without chunks has size 0."""
    sums = chunks.groupBy(key).agg(F.sum(size).alias("size"), F.count("*").alias("n_chunks"))
    return files.select(key).join(sums, key, "left").fillna(0, ["size", "n_chunks"])


def remaining(chunks: DataFrame, key: str, position: Column) -> DataFrame:
    """(key, remaining): bytes after ``position`` of a file whose chunks have start and size."""
    left = F.greatest(F.lit(0), F.col("start") + F.col("size") - F.greatest(F.col("start"), position))
    return chunks.groupBy(key).agg(F.sum(left).cast("long").alias("remaining"))


def locality(files: DataFrame, section: str, key: str) -> DataFrame:
    """Files ranged and sorted by the first section they read, so each section is read in one
    go."""
    return files.repartitionByRange(section, key).sortWithinPartitions(section, key)
