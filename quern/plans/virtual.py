"""A virtual image over the documents table: / , /lang, /lang/source, /lang/source/id.txt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import scans

FILES_FROM = 1_000_000_000


def entries(docs: DataFrame, content: bool = False) -> DataFrame:
    """Entries as the builder takes them; a parent's seq is below its children's."""
    zero = F.lit(0).cast("long")
    none = lambda kind: F.lit(None).cast(kind)
    langs = scans.ranked(docs.select("lang").distinct(), ["lang"], "rank").select("lang", (F.col("rank") + 1).alias("lang_seq"))
    sources = scans.ranked(docs.select("lang", "source").distinct(), ["lang", "source"], "rank").select("lang", "source", (F.col("rank") + 1_000_000).alias("source_seq"))
    root = docs.sparkSession.range(1).select(zero.alias("seq"), none("long").alias("parent_seq"), F.lit("").alias("name"), F.lit("dir").alias("kind"))
    level1 = langs.select(F.col("lang_seq").alias("seq"), zero.alias("parent_seq"), F.col("lang").alias("name"), F.lit("dir").alias("kind"))
    level2 = sources.join(langs, "lang").select(F.col("source_seq").alias("seq"), F.col("lang_seq").alias("parent_seq"), F.col("source").alias("name"), F.lit("dir").alias("kind"))
    files = docs.join(sources, ["lang", "source"]).select(
        (F.col("doc_id") + FILES_FROM).alias("seq"),
        F.col("source_seq").alias("parent_seq"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"),
        F.lit("file").alias("kind"),
        (F.col("text").cast("binary") if content else none("binary")).alias("content"),
    )
    nodes = root.unionByName(level1).unionByName(level2).withColumn("content", none("binary")).unionByName(files)
    return nodes.select(
        "seq", "parent_seq", "name", "kind",
        none("long").alias("link_to"),
        F.when(F.col("kind") == "dir", 0o755).otherwise(0o644).cast("long").alias("mode"),
        (F.col("seq") % 7).alias("uid"), (F.col("seq") % 3).alias("gid"),
        (F.col("seq") % 1000 * 60).alias("mtime"), (F.col("seq") % 1000 * 60 + 1).alias("atime"), (F.col("seq") % 1000 * 60 + 2).alias("ctime"),
        none("string").alias("target"), none("decimal(20,0)").alias("device_id"), "content",
    )


def chunks(docs: DataFrame, block_size: int) -> DataFrame:
    """Chunks of the files (seq, idx, section_idx, offset, size), laid end to end by doc_id."""
    from quern.operators.chunks import block_slices

    sized = docs.select("doc_id", F.octet_length("text").alias("n"))
    return block_slices(sized, "doc_id", "n", block_size).select((F.col("doc_id") + FILES_FROM).alias("seq"), F.col("block").alias("idx"), F.col("block").alias("section_idx"), "offset", "size")
