"""Chat formatting: logged snapshots collapse to maximal conversations, which are rendered.

A log often holds each state of a growing conversation.  The turns of all conversations are
ranged over tasks by (conv_id, turn), so one endless conversation is dealt to many.  Every
task rolls a hash over its turns; what a conversation has in earlier tasks is composed in
afterwards (the hash is a polynomial, so parts compose).  A conversation whose last hash is
also the hash of another's earlier turn is a prefix of a longer one.  Hashes are counted
before they meet, so popular openings and copies cost one row each, and an anti-join keeps
the maximal conversations, of equal ones that with the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.spread import BROADCAST_BYTES, Spread
from quern.scratch import materialize

_MODULUS = (1 << 127) - 1
_BASE = 0x5DEECE66D5DEECE66D5DEECE66D5DEEF
PART_TURNS = 256


def _hex(value: int) -> str:
    return f"{value:032x}"


def _roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds task, pos (in the task's part of the conversation) and that part's rolling hash."""
    task, last, pos, rolled = TaskContext.get().partitionId(), (), 0, 0
    for batch in batches:
        places, hashes = [], []
        for conv, digest in zip(batch.column("conv_id").to_pylist(), batch.column("digest").to_pylist(), strict=True):
            pos, rolled = (pos + 1, rolled) if last == (conv,) else (0, 0)
            last = (conv,)
            rolled = (rolled * _BASE + int(digest, 16) + 1) % _MODULUS
            places.append(pos)
            hashes.append(_hex(rolled))
        added = [pa.array([task] * len(places), pa.int64()), pa.array(places, pa.int64()), pa.array(hashes, pa.string())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "task", "pos", "rolled"])


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For conversations in several tasks: what each part has before it."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            before, rolled = 0, 0
            for part in sorted(row["parts"], key=lambda p: p["task"]):
                out.append((row["conv_id"], part["task"], before, _hex(rolled)))
                before += part["turns"]
                rolled = (rolled * pow(_BASE, part["turns"], _MODULUS) + int(part["rolled"], 16)) % _MODULUS
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "task", "before", "carried"])


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of whole prefixes from those of parts."""
    for batch in batches:
        hashes = batch.column("rolled").to_pylist()
        for i, (pos, carried) in enumerate(zip(batch.column("pos").to_pylist(), batch.column("carried").to_pylist(), strict=True)):
            if carried is not None:
                hashes[i] = _hex((int(carried, 16) * pow(_BASE, pos + 1, _MODULUS) + int(hashes[i], 16)) % _MODULUS)
        turns = [p + b + 1 for p, b in zip(batch.column("pos").to_pylist(), batch.column("before").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(turns, pa.int64()), pa.array(hashes, pa.string())], ["conv_id", "turns", "hash"])


def render(conversations: DataFrame, part_turns: int = PART_TURNS, heavy_turns: int = 100_000, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Maximal conversations: conv_id, part, n_turns, copies, text.

    ``copies`` counts the conversations equal to this one, itself included.  A conversation
    of more than ``part_turns`` turns comes in parts, whose texts in order are the whole.
    What is found of a conversation meets its turns by broadcast if it is small in all (measured),
    otherwise in a join for which conversations of over ``heavy_turns`` turns are dealt to parts.
    Turns are ordered by turn, then the MD5 of the rendered turn where turns tie; a null turn comes first.  A
    null role is "unknown", a null text empty, a very long one whole; ``<|`` in a text is written ``<\\|``.  Rows
    without a conv_id form one conversation; a repeated row is a repeated turn.  An empty
    table gives an empty result; other columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.concat(F.lit("<|"), role, F.lit("|>\n"), F.replace(text, F.lit("<|"), F.lit("<\\|")), F.lit("<|end|>\n")).alias("segment"),
    ).withColumn("digest", F.md5("segment"))
    ranged = turns.repartitionByRange("conv_id", "turn", "digest").sortWithinPartitions("conv_id", "turn", "digest")
    schema = T.StructType([*turns.schema.fields, T.StructField("task", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("rolled", T.StringType())])
    rolled = materialize(ranged.mapInArrow(_roll, schema).drop("turn", "digest"), "turns")

    parts = rolled.groupBy("conv_id", "task").agg(F.struct("task", (F.max("pos") + 1).alias("turns"), F.max_by("rolled", "pos").alias("rolled")).alias("part"))
    spread = parts.groupBy("conv_id").agg(F.collect_list("part").alias("parts")).where(F.size("parts") > 1)  # a part for each task at most
    carried = materialize(spread.mapInArrow(_carry, "conv_id long, task long, before long, carried string"), "carried").select(
        F.col("conv_id").alias("c"), F.col("task").alias("t"), "before", "carried"
    )
    placed = rolled.join(carried, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("task") == F.col("t")), "left").drop("c", "t").fillna(0, ["before"])

    prefixes = placed.select("conv_id", "pos", "rolled", "before", "carried").mapInArrow(_compose, "conv_id long, turns long, hash string")
    prefixes = materialize(prefixes, "prefixes")
    whole = prefixes.groupBy("conv_id").agg(F.max("turns").alias("n_turns"), F.max_by("hash", "turns").alias("hash"))
    ends = whole.groupBy("hash").agg(F.min("conv_id").alias("conv_id"), F.max("n_turns").alias("n_turns"), F.count("*").alias("copies"))
    ends = materialize(ends, "ends")
    seen = prefixes.groupBy("hash").agg(F.count("*").alias("times"))
    extended = seen.join(ends.select("hash", "copies"), "hash").where("times > copies").select("hash")
    maximal = ends.join(extended, "hash", "left_anti").select(F.col("conv_id").alias("c"), "n_turns", "copies")

    keyed = lambda df, c: df.withColumn("key", F.coalesce(F.col(c).cast("string"), F.lit("")))
    beside = Spread(keyed(whole, "conv_id").select("key", F.col("n_turns").alias("weight")), "key", heavy_turns, broadcast_bytes)
    met = beside.join(keyed(placed, "conv_id"), keyed(maximal, "c").drop("c"), "rolled", F.lit(16))
    kept = met.where("n_turns is not null").select("conv_id", (F.col("before") + F.col("pos")).alias("at"), "segment", "n_turns", "copies")
    return (
        kept.groupBy("conv_id", F.expr(f"at div {part_turns}").alias("part"), "n_turns", "copies")
        .agg(F.array_sort(F.collect_list(F.struct("at", "segment"))).alias("segments"))
        .select("conv_id", "part", "n_turns", "copies", F.array_join(F.transform("segments", lambda s: s["segment"]), "").alias("text"))
    )


def op1_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP1_SQL = f"""
WITH s AS (
  SELECT conv_id, turn,
    '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '<\\|') || '<|end|>' || chr(10) AS segment
  FROM conversations
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, md5(segment)) - 1 AS pos FROM s
), p AS (
  SELECT *, sha256(string_agg(segment, '') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS prefix,
    count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM n
), e AS (
  SELECT prefix, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE pos + 1 = n_turns GROUP BY prefix
), k AS (
  SELECT * FROM e WHERE prefix NOT IN (SELECT prefix FROM p WHERE pos + 1 < n_turns)
)
SELECT conv_id, pos // {PART_TURNS} AS part, n_turns, copies, string_agg(segment, '' ORDER BY pos) AS text
FROM p JOIN k USING (conv_id) GROUP BY ALL
"""
