"""Packing of tokenised documents into sequences by Karmarkar-Karp multiway differencing.

Each task tokenises its own documents and packs them at once, so nothing is shuffled and
nothing grows with the corpus.  A document's full runs of ``capacity`` tokens are sequences
of their own.  What is left of each document is a piece, and pieces come in batches of about
``windows`` sequences' worth of tokens.  Differencing merges partial partitions of opposing
imbalance until it has dealt a batch, pieces whole, into near-equal windows.  Their number
begins as the least that holds the batch and rises while a window exceeds its capacity, as far
as ``padding`` allows.  (With about three pieces to a window, raising it until all fit would
leave 5 percent of padding.)  A window that exceeds it even then gives the end of its last
piece to windows with room: only these pieces are cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.differencing import partition
from quern.llm.tokens import added_tokens, shared_encoder
from quern.llm.vectext import as_bytes

CAPACITY = 2048
END_ID = 1
#: Share of a batch's tokens that may be left empty to keep pieces whole, and windows a batch.
PADDING, WINDOWS = 0.005, 256
_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())]
)


def level(windows: list[list[list[int]]], capacity: int) -> list[list[list[int]]]:
    """Windows of pieces [piece, from, to] with none above ``capacity``: what exceeds it is
    cut off the end of a window and given to those with room."""
    loads = [sum(b - a for _, a, b in w) for w in windows]
    cut = []
    for i, w in enumerate(windows):
        while loads[i] > capacity:
            piece, a, b = w.pop()
            n = min(b - a, loads[i] - capacity)
            if n < b - a:
                w.append([piece, a, b - n])
            cut.append([piece, b - n, b])
            loads[i] -= n
    for i in sorted(range(len(windows)), key=loads.__getitem__):
        while cut and loads[i] < capacity:
            piece, a, b = cut.pop()
            n = min(b - a, capacity - loads[i])
            windows[i].append([piece, a, a + n])
            loads[i] += n
            if n < b - a:
                cut.append([piece, a + n, b])
    return windows


def deal(sizes: np.ndarray, capacity: int, padding: float = PADDING) -> list[list[list[int]]]:
    """Near-equal windows of pieces [item, from, to]: as few as hold all items, then more while
    one exceeds ``capacity`` and no more than the share ``padding`` of all is left empty."""
    total = int(sizes.sum())
    count = max(1, -(-total // capacity))
    most = max(count, int(total / (1 - padding) // capacity))
    while True:
        sets = partition(sizes, count)
        if count == most or all(sizes[s].sum() <= capacity for s in sets):
            return level([[[i, 0, int(sizes[i])] for i in s] for s in sets], capacity)
        count += 1


class Packer:
    """Packs one task's documents; ``put`` and ``finish`` give rows of the output table."""

    def __init__(self, first_sequence: int, capacity: int, windows: int, padding: float = PADDING):
        self.capacity, self.batch, self.padding = capacity, capacity * windows, padding
        self.sequence = first_sequence
        self.waiting: list[tuple] = []  # (doc_id, start, doc_tokens, ids)
        self.held = 0
        self.rows: list[tuple] = []

    def put(self, doc_id: int | None, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= self.capacity:
            self._row(doc_id, at, total, ids[4 * at : 4 * (at + self.capacity)], 0)
            self.sequence += 1
            at += self.capacity
        if at < total:
            if self.held + total - at > self.batch:
                self.flush()
            self.waiting.append((doc_id, at, total, ids[4 * at :]))
            self.held += total - at

    def _row(self, doc_id: int | None, start: int, total: int, ids: bytes, offset: int) -> None:
        self.rows.append((doc_id, start, len(ids) // 4, total, self.sequence, offset, ids))

    def flush(self) -> None:
        if not self.waiting:
            return
        sizes = np.array([len(p[3]) // 4 for p in self.waiting], np.int64)
        for window in deal(sizes, self.capacity, self.padding):
            offset = 0
            for item, a, b in window:
                doc_id, start, total, ids = self.waiting[item]
                self._row(doc_id, start + a, total, ids[4 * a : 4 * b], offset)
                offset += b - a
            self.sequence += bool(window)
        self.waiting, self.held = [], 0

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(_ARROW)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def pack(
    docs: DataFrame,
    ranks: str,
    pattern: str = public_tokenizers.PATTERN,
    text: str = "text",
    doc_id: str = "doc_id",
    capacity: int = CAPACITY,
    windows: int = WINDOWS,
    padding: float = PADDING,
    end_id: int = END_ID,
    added: tuple[tuple[str, int], ...] = (),
) -> DataFrame:
    """Pieces of the packed documents: doc_id, start, length, doc_tokens, sequence_id, offset
    and ids (little-endian unsigned 32-bit).

    ``ranks``, ``pattern`` and ``added`` tokens are the vocabulary.  Every row of ``docs`` is a
    document of its own: repeated rows, and rows with a null or repeated doc_id, are packed
    separately.  A null or empty text is the single id ``end_id``.  A very long text is encoded
    whole and cut into full sequences as it comes; ties between equal sizes go to the earlier
    row.  Each id lies in exactly one piece.  Sequence ids are unique, not consecutive (the
    task's number is in the high bits); offsets in a sequence leave no gap.  Beside ``padding``
    of it, a batch leaves less than one sequence empty.  An empty table gives an empty result;
    other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = shared_encoder(ranks, pattern, added), np.array([end_id], "<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId() << 33, capacity, windows, padding)
        waiting = 0
        for batch in batches:
            for key, content in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                ids = encoder.encode(content) + end
                packer.put(key, ids)
                waiting += len(ids)
                if waiting > 4 << 20:
                    yield packer.take()
                    waiting = 0
        packer.flush()
        yield packer.take()

    return rows.mapInArrow(run, _SCHEMA)


def op3_karmarkar_karp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed(docs)


def packed(docs: DataFrame) -> DataFrame:
    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), added=added_tokens(public_tokenizers.path("byte_bpe_50k.json")))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
