"""Benchmark decontamination: rare pairs of words as seeds, then Smith-Waterman alignment.

Every pair of near words of the whole corpus is looked up among the seeds of the test items.
Where as many different seeds of one item meet in a stretch of a document as any alignment of
the wanted score must have, the item's words are aligned with that stretch, so copies with
words changed, added or left out are scored too, and none that scores enough is passed over.

The test set is the stated query set: it is read in blocks of at most ``block_bytes`` of text.
One block at a time is on the driver and broadcast (so bounded by that parameter), and compared
with all documents; between blocks, documents and hits are written.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.alignment import smith_waterman
from quern.llm.vectext import Words, as_bytes, groups
from quern.scratch import materialize

N = 3
LEAST_SCORE = 0.5
BLOCK_BYTES = 32 << 20
#: ASCII letters and digits and all of UTF-8 beyond ASCII stay; the rest parts words.
_PARTS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_FILTER_BITS = 22
_ODD = np.uint64(11400714785074694791)


def fold(text: bytes) -> bytes:
    """Lower case, with words parted by white space alone."""
    lower = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    return lower.translate(_PARTS)


class Hit(NamedTuple):
    text: int
    item: int
    score: float
    start: int
    end: int


class Seeds:
    """The seeds of one block of test items: pairs of words, next to each other or with one between.

    An alignment of ``m`` of an item's ``n`` words that scores ``least`` has at most
    2 (m - least n) words changed, added or left out.  Between two matched words in a row lie
    two of these at most m - least n times, so ``least n - 1`` of its m - 1 steps have one or
    none: both words of a seed, in the text and in the item.  An item needs as many seeds with
    different first words.  Of half of them it is spared if they are common among the items:
    each first word that is not held lowers the need by one.
    """

    def __init__(self, items: list[tuple[int | None, bytes]], n: int = N, least: float = LEAST_SCORE, rare: float = 0.05):
        by_text: dict[bytes, list[int | None]] = {}
        for item_id, text in items:
            by_text.setdefault(b" ".join(fold(text).split()), []).append(item_id)
        texts = [t for t in by_text if t.count(b" ") + 1 >= n]
        self.least, self.ids = least, [by_text[t] for t in texts]
        words = Words(texts)
        hashes = words.hashes()
        self.words = [hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        self.need = np.maximum(np.ceil(least * words.count - 1e-9).astype(np.int64) - 1, 1)
        keys, at = _pairs(hashes, words.of)
        _, same, counts = np.unique(keys, return_inverse=True, return_counts=True)
        spread = np.zeros(len(hashes), np.int64)
        np.maximum.at(spread, at, counts[same])
        order = np.lexsort((-spread, words.of))
        rank = np.arange(len(order)) - words.first[words.of[order]]  # the commonest first
        left_out = np.zeros(len(hashes), bool)
        left_out[order] = (rank < self.need[words.of[order]] // 2) & (spread[order] > max(1, rare * len(texts)))
        self.need -= np.bincount(words.of[left_out], minlength=len(texts))
        keys, at = keys[~left_out[at]], at[~left_out[at]]
        order = np.argsort(keys, kind="stable")
        self.keys, self.item = keys[order], words.of[at][order]
        self.place = (at - words.first[words.of[at]])[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.keys >> np.uint64(64 - _FILTER_BITS)] = True

    def find(self, texts: list[bytes], least: float) -> list[Hit]:
        """The best alignment of each item in each text that scores ``least`` or more."""
        if least < self.least:
            raise ValueError(f"the seeds are those of scores from {self.least}")
        found: list[Hit] = []
        for a, b in groups([len(t) for t in texts]):
            found += [h._replace(text=h.text + a) for h in self._find(texts[a:b], least)]
        return found

    def _find(self, texts: list[bytes], least: float) -> list[Hit]:
        words = Words([fold(t) for t in texts])
        hashes = words.hashes()
        keys, at = _pairs(hashes, words.of, self.filter)
        low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
        count = high - low
        seed = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(at, count)
        if not len(at):
            return []
        text, item, place = words.of[at], self.item[seed], self.place[seed]
        pair = text * np.int64(len(self.ids)) + item
        order = np.lexsort((place, pair))
        pair, at, place = pair[order], at[order], place[order]
        fresh = np.concatenate(([True], (pair[1:] != pair[:-1]) | (place[1:] != place[:-1])))
        starts, ends = _runs(pair)
        keep = np.add.reduceat(fresh, starts, dtype=np.int64) >= self.need[item[order][starts]]
        keep = np.repeat(keep, ends - starts)
        if not keep.any():
            return []
        pair, at, place = pair[keep], at[keep], place[keep]
        order = np.lexsort((at - place, pair))
        pair, begins, place = pair[order], (at - place)[order], place[order]
        found = []
        for lo, hi in zip(*_runs(pair), strict=True):
            text_no, item_no = divmod(int(pair[lo]), len(self.ids))
            first, last = int(words.first[text_no]), int(words.first[text_no + 1])
            best = self._align(item_no, begins[lo:hi], place[lo:hi], hashes, first, last)
            if best is not None and best[0] >= least:
                found.append(Hit(text_no, item_no, *best))
        return found

    def _align(self, item_no: int, begins: np.ndarray, place: np.ndarray, hashes: np.ndarray, first: int, last: int) -> tuple | None:
        """Align with each stretch in which enough seeds lie on near diagonals."""
        item = self.words[item_no]
        slack = int(2 * len(item) * (1 - self.least)) + 1  # words that can be put in or left out
        edges = np.flatnonzero(np.diff(begins) > slack) + 1
        best = None
        for lo, hi in zip(np.concatenate(([0], edges)), np.concatenate((edges, [len(begins)])), strict=True):
            if len(np.unique(place[lo:hi])) < self.need[item_no]:
                continue
            a, b = max(first, int(begins[lo]) - slack), min(last, int(begins[hi - 1]) + len(item) + slack)
            got = smith_waterman(item, hashes[a:b])
            if best is None or got.score > best[0]:
                best = (got.score, a + got.start - first, a + got.end - first)
        return best


def _pairs(hashes: np.ndarray, of: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pairs of words of one text, one or two places apart, and the first's place;
    if ``known``, a filter, is given, only of those that pass it."""
    found = []
    for apart in (1, 2):
        total = max(0, len(hashes) - apart)
        key = hashes[:total] * _ODD
        key ^= key >> np.uint64(29)
        key += hashes[apart : apart + total]
        key *= _ODD
        key ^= key >> np.uint64(29)
        at = np.arange(total) if known is None else np.flatnonzero(known[key >> np.uint64(64 - _FILTER_BITS)])
        at = at[of[at] == of[at + apart]]
        found.append((key[at], at))
    return np.concatenate([k for k, _ in found]), np.concatenate([a for _, a in found])


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1
    return np.concatenate(([0], edges)), np.concatenate((edges, [len(sorted_keys)]))


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[bool, list[tuple[int | None, bytes]]]]:
    """Whether it is the last, and the items, of as many blocks as keep each within
    ``block_bytes`` (or at one item)."""
    sized = benchmark.select("item_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    total = sized.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 0
    count = -(-2 * total // block_bytes) if total > block_bytes else 1
    for k in range(count):
        rows = sized if count == 1 else sized.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(count)) == k)
        yield k == count - 1, [(r["item_id"], bytes(r["text"])) for r in rows.collect()]


_HITS = T.ArrayType(
    T.StructType(
        [T.StructField("item_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
    )
)


def with_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "hits", least: float = LEAST_SCORE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with an array of (item_id, score, start, end): the test items that the text
    holds, with the best alignment's score and place in words.

    Items of fewer than three words are not sought.  Equal items are all named; of alignments of
    one score the first counts.  Null and empty texts hold nothing; a very long text is searched
    whole.  Each row stands for itself: repeated rows and null ids stay.  Without items, or
    documents, there are no hits; other columns pass through.
    """
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
    docs = docs.drop(out)  # one of that name is replaced
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(out, _HITS)])
    for last, items in _blocks(benchmark.select(F.col("item_id").cast("long"), "text"), block_bytes):
        block = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], block: Broadcast = block) -> Iterator[pa.RecordBatch]:
            seeds = Seeds(block.value, least=least)
            for batch in batches:
                texts = as_bytes(batch.column(text))
                found = batch.column(out).to_pylist() if out in batch.schema.names else [[] for _ in texts]
                for h in seeds.find(texts, least):
                    found[h.text] += [{"item_id": i, "score": h.score, "start": h.start, "end": h.end} for i in seeds.ids[h.item]]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(found, kind)], [*names, out])

        docs = docs.mapInArrow(run, schema)
        if not last:
            docs = materialize(docs, "hits")
            block.unpersist()
    return docs


def op6_seed_and_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hits = with_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.select("doc_id", F.explode("hits").alias("h")).select(
        "doc_id", "h.item_id", F.round("h.score", 6).alias("score"), F.col("h.start").alias("start_word"), F.col("h.end").alias("end_word")
    )
