"""Pairs of texts by the similarity of their sets of five-word shingles.

A SimHash of 64 bits cannot tell a similarity of 0.8: such fingerprints differ in 2 to 11 bits
and more, and the fewer positional bytes two of them must share, the longer the postings.  So
texts meet here by bands of minima of hashes of their shingles, and every pair that meets is
verified on the whole sets.

Every text has two families of bands.  A band that few texts share gives all its pairs.  In one
that many share each is paired with one of them, another in every band, so a group of n near copies
gives some n pairs a band, never n squared; texts that are only alike in a passage meet in crowded
bands of the wide family, but in the narrow one only with what is really like them.  This joins most
of what is similar; ``prefixes`` finds every similar pair that it leaves in different components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.spread import BROADCAST_BYTES, Spread, lean
from quern.llm.vectext import Rolling, Words, as_bytes, groups
from quern.scratch import materialize

WORDS = 5
#: Minima of a text, and bands of each family with the minima a band is made of.  Of pairs of
#: similarity 0.8 one in 14,000 shares no wide band, and one in 80 no narrow one.
MINIMA, WIDE, NARROW = 120, (24, 5), (24, 8)
#: The last is a key of the whole set, so only texts of equal sets have all bands in common.
BANDS = WIDE[0] + NARROW[0] + 1
#: Texts from which a band is crowded.
CROWDED = 16
_RNG = np.random.default_rng(5)
_FACTORS = _RNG.integers(0, 1 << 63, MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _RNG.integers(0, 1 << 63, MINIMA, np.uint64)
#: The minima of each band: the wide ones one after another, the narrow ones drawn anew.
_MADE_OF = [*np.arange(MINIMA).reshape(WIDE), *(_RNG.choice(MINIMA, NARROW[1], replace=False) for _ in range(NARROW[0]))]
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts, one text after another, and how many each has.

    A-Z count as a-z.  A text of fewer than five words is one shingle, one without words none.
    """
    words = Words([t.lower() for t in texts])
    rolling = Rolling(words.hashes())
    parts, of = [], []
    whole = np.flatnonzero(words.count >= WORDS)
    if len(whole):
        at = np.arange(max(0, len(words.start) - WORDS + 1))
        at = at[words.of[at] == words.of[at + WORDS - 1]]
        parts.append(rolling.keys(WORDS, at))
        of.append(words.of[at])
    for n in range(1, WORDS):
        short = np.flatnonzero(words.count == n)
        if len(short):
            parts.append(rolling.keys(n, words.first[short]) * np.uint64(2 * n + 1))
            of.append(short)
    if not parts:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    keys, of = np.concatenate(parts), np.concatenate(of)
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])))
    return keys[new], np.bincount(of[new], minlength=len(texts))


def bands(texts: list[bytes]) -> np.ndarray:
    """[text, band]: keys of each text's bands; 0 for texts without words."""
    out = np.zeros((len(texts), BANDS), np.int64)
    for a, b in groups([len(t) for t in texts]):
        keys, counts = shingles(texts[a:b])
        some = np.flatnonzero(counts)
        if not len(some):
            continue
        starts = (np.cumsum(counts) - counts)[some]
        minima = np.empty((MINIMA, len(some)), np.uint64)
        for row, factor, mask in zip(minima, _FACTORS, _MASKS, strict=True):
            mixed = (keys ^ mask) * factor
            np.minimum.reduceat(mixed ^ (mixed >> np.uint64(32)), starts, out=row)
        for band, made_of in enumerate(_MADE_OF):
            key = np.full(len(some), band + 1, np.uint64) * _MIX
            for least in minima[made_of]:
                key = (key ^ least) * _MIX
                key ^= key >> np.uint64(29)
            out[a + some, band] = key.view(np.int64)
        mixed = keys * _FACTORS[0]
        out[a + some, -1] = (np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), starts) * _MIX).view(np.int64)
    return out


def as_lists(keys: np.ndarray) -> pa.Array:
    """A row of band keys for each text, as a column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))


def _all_pairs(posted: DataFrame) -> DataFrame:
    """All pairs within each posting of (key, node); postings are small."""
    met = posted.groupBy("key").agg(F.collect_list("node").alias("nodes"))
    pairs = F.flatten(F.transform("nodes", lambda a: F.transform(F.filter("nodes", lambda b: a < b), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return met.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def candidates(nodes: DataFrame, part: int = 100_000, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Pairs (a, b), a < b, of ``nodes`` (node, bands) that may be similar."""
    keyed = nodes.select("node", F.xxhash64("bands").alias("sign"), F.explode("bands").alias("key")).where("key <> 0")
    counts = materialize(keyed.groupBy("key").agg(F.count("*").alias("weight")).where("weight > 1"), "bands")
    beside = Spread(counts, "key", part, broadcast_bytes)
    posted = materialize(beside.join(keyed, counts, "node", F.lit(8)).where("weight is not null"), "posted")
    pairs = _all_pairs(posted.where(F.col("weight") <= CROWDED))

    large = posted.where(F.col("weight") > CROWDED)
    # Chosen by the texts alone, so that the numbers of the nodes do not matter.
    hubs = materialize(large.groupBy("key").agg(F.min_by("node", F.struct(F.xxhash64("sign", "key"), F.col("node"))).alias("hub")), "hubs")
    star = beside.join(large.select("key", "node"), hubs, "node", F.lit(8)).where("hub <> node")
    return materialize(pairs.unionByName(star.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))).distinct(), "pairs")


def _sets(texts: DataFrame) -> DataFrame:
    """(node, words): sorted 32-bit hashes of the distinct shingles of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ids = as_bytes(batch.column(1)), batch.column(0)
            for a, b in groups([len(t) for t in data]):
                keys, counts = shingles(data[a:b])
                ends = np.cumsum(counts)
                low = (keys >> np.uint64(32)).astype(np.uint32)
                found = [np.sort(low[e - n : e]).tobytes() for e, n in zip(ends, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(found, pa.binary())], ["node", "words"])

    return texts.select("node", "text").mapInArrow(run, "node long, words binary")


def _similar(least: float) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(as_bytes(batch.column(2)), as_bytes(batch.column(3)), strict=True):
                n, m = len(x) // 4, len(y) // 4
                if min(n, m) < least * max(n, m):
                    keep.append(False)
                    continue
                both = np.sort(np.concatenate((np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32))), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(shared >= least * (n + m - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return run


def similar(nodes: DataFrame, texts: DataFrame, least: float, part: int = 100_000, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Links (a, b), a < b, between ``nodes`` (node, bands) that meet in bands and whose ``texts``
    (node, text) have a Jaccard similarity of their five-word shingles of ``least`` or more."""
    return verified(candidates(nodes, part, broadcast_bytes), texts, least, part, broadcast_bytes)


def verified(pairs: DataFrame, texts: DataFrame, least: float, part: int = 100_000, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts are similar."""
    wanted = materialize(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "wanted")
    sets = materialize(_sets(texts.join(lean(wanted, 16, broadcast_bytes), "node", "left_semi")), "sets")
    # A text may stand in pairs with very many others, but only as node.
    size = F.octet_length("words")
    leaning = _leaning(pairs)
    beside = Spread(leaning.groupBy("node").agg(F.count("*").alias("weight")), "node", part, broadcast_bytes)
    first = beside.join(leaning, sets, "other", size).withColumnRenamed("words", "first")
    both = first.join(sets.select(F.col("node").alias("other"), F.col("words").alias("second")), "other")
    return both.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), "first", "second").mapInArrow(_similar(least), "a long, b long")


def _leaning(pairs: DataFrame) -> DataFrame:
    """``pairs`` as (node, other), node the one of the two that is in more pairs."""
    ends = pairs.select(F.col("a").alias("n")).unionByName(pairs.select(F.col("b").alias("n")))
    often = materialize(ends.groupBy("n").agg(F.count("*").alias("times")).where("times > 1000"), "often")
    side = lambda c: often.select(F.col("n").alias(c), F.col("times").alias(f"times_{c}"))
    known: DataFrame = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    more: Column = F.coalesce("times_b", F.lit(0)) > F.coalesce("times_a", F.lit(0))
    return known.select(F.when(more, F.col("b")).otherwise(F.col("a")).alias("node"), F.when(more, F.col("a")).otherwise(F.col("b")).alias("other"))
