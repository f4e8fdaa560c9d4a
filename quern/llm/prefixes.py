"""The similar pairs that bands have not joined, found exactly.

Bands pair the texts of a crowded band with one of them, and miss a pair now and then.  Here every
pair of texts of a similarity of ``least`` or more meets that is not in one component yet.

All shingles have one order, frequent ones last.  Two sets of n and m shingles that share the
overlap ``least`` asks for share one among the first n - ceil(least * n) + 1 of each, and the first
one they share has at most so many before it in either that the rest can still make up that overlap.
So each text is posted under those first shingles; a posting all of one component is left, and in the
others the pairs of different components are held against the overlap by sizes, positions and parity
bitmaps: a bit of the bitmap is the parity of the shingles that fall on it, so two bitmaps differ in
no more bits than the sets in shingles.  These drop no similar pair.  What remains is verified.

Which shingles count as frequent is read off a bounded sample of texts.  It decides how many pairs
are looked at, never which are found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shingles import shingles, verified
from quern.llm.spread import BROADCAST_BYTES, lean
from quern.llm.vectext import as_bytes, groups
from quern.scratch import materialize

#: Texts in the sample, and frequent shingles that are read off it at most.
SAMPLE, LISTED = 8000, 400_000
#: Bits of a bitmap, and bitmaps that are made at a time.
BITS, MADE = 1024, 512
#: Members of a posting that are compared with each other in one go; a larger one is compared by
#: pairs of its blocks.
BLOCK = 1024
#: Pairs that are looked at at a time.
LOOKED = 1 << 15

_Batches = Iterator[pa.RecordBatch]


def overlap(least: float, sizes: np.ndarray) -> np.ndarray:
    """Shingles that two sets of together ``sizes`` share if they are similar."""
    return np.ceil(least / (1 + least) * sizes - 1e-6).astype(np.int64)


def _in_groups(batches: _Batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        texts = as_bytes(batch.column("text"))
        for a, b in groups([len(t) for t in texts]):
            yield batch.slice(a, b - a), *shingles(texts[a:b])


def _tokens(batches: _Batches) -> _Batches:
    for _, keys, _counts in _in_groups(batches):
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["token"])


def _posts(least: float, listed: np.ndarray, often: np.ndarray) -> Callable[[_Batches], _Batches]:
    def run(batches: _Batches) -> _Batches:
        for rows, keys, counts in _in_groups(batches):
            of = np.repeat(np.arange(len(counts)), counts)
            if len(listed) and len(keys):
                at = np.minimum(np.searchsorted(listed, keys), len(listed) - 1)
                # Within a text the keys are sorted, and this sort is stable.
                keys = keys[np.lexsort((np.where(listed[at] == keys, often[at], 0), of))]
            place = np.arange(len(keys)) - np.repeat(np.cumsum(counts) - counts, counts)
            first = place <= (counts - np.ceil(least * counts - 1e-6).astype(np.int64))[of]
            whose = pa.array(of[first])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[first].view(np.int64)), rows.column("node").take(whose), rows.column("root").take(whose), pa.array(counts[of[first]] << 32 | place[first])],
                ["token", "node", "root", "sized"],
            )

    return run


def _bitmaps(batches: _Batches) -> _Batches:
    for rows, keys, counts in _in_groups(batches):
        ends = np.cumsum(counts)
        bit = (keys >> np.uint64(20)).astype(np.int64) % BITS
        for a in range(0, len(counts), MADE):
            some = counts[a : a + MADE]
            at = np.repeat(np.arange(len(some)), some) * BITS + bit[ends[a] - counts[a] : ends[a + len(some) - 1]]
            odd = np.bincount(at, minlength=len(some) * BITS).reshape(-1, BITS) & 1
            packed = np.packbits(odd.astype(bool), axis=1)
            yield pa.RecordBatch.from_arrays([rows.column("node").slice(a, len(some)), pa.array([p.tobytes() for p in packed], pa.binary())], ["node", "bits"])


def _meeting(least: float, left: dict[str, np.ndarray], right: dict[str, np.ndarray], same: bool) -> Iterator[np.ndarray]:
    """Pairs of members of two blocks of a posting that may be similar."""
    size, place = right["sized"] >> 32, right["sized"] & 0xFFFFFFFF
    step = max(1, LOOKED // len(size))
    for a in range(0, len(left["node"]), step):
        n, i = left["sized"][a : a + step, None] >> 32, left["sized"][a : a + step, None] & 0xFFFFFFFF
        need = overlap(least, n + size)
        may = (left["root"][a : a + step, None] != right["root"]) & (np.minimum(n - i, size - place) >= need)
        if same:
            may &= np.arange(a, a + len(n))[:, None] < np.arange(len(size))
        x, y = np.nonzero(may)
        differ = np.bitwise_count(left["bits"][a + x] ^ right["bits"][y]).sum(axis=1, dtype=np.int64)
        kept = (n[:, 0][x] + size[y] - differ) >= 2 * need[x, y]
        p, q = left["node"][a + x[kept]], right["node"][y[kept]]
        yield np.stack([np.minimum(p, q), np.maximum(p, q)])


_KEY, _MEMBER = ("token", "low", "high"), ("part", "node", "root", "sized")


def _pairs(least: float) -> Callable[[_Batches], _Batches]:
    """Rows come sorted by token, low and high; only the last group is carried on."""

    def pairs(rows: dict[str, np.ndarray], ends: list[int]) -> _Batches:
        found = []
        for a, b in zip([0, *ends], ends, strict=False):
            group = {k: rows[k][a:b] for k in ("part", "node", "root", "sized", "bits")}
            low, high = rows["low"][a], rows["high"][a]
            left, right = ({k: v[group["part"] == part] for k, v in group.items()} for part in (low, high))
            if len(left["node"]) and len(right["node"]):
                found += _meeting(least, left, right, low == high)
        if found:
            a, b = np.concatenate(found, axis=1)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.empty(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["a", "b"])

    def run(batches: _Batches) -> _Batches:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in _KEY + _MEMBER}
            rows["bits"] = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)
            if held:
                rows = {k: np.concatenate((held[k], rows[k])) for k in rows}
            new = np.any([rows[k][1:] != rows[k][:-1] for k in _KEY], axis=0)
            ends = (np.flatnonzero(new) + 1).tolist()
            yield from pairs(rows, ends)
            held = {k: v[ends[-1] if ends else 0 :] for k, v in rows.items()}
        if held:
            yield from pairs(held, [len(held["node"])])

    return run


def frequent(rows: DataFrame, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are in two or more of a sample of ``rows`` (node, text), and in how many."""
    some = rows.where(F.pmod(F.xxhash64("node"), F.lit(max(1, count // SAMPLE))) == 0).select("text")
    met = some.mapInArrow(_tokens, "token long").groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    table = met.orderBy(F.desc("n"), "token").limit(LISTED).toArrow()
    listed, often = table.column("token").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(listed)
    return listed[order], often[order]


def candidates(known: DataFrame, texts: DataFrame, least: float, block: int = BLOCK, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Pairs (a, b), a < b, of nodes of different roots; each similar one is among them."""
    rows = texts.join(lean(known, 16, broadcast_bytes), "node").select("node", "root", "text")
    posts = rows.mapInArrow(_posts(least, *frequent(rows, known.count())), "token long, node long, root long, sized long")
    by = Window.partitionBy("token")
    counted = posts.select("*", F.min("root").over(by).alias("from"), F.max("root").over(by).alias("to"), F.count("*").over(by).alias("weight"))
    contested = materialize(counted.where(F.col("from") < F.col("to")).drop("from", "to"), "contested")
    there = materialize(contested.select("node").distinct(), "there")
    bitmaps = texts.join(lean(there, 16, broadcast_bytes), "node", "left_semi").select("node", "text").mapInArrow(_bitmaps, "node long, bits binary")
    blocks = F.ceil(F.col("weight") / F.lit(block)).cast("int")
    dealt = contested.withColumn("blocks", blocks).withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    beside = dealt.withColumn("other", other).select(
        "token", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "root", "sized"
    )
    met = beside.join(materialize(bitmaps, "bitmaps"), "node").select(*_KEY, *_MEMBER, "bits")
    return materialize(met.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(_pairs(least), "a long, b long").distinct(), "left")


def links(known: DataFrame, texts: DataFrame, least: float, part: int = 100_000, block: int = BLOCK, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Links (a, b) between all roots of ``known`` (node, root) that have nodes whose ``texts``
    (node, text) have a Jaccard similarity of their five-word shingles of ``least`` or more."""
    found = verified(candidates(known, texts, least, block, broadcast_bytes), texts, least, part, broadcast_bytes)
    side = lambda c: known.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    return found.join(side("a"), "a").join(side("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()
