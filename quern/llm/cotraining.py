"""Quality scores by co-training a text-content and a page-metadata classifier.

Both views' features of every document are written once.  Each view is fitted to a sample of
labelled rows; then, for a few rounds, each scores all documents and gives the other, of either
class, the ones it ranks surest above what the class's share alone would say.  A pseudo-label
weighs as much as its score exceeds that share, and a view keeps what it was given if rows
held out say that it is no worse for it.  Views are calibrated on scores of rows
that they were not fitted to, and in the end every document gets the posterior of the two as independent evidence.

Bounds: at most ``max_labelled`` labelled rows (those of least hash) and, for each round and
view, ``grow`` pseudo-labels of each class reach the driver; everything else covers all rows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.logistic import Model, fit, logit, platt, sigmoid
from quern.llm.vectext import IS_LEAD, Words, as_bytes, groups
from quern.scratch import materialize

MAX_LABELLED, GROW, ROUNDS = 8000, 200, 3
#: Labelled rows of a class from which a single quarter is held out.
FEW = 50
#: Columns of the metadata view.
META = ("source", "lang", "n_chars")
_WORD_BINS, _VALUE_BINS = 256, 64
_PART = re.compile(r"[A-Za-z]+|\d+|[^\W\d_]+")
#: Byte classes whose share of a text is a feature.
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!?", b".,;:", b"\n", b"\"'()[]{}", b"@_/\\~^=+-"]
_CLASS_OF = np.zeros((256, len(_CLASSES)), bool)
for _j, _c in enumerate(_CLASSES):
    _CLASS_OF[list(_c), _j] = True
TEXT_SIZE = _WORD_BINS + len(_CLASSES) + 6


def text_features(texts: list[bytes]) -> np.ndarray:
    """Hashed words, shares of byte classes, and shapes of words and lines, as float16."""
    out = np.zeros((len(texts), TEXT_SIZE), np.float16)
    for a, b in groups([len(t) for t in texts]):
        words = Words(texts[a:b])
        n, rows = np.maximum(words.count, 1), b - a
        hashes = words.hashes()
        bins = np.bincount(words.of * _WORD_BINS + (hashes & np.uint64(_WORD_BINS - 1)).astype(np.int64), minlength=rows * _WORD_BINS)
        part = out[a:b]
        part[:, :_WORD_BINS] = np.sqrt(bins.reshape(rows, -1) / n[:, None])
        size = np.maximum([len(t) for t in texts[a:b]], 1)
        of_byte = np.repeat(np.arange(rows), np.diff(words.text_start))[: len(words.buf)]
        seen = np.bincount(of_byte * 256 + words.buf, minlength=rows * 256).reshape(rows, 256)
        part[:, _WORD_BINS : _WORD_BINS + len(_CLASSES)] = (seen @ _CLASS_OF) / size[:, None]
        lengths = words.end - words.start
        pairs = np.unique(np.stack((words.of.astype(np.uint64), hashes)), axis=1)[0].astype(np.int64)
        same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (words.of[1:] == words.of[:-1])) if len(hashes) else np.empty(0, np.int64)
        mean = np.bincount(words.of, lengths, rows) / n
        part[:, -6] = mean / 10
        part[:, -5] = np.sqrt(np.maximum(np.bincount(words.of, lengths**2, rows) / n - mean**2, 0)) / 10
        part[:, -4] = np.bincount(pairs, minlength=rows) / n
        part[:, -3] = np.bincount(words.of[same], minlength=rows) / n
        part[:, -2] = np.log1p(words.count) / 10
        part[:, -1] = (seen @ IS_LEAD) / size
    return out


def meta_features(columns: list[list]) -> np.ndarray:
    """Of each column: bins of the value and of its parts (strings), or of its size by eighths of
    an octave (numbers), its size and square, and whether it is missing."""
    wide = _VALUE_BINS + 3
    out = np.zeros((len(columns[0]), wide * len(columns)), np.float16)
    known: dict[tuple, list[int]] = {}
    for j, column in enumerate(columns):
        part = out[:, j * wide : (j + 1) * wide]
        for i, v in enumerate(column):
            if v is None:
                part[i, -1] = 1
                continue
            size = np.log1p(abs(float(v)) if not isinstance(v, str) else len(v))
            part[i, -3], part[i, -2] = size / 10, size * size / 100
            key = (j, v) if isinstance(v, str) else (j, int(size * 8 / np.log(2)) if np.isfinite(size) else -1, v < 0)
            if key not in known:
                names = [v, *_PART.findall(v)] if isinstance(v, str) else [str(key)]
                known[key] = [xxhash.xxh64_intdigest(n, seed=k > 0) % _VALUE_BINS for k, n in enumerate(names)]
            part[i, known[key][1:]] = 0.5
            part[i, known[key][0]] = 1
        if len(known) > 1 << 16:
            known.clear()
    return np.nan_to_num(out, posinf=0, neginf=0)


def featured(docs: DataFrame, meta: tuple[str, ...] = META) -> DataFrame:
    """(doc_id, text_view, meta_view) of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = text_features(as_bytes(batch.column(1))), meta_features([c.to_pylist() for c in batch.columns[2:]])
            packed = [pa.array([r.tobytes() for r in m], pa.binary()) for m in views]
            yield pa.RecordBatch.from_arrays([batch.column(0), *packed], ["doc_id", "text_view", "meta_view"])

    number = lambda c: isinstance(docs.schema[c].dataType, (T.NumericType, T.BooleanType))
    columns = [F.col(c).cast("double" if number(c) else "string").alias(f"meta_{i}") for i, c in enumerate(meta)]
    rows = docs.select(F.col("doc_id").cast("long"), "text", *columns)
    return rows.mapInArrow(run, "doc_id long, text_view binary, meta_view binary")


def _matrix(packed: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(p, np.float16) for p in packed]).astype(np.float64)


def _digest(views: tuple[bytes, bytes]) -> int:
    return xxhash.xxh64_intdigest(views[0] + views[1]) >> 1


class Given(NamedTuple):
    """A pseudo-label that ``view`` gives; rows of equal features come once."""

    view: str
    label: int
    score: float
    digest: int
    text_view: bytes
    meta_view: bytes


def surest(features: DataFrame, text: Model, meta: Model, grow: int, share: float, known: frozenset[int]) -> list[Given]:
    """For each view and class the ``grow`` surest documents of all whose score exceeds the
    class's share, but those of ``known`` digests; of equal scores the smallest digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[str, int], dict[int, Given]] = {(v, y): {} for v in ("text", "meta") for y in (0, 1)}
        for batch in batches:
            views = list(zip(as_bytes(batch.column(1)), as_bytes(batch.column(2)), strict=True))
            for view, model, j in (("text", text, 0), ("meta", meta, 1)):
                p = sigmoid(model.logits(_matrix([v[j] for v in views]))) if views else np.empty(0)
                for y, score, base in ((1, p, share), (0, 1 - p, 1 - share)):
                    best = kept[view, y]
                    fresh: set[int] = set()  # of this batch
                    last = 2.0
                    for i in np.argsort(-score, kind="stable"):
                        s = float(score[i])
                        if s <= base or len(fresh) >= grow and s < last:
                            break
                        digest = _digest(views[i])
                        if digest not in known:
                            best.setdefault(digest, Given(view, y, s, digest, *views[i]))
                            fresh.add(digest)
                            last = s
                    if len(best) > grow:
                        kept[view, y] = {g.digest: g for g in heapq.nsmallest(grow, best.values(), key=lambda g: (-g.score, g.digest))}
        rows = [g for best in kept.values() for g in best.values()]
        if rows:
            kinds = [pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(Given._fields))

    found = features.mapInArrow(run, "view string, label long, score double, digest long, text_view binary, meta_view binary")
    # Equal features have one digest and one score.
    found = materialize(found.groupBy("view", "label", "digest").agg(*(F.max(c).alias(c) for c in ("score", "text_view", "meta_view"))), "surest")
    counts = {(r["view"], r["label"]): r["count"] for r in found.groupBy("view", "label").count().collect()}
    out = []
    for (view, label), n in sorted(counts.items()):
        mine = found.where((F.col("view") == view) & (F.col("label") == label)).withColumn("order", -F.col("score"))
        out += [Given(*(bytes(r[f]) if f.endswith("_view") else r[f] for f in Given._fields)) for r in _least(mine, "order", n, grow, "digest")]
    return out


def _least(rows: DataFrame, order: str, count: int, most: int, *ties: str) -> list:
    """The ``most`` of ``count`` rows of least ``order``, then ``ties``.

    A quantile is asked for first, so that tasks send about as many rows in all, not as many
    each.
    """
    if count > 2 * most:
        share = min(1.0, 1.5 * most / count + 2e-4)
        rows = rows.where(F.col(order) <= rows.agg(F.percentile_approx(order, share, 10000)).first()[0])
    return rows.orderBy(order, *ties).limit(most).collect()


class Trained(NamedTuple):
    """Calibrated models of both views, the prior logit, and for each round how many
    pseudo-labels (view, label) were given and which views kept theirs."""

    text: Model
    meta: Model
    prior: float
    sent: list[dict[tuple[str, int], int]]
    kept: list[tuple[bool, bool]]


class _View:
    """One view's labelled rows and the pseudo-labels it has kept.

    ``folds`` are rows to hold out in turn.  With one of them the model is fitted to the other
    rows; with several, which few labels need, to all, and rows are only held out to calibrate.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, folds: list[np.ndarray]):
        self.x, self.y, self.folds = x, y, folds
        self.more: list[tuple[np.ndarray, int, float]] = []
        self.model, self.loss = self._fitted([])

    def _fit(self, rows: np.ndarray, more: list[tuple[np.ndarray, int, float]]) -> Model:
        x = np.concatenate([self.x[rows], *(m[0][None] for m in more)])
        y = np.concatenate([self.y[rows], [m[1] for m in more]])
        return fit(x, y, np.concatenate([np.ones(rows.sum()), [m[2] for m in more]]))

    def _fitted(self, more: list[tuple[np.ndarray, int, float]]) -> tuple[Model, float]:
        """The calibrated model and its mean loss on the rows held out."""
        models = [self._fit(~f, more) for f in self.folds]
        raw = np.concatenate([m.raw(self.x[f]) for m, f in zip(models, self.folds, strict=True)])
        y = np.concatenate([self.y[f] for f in self.folds])
        slope, shift = platt(raw, y)
        p = np.clip(sigmoid(slope * raw + shift), 1e-6, 1 - 1e-6)
        model = models[0] if len(models) == 1 else self._fit(np.ones(len(self.y), bool), more)
        return model._replace(slope=slope, shift=shift), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    def taught(self, given: list[tuple[np.ndarray, int, float]], slack: float) -> bool:
        """Take pseudo-labels, unless the rows held out say that the view is the worse for them."""
        model, loss = self._fitted(self.more + given)
        if loss > self.loss * (1 + slack) + 1e-3:
            return False
        self.more, self.model, self.loss = self.more + given, model, min(loss, self.loss)
        return True


def _folds(y: np.ndarray) -> list[np.ndarray]:
    """A quarter of many rows, or five parts of few; each class is dealt to all of them."""
    rank = np.empty(len(y), np.int64)
    for c in (0, 1):
        mine = np.flatnonzero(y == c)
        rank[mine] = np.arange(len(mine))
    if min((y == 0).sum(), (y == 1).sum()) >= FEW:
        return [rank % 4 == 3]
    parts = [f for k in range(5) if (f := rank % 5 == k).any() and len(set(y[~f])) == 2]
    return parts or [np.zeros(len(y), bool)]


def train(features: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, grow: int = GROW, rounds: int = ROUNDS, slack: float = 0.02) -> Trained | None:
    """Models after ``rounds``; None if a class has no labels.  A view refuses pseudo-labels that
    raise its loss on held-out rows by more than ``slack``."""
    votes = labels.where(F.col("label").isNotNull()).groupBy("doc_id").agg(F.avg(F.col("label").cast("double")).alias("y")).where("y <> 0.5")
    labelled = features.join(votes, "doc_id").withColumn("order", F.xxhash64("doc_id", "row"))
    rows = _least(labelled, "order", labelled.count(), max_labelled)
    y = np.array([float(r["y"] > 0.5) for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    folds = _folds(y)
    names = ("text_view", "meta_view")
    views = [_View(_matrix([bytes(r[v]) for r in rows]), y, folds) for v in names]
    known = {_digest((bytes(r["text_view"]), bytes(r["meta_view"]))) for r in rows}
    share = float(y.mean())
    sent, kept = [], []
    for _ in range(rounds):
        found = surest(features, views[0].model, views[1].model, grow, share, frozenset(known))
        given: list[list[tuple[np.ndarray, int, float]]] = [[], []]
        for g in found:
            base = share if g.label else 1 - share
            to = 1 if g.view == "text" else 0  # each view teaches the other
            given[to].append((_matrix([g[4 + to]])[0], g.label, (g.score - base) / (1 - base)))
            known.add(g.digest)
        kept.append(tuple(bool(more) and view.taught(more, slack) for view, more in zip(views, given, strict=True)))
        sent.append({(v, label): sum(g.view == v and g.label == label for g in found) for v in ("text", "meta") for label in (0, 1)})
    return Trained(views[0].model, views[1].model, float(logit(y.mean())), sent, kept)


def score(docs: DataFrame, labels: DataFrame, least: float = 0.5, meta: tuple[str, ...] = META, **bounds: int) -> DataFrame:
    """doc_id, text_score, meta_score, score and kept (score >= ``least``) for each document.

    ``labels`` is (doc_id, label 0 or 1); a document with several takes their majority, ties
    and nulls count as unlabelled.  ``meta`` names the columns of the metadata view, strings or
    numbers.  If a class has no labels, all scores are 0.5.  Null texts count as empty, null
    metadata as missing.  Repeated rows and null ids are scored like others, and equal rows are
    one in the choice of pseudo-labels.  A text of any length is measured whole.  An empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    features = materialize(featured(docs, meta).withColumn("row", F.monotonically_increasing_id()), "features")
    models = train(features, labels.select(F.col("doc_id").cast("long"), "label"), **bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if models is None or not batch.num_rows:
                text = meta_ = both = np.full(batch.num_rows, 0.5)
            else:
                a, b = (m.logits(_matrix(as_bytes(batch.column(j)))) for m, j in ((models.text, 1), (models.meta, 2)))
                text, meta_, both = sigmoid(a), sigmoid(b), sigmoid(a + b - models.prior)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text), pa.array(meta_), pa.array(both)], ["doc_id", "text_score", "meta_score", "score"])

    scored = features.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double")
    return scored.withColumn("kept", F.col("score") >= least)


def op4_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return score(docs, labels)
