"""License scan by patience alignment with license texts and notices.

A text's word trigrams are looked up among those of the templates.  Around the trigrams of a
template the words are aligned with it by patience; the part of the template's words that are
matched is its coverage.  The templates are a fixed list of a few hundred kilobytes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.decontamination import fold
from quern.llm.license_texts import TEXTS
from quern.llm.patience import align
from quern.llm.vectext import Rolling, Words, as_bytes, groups

N, LEAST, SHORT = 3, 0.75, 15


class Found(NamedTuple):
    license: str
    coverage: float
    start: int
    end: int
    matched: int


class Templates:
    def __init__(self, texts: list[tuple[str, str]]):
        self.names = [n for n, _ in texts]
        words = Words([fold(t.encode()) for _, t in texts])
        hashes = words.hashes()
        self.words = [hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        keys = Rolling(hashes).keys(N)
        at = np.flatnonzero(words.of[: len(keys)] == words.of[N - 1 :])
        order = np.argsort(keys[at], kind="stable")
        self.keys, self.of, self.place = keys[at][order], words.of[at][order], (at - words.first[words.of[at]])[order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.keys >> np.uint64(44)] = True

    def scan(self, texts: list[bytes], least: float) -> list[list[Found]]:
        out: list[list[Found]] = [[] for _ in texts]
        for a, b in groups([len(t) for t in texts]):
            self._scan(texts[a:b], least, out[a:b])
        return out

    def _scan(self, texts: list[bytes], least: float, out: list[list[Found]]) -> None:
        words = Words([fold(t) for t in texts])
        hashes = words.hashes()
        keys = Rolling(hashes).keys(N)
        at = np.flatnonzero(self.filter[keys >> np.uint64(44)])
        at = at[words.of[at] == words.of[at + N - 1]]
        low, high = np.searchsorted(self.keys, keys[at]), np.searchsorted(self.keys, keys[at], "right")
        hits: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for p, lo, hi in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
            for k in range(lo, hi):
                hits.setdefault((int(words.of[p]), int(self.of[k])), []).append((p - int(self.place[k]), p))
        for (text, template), mine in hits.items():
            first, last = int(words.first[text]), int(words.first[text + 1])
            out[text] += self._spans(template, mine, hashes, first, last, least)
        for i, found in enumerate(out):
            if found:
                out[i][:] = best(found)

    def _spans(self, template: int, hits: list[tuple[int, int]], hashes: np.ndarray, first: int, last: int, least: float) -> list[Found]:
        """The copies of a template in a text, from (where the template would begin, place) of
        the trigrams they share.

        Each diagonal with most trigrams around is aligned in a window of its own, so copies
        that follow one another are told apart.  Trigrams that no copy so found holds are then
        aligned by runs that agree, give or take half a length: copies with much put in."""
        item = self.words[template]
        size = len(item)
        short = size <= SHORT
        need, slack = size if short else least * size, size // 4 if short else size // 2
        if last - first < need:
            return []
        found: list[Found] = []
        for d in _peaks(np.array([d for d, _ in hits], np.int64), size):
            k = bisect_left(found, d + slack - first, key=lambda f: f.start)
            low, high = first + found[k - 1].end if k else first, first + found[k].start if k < len(found) else last
            for wide in (0, slack) if short else (size // 16, size // 4, slack):
                got = self._aligned(template, hashes, max(low, d - wide), min(high, d + size + wide), first, need)
                if got and (not short or got.end - got.start <= size + slack):
                    found.insert(k, got)
                    break
        if short:
            return found
        ends = np.array([first + f.end for f in found], np.int64)
        runs: list[list[int]] = []
        before = -1
        for d, p in sorted(hits):
            k = int(np.searchsorted(ends, p, "right"))
            if k < len(found) and first + found[k].start <= p:
                continue
            if runs and k == before and d - runs[-1][1] <= slack:
                runs[-1][1] = d
            else:
                runs.append([d, d, k])
            before = k
        for low, high, k in runs:
            a = max(first, low - slack, int(ends[k - 1]) if k else first)
            b = min(last, high + size + slack, first + found[k].start if k < len(ends) else last)
            if got := self._aligned(template, hashes, a, b, first, need):
                found.append(got)
        return found

    def _aligned(self, template: int, hashes: np.ndarray, a: int, b: int, first: int, need: float) -> Found | None:
        item = self.words[template]
        # No more words can match than are there at all.
        if b - a < need or np.isin(item, hashes[a:b]).sum() < need:
            return None
        pairs = align(hashes[a:b], item)
        return self._found(template, len(pairs), a + pairs[0][0] - first, a + pairs[-1][0] + 1 - first) if len(pairs) >= need else None

    def _found(self, template: int, matched: int, start: int, end: int) -> Found:
        return Found(self.names[template], matched / len(self.words[template]), start, end, matched)


def _peaks(begins: np.ndarray, size: int) -> list[int]:
    """Of the diagonals those with most trigrams within an eighth of ``size``, best first, none
    nearer than half of it to a better one."""
    places, counts = np.unique(begins, return_counts=True)
    total = np.concatenate(([0], np.cumsum(counts)))
    near = total[np.searchsorted(places, places + size // 8, "right")] - total[np.searchsorted(places, places - size // 8)]
    kept: list[int] = []
    out: list[int] = []
    for d in places[np.lexsort((places, -counts, -near))].tolist():
        k = bisect_left(kept, d)
        if (k == len(kept) or kept[k] - d >= size // 2) and (k == 0 or d - kept[k - 1] >= size // 2):
            kept.insert(k, d)
            out.append(d)
    return out


def best(found: list[Found]) -> list[Found]:
    """Of overlapping spans that of the longest cover (then the best, then that of
    most words, then first by name)."""
    kept: list[Found] = []
    for f in sorted(set(found), key=lambda f: (-f.coverage * (f.end - f.start), -f.coverage, -f.matched, f.license, f.start)):
        k = bisect_left(kept, f.end, key=lambda g: g.start)
        if k == 0 or kept[k - 1].end <= f.start:
            kept.insert(k, f)
    return kept


_FOUND = T.ArrayType(
    T.StructType(
        [T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
    )
)


def with_licenses(docs: DataFrame, text: str = "text", out: str = "licenses", texts: list[tuple[str, str]] = TEXTS, least: float = LEAST) -> DataFrame:
    """``docs`` with an array of (license, coverage, start, end), places in words.

    All templates are aligned.  Of one of up to 15 words every word must be matched, with no
    more than a quarter as many put in between; longer ones must be covered to ``least``.  Of
    spans that overlap the longest cover counts, of equal ones the first by name.  Null and empty
    texts hold none; a very long text is scanned whole.  Each row stands for itself: repeated rows and null ids stay.  An
    empty table gives an empty result; other columns pass through.
    """
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
    docs = docs.drop(out)  # one of that name is replaced
    schema = T.StructType([*docs.schema.fields, T.StructField(out, _FOUND)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(texts)
        for batch in batches:
            found = [[{k: v for k, v in f._asdict().items() if k != "matched"} for f in x] for x in templates.scan(as_bytes(batch.column(text)), least)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def op9_patience_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_licenses(docs).select("doc_id", F.explode("licenses").alias("l")).select(
        "doc_id", "l.license", F.round("l.coverage", 6).alias("coverage"), F.col("l.start").alias("start_word"), F.col("l.end").alias("end_word")
    )
