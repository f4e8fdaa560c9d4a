"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.names import fresh
from quern.llm.vectext import Rolling, Words, as_bytes, groups

#: Largest part of a text's word characters inside n-grams that repeat an earlier one, by n
#: (fixed values: thresholds published for web-text filtering).
COVERAGE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest part of the characters in lines that repeat an earlier line.
DUP_LINE_CHARS = 0.20
#: Largest ratio of symbols to words.
SYMBOLS = 0.1
MIN_WORDS, BASE_N, BASE_PERCENT = 10, 5, 20

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True
LONGS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "line_chars", "dup_line_chars", "n_repeat_words"]
DOUBLES = [f"dup_{n}gram_chars" for n in COVERAGE]


def _mark(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in the n-grams that begin at ``first``."""
    edge = np.bincount(first, minlength=total + n + 1)[: total + n + 1] - np.bincount(first + n, minlength=total + n + 1)[: total + n + 1]
    return np.cumsum(edge)[:total] > 0


def _repeats(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose (text, key) occurs twice or more, and those of them that aren't the
    first."""
    mixed = keys ^ (of.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(mixed)
    same = mixed[order[1:]] == mixed[order[:-1]]
    every = np.sort(order[np.concatenate((same, [False])) | np.concatenate(([False], same))])
    by_key = every[np.argsort(mixed[every], kind="stable")]
    return every, by_key[1:][mixed[by_key[1:]] == mixed[by_key[:-1]]]


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of LONGS and the coverages of DOUBLES for each text."""
    out = {k: np.zeros(len(texts), np.int64) for k in LONGS} | {k: np.zeros(len(texts)) for k in DOUBLES}
    for a, b in groups([len(t) for t in texts]):
        part = {k: v[a:b] for k, v in out.items()}
        _measure(texts[a:b], part)
    return out


def _measure(texts: list[bytes], out: dict[str, np.ndarray]) -> None:
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x.strip()]
        seen: set[bytes] = set()
        for x in lines:
            out["line_chars"][i] += len(x)
            if x in seen:
                out["n_dup_lines"][i] += 1
                out["dup_line_chars"][i] += len(x)
            seen.add(x)
        out["n_lines"][i] = len(lines)
    words = Words(texts)
    out["n_words"][:] = words.count
    total = len(words.start)
    per_text = lambda values: np.bincount(words.of, weights=values, minlength=len(texts))
    symbols = np.concatenate(([0], np.cumsum(_IS_SYMBOL[words.buf], dtype=np.int64)))
    out["n_symbols"][:] = symbols[np.minimum(words.text_start[1:] - 1, len(words.buf))] - symbols[words.text_start[:-1]]
    if not total:
        return
    chars = words.code_points()
    out["word_chars"][:] = per_text(chars)
    rolling = Rolling(words.hashes())
    # A longer n-gram can only repeat where the shortest that begins with it does.
    at = np.arange(total)
    for n in COVERAGE:
        at = at[at + n <= total]
        at = at[words.of[at] == words.of[at + n - 1]]
        if not len(at):
            break
        at, again = _at(at, _repeats(rolling.keys(n, at), words.of[at]))
        out[f"dup_{n}gram_chars"][:] = per_text(chars * _mark(again, n, total)) / np.maximum(out["word_chars"], 1)
        if n == BASE_N:
            out["n_repeat_words"][:] = per_text(_mark(at, n, total))


def _at(at: np.ndarray, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return at[found[0]], at[found[1]]


def measured(docs: DataFrame, text: str = "text", out: str = "repetition") -> DataFrame:
    """``docs`` with a struct column ``out`` (one of that name is replaced) of LONGS and DOUBLES.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text; lengths of words are code points,
    those of lines bytes.  A null text has no words and no lines.
    """
    kind = T.StructType([*(T.StructField(k, T.LongType()) for k in LONGS), *(T.StructField(k, T.DoubleType()) for k in DOUBLES)])
    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = measure(as_bytes(batch.column(text)))
            struct = pa.StructArray.from_arrays([pa.array(v) for v in values.values()], list(values))
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], [*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def base_failed(r: Column) -> Column:
    return (r["n_words"] < MIN_WORDS) | (100 * r["n_repeat_words"] > BASE_PERCENT * r["n_words"])


def repetitive(r: Column) -> Column:
    """The method's own verdict: too much of the text is repeated n-grams, repeated lines or
    symbols."""
    over = [r[f"dup_{n}gram_chars"] > most for n, most in COVERAGE.items()]
    over += [
        r["dup_line_chars"] > DUP_LINE_CHARS * r["line_chars"],
        r["n_symbols"] > SYMBOLS * r["n_words"],
    ]
    found = over[0]
    for x in over[1:]:
        found = found | x
    return found


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the struct ``repetition`` and the booleans ``base_failed`` and ``kept``
    (columns of these names are replaced).

    Each row stands for itself: repeated rows and null ids are measured like others.  Null and
    empty texts fail (no words).  A very long text is measured whole.  A text on a threshold, as
    of two equal shares, is kept.  An empty table gives an empty result.
    """
    rows = measured(docs, text)
    r = F.col("repetition")
    return rows.withColumns({"base_failed": base_failed(r), "kept": ~base_failed(r) & ~repetitive(r)})


def passing(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    out = fresh(docs, "repetition")
    r = F.col(out)
    return measured(docs, text, out).where(~base_failed(r) & ~repetitive(r)).drop(out)


def op7_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = measured(docs).drop("text")
    r = F.col("repetition")
    return rows.select(
        "doc_id",
        *(r[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        base_failed(r).alias("base_failed"),
        (~base_failed(r) & ~repetitive(r)).alias("kept"),
    )
