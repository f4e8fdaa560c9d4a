"""Secret scan by assignment-aware lexing.

The lexer walks a text's assignment operators.  At each it reads the name on the left
(an identifier, a dotted or quoted key) and the literal or reference on the right (quoted
string of one line or more, concatenation of strings, triple-quoted string, YAML block scalar,
bare word), as source, JSON, YAML, INI, environment and command-line syntax write them.  Names bound to literals are constants; a reference on the
right, or a ``${NAME}`` inside a literal, leads back to the constant it names.  A literal is
scored by how sensitive the names that reach it are and by how random it looks.

Three plain patterns are found in any case, whether or not the lexer reads them.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "literal")
_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")

_OPERATOR = re.compile(r"=>|:=|\?=|=(?![=:])|:(?![=:]|//)")
_NAME = re.compile(r"[A-Za-z_$@][\w$.@-]*(?:\[[\"']?[\w.-]+[\"']?\])?")
_NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_$.@-[]\"'`")
_STRING = re.compile(r"[rbuf]{0,2}(?:\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\\n]|\\.)*)`)")
_TRIPLE = re.compile(r"[rbufRBUF]{0,2}(?:\"\"\"((?:[^\"\\]|\\.|\"(?!\"\"))*+)\"\"\"|\'\'\'((?:[^\'\\]|\\.|\'(?!\'\'))*+)\'\'\')", re.DOTALL)
#: A string over lines; what follows its end tells it from a quote that was never closed.
_LINES = re.compile(r"[rbuf]{0,2}(?:\"((?:[^\"\\]|\\.)*+)\"|'((?:[^'\\]|\\.)*+)'|`((?:[^`\\]|\\.)*+)`)(?=[ \t]*(?:[,;:)}\]#]|\r?\n|\Z))", re.DOTALL)
_BLOCK = re.compile(r"(?:[&!]\S*[ \t]+)*[|>][-+0-9]{0,2}[ \t]*(?:#[^\n]*)?\r?\n")
_BARE = re.compile(r"\$\{[A-Za-z_]\w*\}|[^\s\"'`,;{}()\[\]<>#]+")
_PLUS = re.compile(r"\x20*(?:\+|\.\.?|&)\x20*")
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_REFERENCE = re.compile(r"\$\{?([A-Za-z_]\w*)\}?|%\(([A-Za-z_]\w*)\)s|\{\{?\s*([A-Za-z_][\w.]*)\s*\}?\}")

#: Words of a name that make it sensitive, with their weight (fixed values).
SENSITIVE = {
    "password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "pass": 2, "secret": 3, "token": 2, "apikey": 3,
    "credential": 2, "credentials": 2, "auth": 1, "authorization": 2, "bearer": 2, "private": 1, "access": 1,
    "api": 1, "key": 1, "signing": 1, "encryption": 1, "client": 1, "session": 1, "salt": 1, "dsn": 1,
}
#: Words that say a name holds something about a secret, not the secret (fixed values).
HARMLESS = frozenset("name id url uri path file length len type count expiry expires ttl hint label field public format policy".split())
#: Values that stand in for a secret (fixed values).
PLACEHOLDER = re.compile(r"(?i)x{4,}|\*{3,}|changeme|example|placeholder|your[_-]|<[^>]*>|\.{3}|none|null|true|false|undefined|redacted")


_BREAK = re.compile(r"\n|\\n")
_SOLID = re.compile(r"\S*\d\S*")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


class Pair(NamedTuple):
    """``name`` assigned the literal (or, if ``reference``, the name) at start:end."""

    name: str
    value: str
    start: int
    end: int
    reference: bool
    quoted: bool


def base_spans(text: str) -> list[Span]:
    """The three plain patterns, each leftmost and non-overlapping in itself."""
    found = []
    if "=" in text or ":" in text:
        found += [Span("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [Span("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [Span("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def _name_before(text: str, at: int) -> str:
    """The name that ends before ``at``, past spaces, quotes and a type annotation."""
    end = at
    while end and text[end - 1] in " \t":
        end -= 1
    begin = end
    while begin and text[begin - 1] in _NAME_CHARS:
        begin -= 1
    names = _NAME.findall(text[begin:end])
    return names[-1] if names else ""


def _block(text: str, operator: int, at: int) -> tuple[int, int] | None:
    """Where the content of the YAML block scalar lies whose lines begin at ``at``: those
    indented deeper than its key."""
    line = text.rfind("\n", 0, operator) + 1
    key = line
    while text[key] == " " or text.startswith("- ", key):
        key += 1
    first = last = None
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        content = text[at:end].lstrip(" ")
        if content.strip():
            begin = end - len(content)
            if begin - at <= key - line:
                break
            first, last = begin if first is None else first, at + len(text[at:end].rstrip())
        at = end + 1
    return None if first is None else (first, last)


def _long(text: str, operator: re.Match, at: int) -> tuple[int, int] | None:
    """The content of a literal at ``at`` that may go over lines."""
    if m := _TRIPLE.match(text, at):
        return m.span(m.lastindex)
    if operator[0] == ":" and (m := _BLOCK.match(text, at)):
        return _block(text, operator.start(), m.end())
    if not _STRING.match(text, at) and (m := _LINES.match(text, at)):
        return m.span(m.lastindex)
    return None


def lex(text: str) -> list[Pair]:
    """Name-literal and name-reference pairs in the order of the text."""
    pairs, past = [], 0
    for m in _OPERATOR.finditer(text):
        if m.start() < past:
            continue
        name = _name_before(text, m.start())
        if not name:
            continue
        at = m.end()
        while at < len(text) and text[at] in " \t":
            at += 1
        string = _STRING.match(text, at)
        if long := _long(text, m, at):
            value = "\n".join(map(str.strip, text[slice(*long)].split("\n")))
            pairs.append(Pair(name, value, *long, False, True))
            past = long[0]  # what it holds may be assignments too
        elif string:
            value, start, end = "", string.start(string.lastindex or 1), string.end()
            while string:
                value += string[string.lastindex or 1] or ""
                stop, end = string.end(string.lastindex or 1), string.end()
                joint = _PLUS.match(text, end)
                string = joint and _STRING.match(text, joint.end())
            pairs.append(Pair(name, value, start, stop, False, True))
            past = end
        elif bare := _BARE.match(text, at):
            value = bare[0].rstrip(".:")
            if not value:
                continue
            plain = _REFERENCE.fullmatch(value)
            pairs.append(Pair(name, value, at, at + len(value), bool(plain or _NAME.fullmatch(value)), False))
            # A type annotation (name: str = "..."), or a chained assignment, goes on.
            past = at
    return pairs


def name_weight(name: str) -> int:
    words = [w.lower() for w in _SPLIT.findall(name)]
    if not words or words[-1] in HARMLESS or words[0] == "public":
        return 0
    return sum(SENSITIVE.get(w, 0) for w in set(words)) + 2 * ("api" in words and "key" in words)


def randomness(value: str) -> float:
    """Bits of entropy a character, and a bit for each further class of characters."""
    if not value:
        return 0.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in value)
    return bits + 0.5 * (classes - 1)


def score(weight: int, value: str, quoted: bool) -> float:
    """0 to 1: names count most, then randomness and length."""
    if weight == 0 or len(value) < 8:
        return 0.0
    lines = [x for x in _BREAK.split(value) if x and not x.startswith("-----")] if _BREAK.search(value) else [value]
    if all(map(PLACEHOLDER.search, lines)):
        return 0.0
    # Prose of several lines is no secret because of a name that says little.
    if "\n" in value and weight < 2 and "PRIVATE KEY-----" not in value and not any(_SOLID.fullmatch(x) and randomness(x) >= 3.5 for x in lines):
        return 0.0
    return min(1.0, 0.15 * weight + 0.1 * min(randomness(value), 4.5) + (0.1 if quoted else 0) + 0.01 * min(len(value), 20))


def _referred(pair: Pair) -> list[str]:
    if pair.reference:
        m = _REFERENCE.fullmatch(pair.value)
        return [next(filter(None, m.groups())) if m else pair.value]
    return [next(filter(None, m.groups())) for m in _REFERENCE.finditer(pair.value)]


def literal_spans(text: str, least: float) -> list[Span]:
    """Literals that sensitive names reach, directly or through constants."""
    pairs = lex(text)
    weights = [name_weight(p.name) for p in pairs]
    if not any(weights):
        return []
    bound: dict[str, list[int]] = {}
    for i, p in enumerate(pairs):
        bound.setdefault(p.name, []).append(i)
    # A name gets the weight of the heaviest pair that leads to it; each is reached once.
    reached: dict[str, int] = {}
    for i in sorted(range(len(pairs)), key=lambda i: -weights[i]):
        if not weights[i]:
            break
        ahead = [i]
        while ahead:
            for n in _referred(pairs[ahead.pop()]):
                if n not in reached and n in bound:
                    reached[n] = weights[i]
                    ahead += bound[n]
    found = []
    for p, weight in zip(pairs, weights, strict=True):
        weight = max(weight, reached.get(p.name, 0))
        if not weight or p.reference and any(n in bound for n in _referred(p)):
            continue
        # A bare word counts only if it looks like no word; a string always.
        likely = p.quoted or any(map(str.isdigit, p.value)) and randomness(p.value) >= (3.5 if p.reference else 3)
        if found and p.end <= found[-1].end:
            continue  # inside a literal over lines
        if likely and score(weight, p.value, p.quoted) >= least:
            found.append(Span("literal", p.start, p.end))
    return found


def scan(text: str | None, least: float = 0.6) -> list[Span]:
    """All spans of a text (code points, end exclusive), by start, then kind as listed.

    A literal that a base span covers is not listed again.
    """
    if not text:
        return []
    found = base_spans(text)
    if "=" in text or ":" in text:
        base = sorted(found, key=lambda s: s.start)
        starts, reach = [s.start for s in base], list(accumulate((s.end for s in base), max))
        for s in literal_spans(text, least):
            before = bisect_right(starts, s.start)
            if before == 0 or reach[before - 1] < s.end:
                found.append(s)
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def with_spans(docs: DataFrame, text: str = "text", out: str = "spans", least: float = 0.6) -> DataFrame:
    """``docs`` with an array column of (kind, start, end) of the whole text.

    A null or empty text has no spans.  A very long text is scanned whole.  Spans of one start
    come in the order of KINDS, then the shorter first.  Each row stands for itself: repeated rows
    and null ids stay.  An empty table gives an empty result; other columns pass through.
    """
    docs = docs.drop(out)  # one of that name is replaced
    schema = T.StructType([*docs.schema.fields, T.StructField(out, _SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[s._asdict() for s in scan(x.as_py(), least)] for x in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", least: float = 0.6) -> DataFrame:
    """``docs`` with every span replaced by ``[kind]`` (overlapping spans by one, that of the
    first), and ``n_chars``, where there is one, counted anew for the texts that changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            columns = dict(zip(names, batch.columns, strict=True))
            texts = columns[text].to_pylist()
            spans = [scan(x, least) for x in texts]
            if any(spans):
                clean = [masked(x, s) if s else x for x, s in zip(texts, spans, strict=True)]
                columns[text] = pa.array(clean, columns[text].type)
                if n_chars in columns:
                    counts = [len(x) if s else n for x, s, n in zip(clean, spans, columns[n_chars].to_pylist(), strict=True)]
                    columns[n_chars] = pa.array(counts, columns[n_chars].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return docs.mapInArrow(run, docs.schema)


def masked(text: str, spans: list[Span]) -> str:
    parts, at = [], 0
    for s in spans:
        if s.start >= at:
            parts += [text[at : s.start], f"[{s.kind}]"]
        at = max(at, s.end)
    return "".join([*parts, text[at:]])


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_assignment_lexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = with_spans(docs).select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return rows.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
