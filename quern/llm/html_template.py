"""Main text of web pages by equivalence classes of template tokens.

A page is parsed once, into tokens: the start and end of every block element, known by its
path, and every block of text, known by its path and wording.  The occurrence vector of a token
over the pages of its host is kept as a sum of hashes of (page, count), so vectors are compared
without being gathered: equal sums are equal vectors.  Tokens of one vector are an equivalence
class.  The class that spans most is the template's frame; it is valid in as far as its tokens
come in one order.  A class that lies in one slot of the frame, on all pages, is valid and
nests there; classes that straddle slots are not.  Text of a valid class is template: text that
all pages share, and text that comes and goes with the element around it.  What the remaining
slots hold is extracted: the smallest element that has all of it, or an element that says it is
the article, less what is marked as menu, advert, form and the like.

Hosts may be of any size.  Counts go by (host, token), what is known of a host meets its pages
by broadcast if it is small in all (measured), and otherwise in a join for which the pages of
each large host are dealt to parts in proportion to their bytes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.html_blocks import ARTICLE, ASIDE, BOX, MAIN, NAMED, START, TEXT, WHOLE, parse
from quern.llm.patience import rising
from quern.llm.spread import BROADCAST_BYTES, Spread
from quern.llm.vectext import as_bytes
from quern.scratch import materialize

#: Bytes of pages from which a host is dealt to parts.
PART_BYTES = 64 << 20
#: Share of a host's pages, in percent, that hold a template token; that hold text which is
#: template whatever is around it; that may break the frame's order at a token.
OFTEN, ALWAYS, DISORDER = 50, 90, 5
LEAST_PAGES = 3


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


_PARSED = T.StructType(
    [
        T.StructField("host", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("digest", T.LongType()),
        *(T.StructField(k, T.BinaryType()) for k in ("keys", "kinds", "links", "blocks")),
        T.StructField("texts", T.ArrayType(T.StringType())),
    ]
)


def _parsed(rows: DataFrame) -> DataFrame:
    """``rows`` (page_id, url, host, html) with html parsed, written once for all that follows."""
    schema = T.StructType([*rows.schema.fields[:2], *_PARSED.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for data in as_bytes(batch.column(3)):
                page = parse(data.decode("utf-8", "replace"))
                places = np.array([(b.at, b.box, b.aside) for b in page.blocks], np.int32)
                packed = (np.array(page.keys, np.int64).tobytes(), bytes(page.kinds), np.array(page.links, np.int32).tobytes(), places.tobytes())
                out.append((len(data), xxhash.xxh64_intdigest(data) >> 1, *packed, [b.text for b in page.blocks]))
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.list_(pa.string())]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 7, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], schema.names)

    return materialize(rows.select("page_id", "url", "host", "html").mapInArrow(run, schema), "parsed")


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _firsts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new combination of the keys begins."""
    new = np.ones(len(sorted_keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return np.flatnonzero(new)


_COUNTS = T.StructType([T.StructField("host", T.StringType()), *(T.StructField(k, T.LongType()) for k in ("key", "pages", "times", "vec_a", "vec_b", "pos", "kind", "asides", "above", "bytes"))])


def _words(blocks_: np.ndarray, texts: list[str], size: int) -> np.ndarray:
    """For each token the words, outside marked elements, of the blocks before it."""
    at = np.zeros(size + 1, np.int64)
    at[blocks_[:, 0] + 1] = [0 if aside else t.count(" ") + 1 for aside, t in zip(blocks_[:, 2], texts, strict=True)]
    return np.cumsum(at)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each (host, token) in an Arrow batch; token 0 counts the pages that have any."""
    for batch in batches:
        hosts, host = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
        digest = np.array(batch.column(2).to_pylist(), np.uint64)
        keys, kinds, above, page, pos = [], [], [], [], []
        for i, (k, kind, link) in enumerate(zip(*(as_bytes(batch.column(j)) for j in (3, 4, 5)), strict=True)):
            k, kind, link = np.frombuffer(k, np.int64), np.frombuffer(kind, np.uint8), np.frombuffer(link, np.int32)
            over = np.where((kind & 3 == TEXT) & (link >= 0), k[np.maximum(link, 0)] if len(k) else 0, 0)
            for to, values in ((keys, k), (kinds, kind), (above, over), (page, np.full(len(k), i)), (pos, np.arange(len(k)))):
                to.append(values)
            if len(k):
                for to, value in ((keys, 0), (kinds, 0), (above, 0), (page, i), (pos, 0)):
                    to.append(np.array([value]))
        if not batch.num_rows or not sum(map(len, keys)):
            continue
        keys, kinds, above, page, pos = (np.concatenate(x).astype(np.int64) for x in (keys, kinds, above, page, pos))
        order = np.lexsort((pos, keys, page))
        keys, kinds, above, page, pos = (x[order] for x in (keys, kinds, above, page, pos))
        at = _firsts(page, keys)
        times = np.diff(np.append(at, len(keys)))
        aside = np.logical_and.reduceat(kinds & ASIDE > 0, at)
        keys, kinds, above, page, pos = (x[at] for x in (keys, kinds, above, page, pos))
        vector = _mix(digest[page] + _mix(times.astype(np.uint64)))
        order = np.lexsort((keys, host[page]))
        keys, kinds, above, page, pos, times, aside, vector = (x[order] for x in (keys, kinds, above, page, pos, times, aside, vector))
        of = host[page]
        at = _firsts(of, keys)
        total = lambda x: np.add.reduceat(x.astype(np.int64), at)
        size = np.array(batch.column(1).to_pylist(), np.int64)[page] * (keys == 0)
        halves = vector >> np.uint64(33), vector & np.uint64(0x7FFFFFFF)
        columns = [keys[at], total(np.ones_like(keys)), total(times), total(halves[0]), total(halves[1]), total(pos), kinds[at] & ~ASIDE, total(aside), above[at], total(size)]
        yield pa.RecordBatch.from_arrays([pa.array(hosts[of[at]].tolist(), pa.string()), *map(pa.array, columns)], _COUNTS.names)


def _counted(parsed: DataFrame) -> DataFrame:
    sums = [F.sum(k).alias(k) for k in ("pages", "times", "vec_a", "vec_b", "pos", "asides", "bytes")]
    rows = parsed.select("host", "size", "digest", "keys", "kinds", "links").mapInArrow(_count, _COUNTS)
    return materialize(rows.groupBy("host", "key").agg(*sums, F.max("kind").alias("kind"), F.max("above").alias("above")), "tokens")


# A host's template: its classes, then what their places on all pages leave of them.


def classes(tokens: list[dict], n: int) -> dict:
    """The classes of a host's tokens, as {main, members, texts, boxes}.

    ``main`` is the frame's class in the order of its mean places; ``texts`` are the texts that
    may be template, with the class of each (0: any); ``members`` the tokens of the classes
    whose places must be seen; ``boxes`` the elements that may hold the article."""
    found: dict[tuple, list[dict]] = {}
    of: dict[int, tuple] = {}
    for t in tokens:
        vector = of[t["key"]] = (t["pages"], t["times"], t["vec_a"], t["vec_b"])
        found.setdefault(vector, []).append(t)
    once = [(len(c) * v[0], v[0], v) for v, c in found.items() if v[0] == v[1]]
    main = max(once)[2] if once else None
    numbers = {v: i for i, v in enumerate(sorted(found), 1)}
    texts, members = {}, {}
    for t in tokens:
        if t["kind"] & 3 != TEXT or n < LEAST_PAGES or t["pages"] < LEAST_PAGES:
            continue
        vector = of[t["key"]]
        if of.get(t["above"]) == vector:  # it comes and goes with its element
            texts[t["key"]] = numbers[vector]
            if vector != main:
                members |= {m["key"]: numbers[vector] for m in found[vector]}
        elif 100 * t["pages"] >= ALWAYS * n:
            texts[t["key"]] = 0
    boxes = [t["key"] for t in tokens if t["kind"] & 3 == START and t["kind"] & (BOX | ARTICLE | MAIN) and 2 * t["asides"] <= t["pages"]]
    ranked = sorted(found.get(main, []), key=lambda t: (t["pos"] / t["pages"], t["key"]))
    frame = numbers.get(main, 0)
    return {"main": [t["key"] for t in ranked], "frame": frame, "members": sorted(members.items()), "texts": sorted(texts.items()), "boxes": sorted(boxes)}


def deduced(tokens: list[dict], n: int, candidates: dict, seen: list[dict]) -> dict:
    """A host's template {texts, boxes, regions}: the texts of valid classes; the elements that
    hold other words; and the elements to extract, in order of preference."""
    by_key = {t["key"]: t for t in tokens}
    found = {s["key"]: s for s in seen}
    broken = {k for k in candidates["main"] if (s := found.get(k)) and 100 * s["bad"] > DISORDER * by_key[k]["pages"]}
    slots: dict[int, set] = {}
    for k, number in candidates["members"]:
        if s := found.get(k):
            slots.setdefault(number, set()).update((s["lo"], s["hi"]))
    nested = {number for number, at in slots.items() if len(at) == 1}
    valid = lambda k, number: number == 0 or (k not in broken if number == candidates["frame"] else number in nested)
    texts = [k for k, number in candidates["texts"] if valid(k, number)]
    words = {k: found[k]["words"] for k in candidates["boxes"] if k in found}
    total = found[0]["words"] if 0 in found else 0
    rank = {k: i for i, k in enumerate(candidates["main"])}
    for k, number in candidates["texts"]:  # what is no template after all may be the article's
        if not valid(k, number) and (s := found.get(k)):
            total += s["words"]
            for b in words:
                if b in rank and rank[b] <= s["lo"] and s["hi"] < rank.get(b | 1, -1):
                    words[b] += s["words"]
    words = {k: held for k, held in words.items() if held}
    rated = []
    for k, held in words.items():
        t = by_key[k]
        # An element that comes more than once on a page is no slot of its own.
        if t["times"] != t["pages"] or k in broken:
            continue
        place = t["pos"] / t["pages"]
        if t["kind"] & (ARTICLE | MAIN):
            rated.append((3, bool(t["kind"] & ARTICLE), held, place, k))
        elif t["kind"] & NAMED and 2 * held >= total:
            rated.append((2, False, held, place, k))
        elif held == total and t["kind"] & BOX:
            rated.append((1, False, place, held, k))  # the innermost
    regions = [r[-1] for r in sorted(rated, reverse=True)]
    said = [k for k in regions if by_key[k]["kind"] & (ARTICLE | MAIN)]
    other = [k for k in regions if k not in said][:1]
    return {"texts": texts, "boxes": sorted(words), "said": said, "other": other}


class Places(NamedTuple):
    main: np.ndarray  # sorted keys of the frame, and the rank of each
    rank: np.ndarray
    texts: np.ndarray
    watched: np.ndarray
    boxes: np.ndarray


@lru_cache(maxsize=4096)
def _places(candidates: str) -> Places:
    c = json.loads(candidates)
    main = np.array(c["main"], np.int64)
    order = np.argsort(main, kind="stable")
    sorted_ = lambda keys: np.unique(np.array(keys, np.int64))
    texts = sorted_([k for k, _ in c["texts"]])
    return Places(main[order], order, texts, sorted_([k for k, _ in c["members"]]), sorted_(c["boxes"]))


def _in(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys if len(known) else np.zeros(len(keys), bool)


def look(page: tuple[np.ndarray, ...], texts: list[str], places: Places) -> list[tuple[int, int, int, int, int]]:
    """(key, lowest slot, highest slot, out of order, words that may be the article's) of the
    tokens of a page that are watched; slots are those of the frame.  Key 0 has all words."""
    keys, kinds, links, placed = page
    out = []
    at = np.flatnonzero(_in(keys, places.main))
    rank = places.rank[np.searchsorted(places.main, keys[at])]
    if len(rank) > 1 and not (np.diff(rank) > 0).all():
        kept = np.zeros(len(rank), bool)
        kept[rising(rank.tolist())] = True
        out += [(int(k), 1 << 60, -1, 1, 0) for k in keys[at[~kept]]]
        at, rank = at[kept], rank[kept]
    slot = np.concatenate(([-1], rank))
    own = placed.copy()
    constant = _in(keys[own[:, 0]], places.texts)
    for j in np.flatnonzero(constant & (own[:, 2] == 0)):
        s = int(slot[np.searchsorted(at, own[j, 0])])
        out.append((int(keys[own[j, 0]]), s, s, 0, texts[j].count(" ") + 1))
    own[:, 2] |= constant
    words = _words(own, texts, len(keys))
    for i in np.flatnonzero(_in(keys, places.watched)):
        s = int(slot[np.searchsorted(at, i)])
        out.append((int(keys[i]), s, s, 0, 0))
    for i in np.flatnonzero(_in(keys, places.boxes) & (kinds & 3 == START) & (kinds & ASIDE == 0)):
        out.append((int(keys[i]), 1 << 60, -1, 0, int(words[links[i]] - words[i])))
    return [*out, (0, 1 << 60, -1, 0, int(words[-1]))]


def _arrays(batch: pa.RecordBatch, first: int) -> Iterator[tuple[tuple[np.ndarray, ...], list[str]]]:
    """Each page of the columns keys, kinds, links, blocks and texts."""
    for keys, kinds, links, placed, texts in zip(*(as_bytes(batch.column(first + j)) for j in range(4)), batch.column(first + 4).to_pylist(), strict=True):
        arrays = np.frombuffer(keys, np.int64), np.frombuffer(kinds, np.uint8), np.frombuffer(links, np.int32), np.frombuffer(placed, np.int32).reshape(-1, 3)
        yield arrays, texts


_SEEN = "host string, key long, lo long, hi long, bad long, words long"


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums: dict[tuple[str, int], list[int]] = {}
        for host_, candidates, (page, texts) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _arrays(batch, 2), strict=True):
            if candidates is None or not len(page[0]):
                continue
            for key, lo, hi, bad, words in look(page, texts, _places(candidates)):
                row = sums.setdefault((host_, key), [lo, hi, 0, 0])
                row[0], row[1], row[2], row[3] = min(row[0], lo), max(row[1], hi), row[2] + bad, row[3] + words
        if sums:
            columns = zip(*((*k, *v) for k, v in sums.items()), strict=True)
            kinds = [pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "key", "lo", "hi", "bad", "words"])


def templates(parsed: DataFrame, sums: DataFrame, beside: Spread) -> DataFrame:
    """(host, template) from all pages.

    A host keeps the tokens that at least half of its pages have: at most twice as many as an
    average page, however many pages there are.
    """
    counted = beside.join(sums.where("key <> 0 and (pages > 1 or times > 1 or kind <> 0)"), sums.where("key = 0").select("host", F.col("pages").alias("n")), "key", F.lit(16))
    often = counted.where(f"100 * pages >= {OFTEN} * n")
    fields = ("key", "pages", "times", "vec_a", "vec_b", "pos", "kind", "asides", "above")
    per_host = often.groupBy("host", "n").agg(F.collect_list(F.struct(*fields)).alias("tokens"))

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found = [json.dumps(classes(r["tokens"], r["n"])) for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "candidates"])

    schema = T.StructType([*per_host.schema.fields, T.StructField("candidates", T.StringType())])
    known = materialize(per_host.mapInArrow(classed, schema), "classes")
    rows = parsed.select("host", "digest", "keys", "kinds", "links", "blocks", "texts")
    met = beside.join(rows, known.select("host", "candidates"), "digest", F.octet_length("candidates"))
    seen = (
        met.select("host", "candidates", "keys", "kinds", "links", "blocks", "texts")
        .mapInArrow(_look, _SEEN)
        .groupBy("host", "key")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("bad").alias("bad"), F.sum("words").alias("words"))
        .groupBy("host")
        .agg(F.collect_list(F.struct("key", "lo", "hi", "bad", "words")).alias("seen"))
    )

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found = [json.dumps(deduced(r["tokens"], r["n"], json.loads(r["candidates"]), r["seen"] or [])) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["host", "template"])

    return materialize(known.join(seen, "host", "left").select("host", "n", "tokens", "candidates", "seen").mapInArrow(finished, "host string, template string"), "templates")


class Template(NamedTuple):
    texts: np.ndarray
    boxes: np.ndarray
    said: list[int]
    other: list[int]


@lru_cache(maxsize=4096)
def _loaded(template: str) -> Template:
    t = json.loads(template)
    return Template(np.array(sorted(t["texts"]), np.int64), np.array(t["boxes"], np.int64), t["said"], t["other"])


_NONE = Template(np.empty(0, np.int64), np.empty(0, np.int64), [], [])


def main_text(page: tuple[np.ndarray, ...], texts: list[str], template: Template = _NONE) -> str:
    """What the slots of a page hold, two newlines between blocks.

    In an article or main element that is all unmarked text.  In another element, what is
    template is left out if nothing but template is in the innermost element that parts the page;
    in the page as a whole, all template is.  If that leaves nothing, nothing is left out."""
    keys, kinds, links, placed = page
    at, aside = placed[:, 0], placed[:, 2] > 0
    starts = (kinds & 3 == START) & (kinds & ASIDE == 0)
    where = lambda key: np.flatnonzero(starts & (keys == key))
    spans = next((w for k in template.said if len(w := where(k))), np.empty(0, np.int64))
    if not len(spans):
        for kind in (ARTICLE, MAIN):
            if not len(spans):
                spans = np.flatnonzero(starts & (kinds & kind > 0))
    told = len(spans) > 0
    if not told:
        spans = next((w for k in template.other if len(w := where(k))), spans)
    inside = ~aside
    if len(spans):
        depth = np.zeros(len(keys) + 1, np.int64)
        np.add.at(depth, spans, 1)
        np.add.at(depth, links[spans], -1)
        inside &= np.cumsum(depth)[at] > 0
    if not told and len(template.texts):
        constant = _in(keys[at], template.texts)
        if len(spans) and not kinds[spans[0]] & WHOLE:
            box = placed[:, 1]
            constant &= (box < 0) | ~_in(keys[np.maximum(box, 0)], template.boxes)
        if (inside & ~constant).any():
            inside &= ~constant
    return "\n\n".join(texts[i] for i in np.flatnonzero(inside))


def extract(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) with the main text: page_id, url, text.

    One row for each row: repeated rows and null ids stay, and copies of a page weigh as pages.
    Null and empty html give an empty text; pages without a host share a template, which takes
    three pages at least.  A page takes time and memory in proportion to its length, whatever it
    holds, and is never cut.  Ties between elements go to the one that comes later on the page,
    then to the larger key.  An empty table gives an empty result; other columns are ignored.
    """
    parsed = _parsed(pages.select("page_id", "url", host(F.col("url")).alias("host"), "html"))
    sums = _counted(parsed)
    beside = Spread(sums.where("key = 0").select("host", F.col("bytes").alias("weight")), "host", part_bytes, broadcast_bytes)
    known = templates(parsed, sums, beside)
    rows = parsed.select("host", "page_id", "url", "digest", "keys", "kinds", "links", "blocks", "texts")
    met = beside.join(rows, known, "digest", F.octet_length("template")).select("page_id", "url", "template", "keys", "kinds", "links", "blocks", "texts")
    schema = T.StructType([*met.schema.fields[:2], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(page, texts, _loaded(t) if t else _NONE) for t, (page, texts) in zip(batch.column(2).to_pylist(), _arrays(batch, 3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], schema.names)

    return met.mapInArrow(run, schema)


def op8_template_deduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
