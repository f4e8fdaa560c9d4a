"""SimHash near-duplicates over a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes.  Fingerprints that differ in at most
``max_bits`` = 2 bits share at least 6 of the 8 (the guaranteed minimum), so among the first
7 positions at least 5.  A posting of one byte would hold 1/256 of the corpus; the index
therefore posts each fingerprint under every choice of 5 of its first 7 positional bytes
(21 keys of 40 bits), tallies the shared positional bytes of the pairs that meet, keeps
those with 6 or more, and verifies them by their differing bits.

Equal fingerprints are one node from the start, so copies never meet in a posting.  A
posting of up to ``small`` fingerprints is compared pairwise inside its row.  A larger one
is linked exactly without pairs: all its members agree on 40 bits, and two of them differ
in at most 2 of the other 24 bits if and only if flipping at most one of these bits in each
makes them equal; each member is posted under its 25 variants, and those that meet in a
variant (25 at most) are linked to the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import prefixes, shingles
from quern.llm.names import fresh
from quern.llm.spread import lean
from quern.llm.vectext import Lanes, as_bytes, groups, xxh64
from quern.scratch import materialize

MAX_BITS = 2
_POSITIONS, _CHOSEN = 7, 5
_CHOICES = list(combinations(range(_POSITIONS), _CHOSEN))
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """64-bit SimHash of each text over its 3-word shingles, repeats included.

    Words are what is left between ASCII white space after lower-casing A-Z.  A text of one or
    two words is one shingle; a text without words has fingerprint zero.
    """
    out = np.zeros(len(texts), np.uint64)
    for a, b in groups([len(t) for t in texts]):
        normal = [b" ".join(t.lower().split()) for t in texts[a:b]]
        rows = [i for i, t in enumerate(normal) if t]
        if not rows:
            continue
        data = b" ".join(normal[i] for i in rows)
        counts = np.array([normal[i].count(b" ") + 1 for i in rows], np.int64)
        gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
        start, end = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))
        shingles = np.maximum(counts - 2, 1)
        of = np.repeat(np.arange(len(rows)), shingles)
        word0 = np.cumsum(counts) - counts
        first = np.arange(len(of)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + word0[of]
        last = np.minimum(first + 2, (word0 + counts - 1)[of])
        hashes = xxh64(Lanes(data), start[first], end[last])
        lanes = hashes.view(np.uint8).reshape(-1, 8)
        value = np.zeros(len(rows), np.uint64)
        for j in range(8):
            seen = np.bincount(of * 256 + lanes[:, j], minlength=256 * len(rows)).reshape(-1, 256)
            bits = (2 * (seen @ _BYTE_BITS) > shingles[:, None]).astype(np.uint64)
            value |= (bits << np.arange(8 * j, 8 * j + 8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        out[np.array(rows) + a] = value
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "simhash", bands: str | None = None) -> DataFrame:
    """``docs`` with a bigint column ``out`` (one of that name is replaced); null text counts
    as empty.  ``bands`` names a column for the band keys of ``shingles``, made in the same pass:
    a second Python stage would hold as many workers again."""
    docs = docs.drop(out)
    more = [T.StructField(out, T.LongType())] + ([T.StructField(bands, T.ArrayType(T.LongType()))] if bands else [])
    schema = T.StructType([*docs.schema.fields, *more])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(text))
            columns = [*batch.columns, pa.array(fingerprints(texts).view(np.int64))]
            if bands:
                columns.append(shingles.as_lists(shingles.bands(texts)))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(add, schema)


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * position).bitwiseAND(F.lit(255).cast("long"))


def _tally(a: Column, b: Column) -> Column:
    """Positional bytes that two fingerprints share."""
    x = a.bitwiseXOR(b)
    return sum(((_byte(x, j) == 0).cast("int") for j in range(1, 8)), (_byte(x, 0) == 0).cast("int"))


def _near(a: Column, b: Column) -> Column:
    return (_tally(a, b) >= 8 - MAX_BITS) & (F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS)


def links(prints: DataFrame, fp: str = "simhash", small: int = 16) -> DataFrame:
    """Links (a, b), a < b, between the distinct fingerprints of ``prints`` that connect all
    pairs differing in 1 or 2 bits: every such pair is linked, or both to a third."""
    masks = [sum(0xFF << (8 * j) for j in c) for c in _CHOICES]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = prints.select(F.col(fp).alias("fp")).select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("choice", "kept")
    )
    counted = keyed.groupBy("choice", "kept").agg(F.count("*").alias("n")).where("n > 1")
    posted = keyed.join(counted, ["choice", "kept"])

    met = posted.where(F.col("n") <= small).groupBy("choice", "kept").agg(F.collect_list("fp").alias("fps"))
    pairs = F.flatten(
        F.transform(
            "fps",
            lambda a: F.transform(
                F.filter("fps", lambda b: (a < b) & _near(a, b)), lambda b: F.struct(a.alias("a"), b.alias("b"))
            ),
        )
    )
    from_small = met.select(F.explode(pairs).alias("p")).select("p.a", "p.b")

    mask = F.element_at(F.array(*[F.lit(m).cast("long") for m in signed]), F.col("choice") + 1)
    free = F.filter(
        F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)]),
        lambda bit: bit.bitwiseAND(F.col("mask")) == 0,
    )
    variants = (
        posted.where(F.col("n") > small)
        .withColumn("mask", mask)
        .select("choice", "fp", F.explode(F.concat(F.array("fp"), F.transform(free, lambda bit: F.col("fp").bitwiseXOR(bit)))).alias("variant"))
        .groupBy("choice", "variant")
        .agg(F.sort_array(F.collect_set("fp")).alias("fps"))
        .where(F.size("fps") > 1)
    )
    from_large = variants.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, 24)).alias("b"))
    return from_small.unionByName(from_large).distinct()


def components(nodes_links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node reachable.

    Each round takes the smallest root among the neighbours and then the root's own root
    (pointer jumping), so paths shorten by halves.  Rounds go through written tables, and the
    driver sees only the number of roots that changed.
    """
    both = materialize(
        nodes_links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            nodes_links.select(F.col("b").alias("u"), F.col("a").alias("v"))
        ),
        "links",
    )
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("root")), "roots")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("low"))
        hooked = labels.join(seen, "node").select("node", "root", F.least("root", "low").alias("next"))
        jumped = materialize(
            hooked.join(labels.select(F.col("node").alias("next"), F.col("root").alias("beyond")), "next", "left").select(
                "node", F.col("root").alias("before"), F.least("next", F.coalesce("beyond", "next")).alias("root")
            ),
            "roots",
        )
        changed = jumped.where("root <> before").limit(1).count()
        labels = jumped.select("node", "root")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id, simhash (bigint), component_id.

    component_id is the smallest doc_id reachable over links of at most two differing bits,
    the row's own included; rows with a null doc_id take part in linking, and a component that
    has only such rows gets a null.  Null and empty texts have fingerprint zero and are linked
    like any other.  Repeated rows stay, each with its component.  An empty table gives an
    empty result; columns other than the two named are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = materialize(with_fingerprint(rows).select("doc_id", "simhash"), "simhash")
    return prints.join(component_of(prints), "simhash", "left").select("doc_id", "simhash", "component_id")


def component_of(prints: DataFrame) -> DataFrame:
    """(simhash, root, component_id) for each distinct fingerprint of ``prints`` (doc_id, simhash)."""
    classes = materialize(prints.groupBy("simhash").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes))
    rooted = classes.join(roots.withColumnRenamed("node", "simhash"), "simhash", "left").select(
        "simhash", "least", F.coalesce("root", "simhash").alias("root")
    )
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return materialize(rooted.join(lowest, "root").select("simhash", "root", "component_id"), "members")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float | None = None) -> DataFrame:
    """``docs`` with one row for each component: that with the smallest doc_id (nulls last,
    then the first as written, where doc_ids repeat).

    Texts are linked by fingerprints of at most two differing bits and, if ``least`` is given, by
    a Jaccard similarity of their five-word shingles of that or more.  No link between different
    texts is left out: bands join most, prefixes find all that is similar between what they joined.
    """
    fp, row, keys = fresh(docs, "simhash"), fresh(docs, "row"), fresh(docs, "bands")
    added = with_fingerprint(docs, text, fp, None if least is None else keys)
    tagged = materialize(added.withColumn(row, F.monotonically_increasing_id()), "tagged")
    prints = tagged.select(F.col(doc_id).alias("doc_id"), F.col(fp).alias("simhash"), F.col(row).alias("row"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    if least is None:
        groups_ = prints.groupBy("simhash").agg(best).join(component_of(prints), "simhash")
    else:
        # Texts of equal fingerprints, bands and hence sets are one node, that of their best row.
        every = tagged.select(F.col(doc_id).alias("doc_id"), F.col(fp).alias("simhash"), F.col(row).alias("row"), F.col(keys).alias("bands"))
        nodes = materialize(every.groupBy("simhash", "bands").agg(best).withColumn("node", F.col("best.row")), "nodes")
        texts = tagged.select(F.col(row).alias("node"), F.col(text).alias("text"))
        first = materialize(nodes.groupBy("simhash").agg(F.min("node").alias("first")), "firsts")
        print_links = links(first)
        side = lambda c: first.select(F.col("simhash").alias(f"fp_{c}"), F.col("first").alias(c))
        by_print = print_links.toDF("fp_a", "fp_b").join(side("a"), "fp_a").join(side("b"), "fp_b").select("a", "b")
        equal = nodes.join(first, "simhash").where("first <> node").select(F.col("first").alias("a"), F.col("node").alias("b"))
        linked = by_print.unionByName(equal).unionByName(shingles.similar(nodes.select("node", "bands"), texts, least))
        joined = materialize(nodes.select("node", "best").join(components(linked), "node", "left").withColumn("root", F.coalesce("root", "node")), "joined")
        beyond = components(prefixes.links(joined.select("node", "root"), texts, least)).toDF("root", "beyond")
        groups_ = joined.join(beyond, "root", "left").select("best", F.coalesce("beyond", "root").alias("root"))
    kept = materialize(groups_.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias(row)), "kept")
    return tagged.join(lean(kept, 16), row, "left_semi").select(*docs.columns)


def fingerprint_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", fingerprint_hex(F.col("simhash")).alias("fingerprint"), "component_id")
