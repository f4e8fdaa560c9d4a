"""Every query that SQL can state gives the same rows in DuckDB."""

import hashlib

import duckdb
import numpy as np
import pytest
from oracle import compare, connect

from quern.codec import cdc
from quern.plans import image_queries, kind_queries, open_queries
from quern.plans.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.fixture(scope="module", autouse=True)
def built_once():
    """Images and catalogues that several queries read are built once for all of them."""
    kept, patch = {}, pytest.MonkeyPatch()

    def once(f):
        def get(*args, **config):
            key = (f.__module__, f.__name__, args[1:], tuple(config.items()))
            if key not in kept:
                kept[key] = f(*args, **config)
            found = kept[key]
            return dict(found) if isinstance(found, dict) else found

        return get

    for module, name in ((image_queries, "_catalogue"), (image_queries, "_image"), (image_queries, "_tree"), (kind_queries, "_catalogue"), (open_queries, "_plain"), (open_queries, "_written_tree")):
        made = once(getattr(module, name))
        patch.setattr(module, name, made)
        for other in (kind_queries, open_queries):
            if module is image_queries and getattr(other, name, None) is not None and (other, name) != (kind_queries, "_catalogue"):
                patch.setattr(other, name, made)
    yield
    patch.undo()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    compare(con, df, ORACLES[name])


def documents(spark, folder, texts, sources=("a",)):
    """A documents table of ``texts`` in ``folder``; a connection that sees it."""
    rows = [(i, t, "en", sources[i % len(sources)]) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    found = duckdb.connect()
    found.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    return found


def test_remaining_of_files_without_text(spark, tmp_path):
    found = documents(spark, tmp_path, ["", None, "x" * 1000, "x" * 1001, "ä" * 2000, ""])
    compare(found, QUERIES["a02_remaining_bytes"](spark, str(tmp_path)), ORACLES["a02_remaining_bytes"])


def test_block_cache_of_more_blocks_than_a_reader_keeps(spark, tmp_path, monkeypatch):
    """Blocks that files come back to, over several readers' groups, within small kept room."""
    monkeypatch.setattr(open_queries, "_GROUP", 2)
    rng = np.random.default_rng(5)
    kept = ["".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(1, 90_000, 20)]
    texts = [kept[i] for i in rng.integers(0, 20, 150)] + ["", ""]
    found = documents(spark, tmp_path, texts, ("a", "b", "c"))
    compare(found, QUERIES["x09_block_cache"](spark, str(tmp_path)), ORACLES["x09_block_cache"])


def bitwise_chunks(data):
    """Content-defined chunks, the fingerprint taken bit by bit from each whole window."""
    ends, start = [], 0
    for p in range(len(data)):
        if p - start + 1 == cdc.MAX_CHUNK:
            cut = True
        else:
            value = 0
            for byte in data[max(0, p - cdc.WINDOW + 1) : p + 1] if p - start + 1 >= cdc.MIN_CHUNK else b"":
                for bit in range(7, -1, -1):
                    value = value << 1 | byte >> bit & 1
                    if value >> (cdc.POLYNOMIAL.bit_length() - 1):
                        value ^= cdc.POLYNOMIAL
            cut = value & cdc.MASK == cdc.MASK
        if cut:
            ends.append((start, p - start))
            start = p
    return [*ends, (start, len(data) - start)]


def test_cdc_boundaries_by_brute_force(spark, tmp_path):
    rng = np.random.default_rng(9)
    texts = ["x" * 5000, "", "ab" * 40_000, *("".join(map(chr, rng.integers(32, 400, n))) for n in (50, 64, 3000, 9000))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["x03_cdc_boundaries"](spark, str(tmp_path)).collect()
    for i, t in enumerate(texts):
        mine = sorted((r["start"], r["size"], r["digest"]) for r in rows if r["doc_id"] == i)
        want = bitwise_chunks(t.encode()) if t else []
        assert mine == [(a, n, hashlib.new("sha512_256", t.encode()[a : a + n]).hexdigest()) for a, n in want]


def test_long_digests(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r["digest"] for r in QUERIES["a09_sha512_256"](spark, sf_dir).collect()}
    assert got == {d: hashlib.new("sha512_256", t.encode()).hexdigest() for d, t in texts.items()}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[0] == "source"
    assert set(entry.oracle_sql()) <= set(entry.queries())
