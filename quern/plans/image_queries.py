"""Queries of contents, hierarchies, checks and whole images, over the virtual image of the
documents table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.codec import cdc, fsst, section
from quern.functions import columns as C
from quern.operators import build, chunks, scans, tree, validate
from quern.plans import virtual
from quern.plans.registry import query, table
from quern.scratch import materialize, new_path
from quern.sources.image import read_catalogue, read_table
from quern.sources.image_writer import extract, write_image

BLOCK = 64 << 10
#: The catalogue of a few million documents is larger than an image's usual limit.
ROOM = {"metadata_size_limit": 1 << 30}
_BYTES = "octet_length(encode(text))"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


# Contents: sizes, deduplication, slicing, reassembly.


@query("a01_file_size_by_dir", f"SELECT lang, source, count(*) AS n_files, sum({_BYTES})::BIGINT AS bytes, sum(ceil({_BYTES} / 4096.0))::BIGINT AS n_chunks FROM documents GROUP BY ALL")
def a01(spark: SparkSession, d: str) -> DataFrame:
    """A1, A3: files, bytes and fixed chunks of each directory."""
    size = F.octet_length("text").cast("long")
    return _docs(spark, d).groupBy("lang", "source").agg(F.count("*").alias("n_files"), F.sum(size).alias("bytes"), F.sum(F.ceil(size / 4096)).cast("long").alias("n_chunks"))


@query("a02_remaining_bytes", f"SELECT doc_id, greatest(0, {_BYTES} - 1000)::BIGINT AS remaining FROM documents")
def a02(spark: SparkSession, d: str) -> DataFrame:
    """A2: bytes left after a reader's position, over a file's chunks; a file without text has one
    empty chunk."""
    file = F.struct("doc_id", F.monotonically_increasing_id().alias("row"))
    sized = _docs(spark, d).select(file.alias("file"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n"))
    count = F.greatest(F.lit(1), F.expr("(n + 699) div 700"))
    parts = C.explode_range(sized, F.lit(0).cast("long"), count, "k").select("file", (F.col("k") * 700).alias("start"), F.least(F.lit(700), F.col("n") - F.col("k") * 700).alias("size"))
    return chunks.remaining(parts, "file", F.lit(1000)).select("file.doc_id", "remaining")


_FIRST = "row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1"


@query(
    "a06_dedup_saved_bytes",
    f"SELECT source, count(*) AS n_files, sum(n)::BIGINT AS bytes, coalesce(sum(n) FILTER (is_first), 0)::BIGINT AS unique_bytes, coalesce(sum(n) FILTER (NOT is_first), 0)::BIGINT AS saved_bytes FROM (SELECT source, {_BYTES} AS n, {_FIRST} AS is_first FROM documents) GROUP BY 1",
)
def a06(spark: SparkSession, d: str) -> DataFrame:
    """What content addressing saves for each source."""
    rows = _docs(spark, d).select("doc_id", "source", F.octet_length("text").cast("long").alias("n"), F.sha2("text", 256).alias("digest"))
    seen = chunks.first_seen(rows, "digest", ["doc_id"])
    total = F.sum("n")
    return seen.groupBy("source").agg(F.count("*").alias("n_files"), total.alias("bytes"), (total - chunks.saved(seen, F.col("n"))).alias("unique_bytes"), chunks.saved(seen, F.col("n")).alias("saved_bytes"))


@query("x04_first_occurrence", f"SELECT doc_id, sha256(text) AS digest, {_FIRST} AS is_first FROM documents")
def x04(spark: SparkSession, d: str) -> DataFrame:
    """Which file stores each content."""
    return chunks.first_seen(_docs(spark, d).select("doc_id", F.sha2("text", 256).alias("digest")), "digest", ["doc_id"]).select("doc_id", "digest", "is_first")


_SLICES = f"""WITH r AS (SELECT doc_id, sum(n) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS stop, n FROM (SELECT doc_id, {_BYTES} AS n FROM documents)),
    s AS (SELECT doc_id, stop - n AS start, stop, unnest(range((stop - n) // {BLOCK}, (stop - 1) // {BLOCK} + 1)) AS block FROM r WHERE n > 0),
    x AS (SELECT doc_id, block::BIGINT AS block, (greatest(start, block * {BLOCK}) - block * {BLOCK})::BIGINT AS block_offset, (least(stop, (block + 1) * {BLOCK}) - greatest(start, block * {BLOCK}))::BIGINT AS size FROM s)"""


@query("x02_block_slice", f"{_SLICES} SELECT * FROM x")
def x02(spark: SparkSession, d: str) -> DataFrame:
    """Files laid end to end and cut at blocks."""
    return chunks.block_slices(_docs(spark, d).withColumn("n", F.octet_length("text")), "doc_id", "n", BLOCK).withColumnRenamed("offset", "block_offset")


@query("x01_block_occupancy", f"{_SLICES} SELECT block, count(*) AS n_files, sum(size)::BIGINT AS bytes FROM x GROUP BY 1")
def x01(spark: SparkSession, d: str) -> DataFrame:
    return x02(spark, d).groupBy("block").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


@query("x08_reassemble", "SELECT doc_id, sha256(text) AS digest FROM documents WHERE text <> ''")
def x08(spark: SparkSession, d: str) -> DataFrame:
    """Contents joined again from their pieces."""
    pieces = chunks.fixed_pieces(_docs(spark, d).select("doc_id", "text"), "doc_id", "text", 997)
    return chunks.reassemble(pieces, "doc_id").select("doc_id", F.sha2("content", 256).alias("digest"))


@query("x09_block_reads", f"{_SLICES} SELECT block, count(*) AS reads, min(doc_id) AS first_file, max(doc_id) AS last_file FROM x GROUP BY 1")
def x09(spark: SparkSession, d: str) -> DataFrame:
    """What each block is read for, once."""
    return x02(spark, d).groupBy("block").agg(F.count("*").alias("reads"), F.min("doc_id").alias("first_file"), F.max("doc_id").alias("last_file"))


@query("o02_locality_sort", f"{_SLICES} SELECT doc_id, first, row_number() OVER (ORDER BY first, doc_id) - 1 AS place FROM (SELECT doc_id, min(block) AS first FROM x GROUP BY 1)")
def o02(spark: SparkSession, d: str) -> DataFrame:
    """O2: files by the first section they read."""
    return scans.ranked(x02(spark, d).groupBy("doc_id").agg(F.min("block").alias("first")), ["first", "doc_id"], "place")


@query("a08_length_histogram", "SELECT least(length(p_name), 8)::BIGINT AS length, count(*) AS n FROM part GROUP BY 1")
def a08(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.least(F.length("p_name"), F.lit(8)).cast("long").alias("length")).agg(F.count("*").alias("n"))


# Hierarchies.

_TREE = """WITH lg AS (SELECT lang, row_number() OVER (ORDER BY lang) AS lang_seq FROM (SELECT DISTINCT lang FROM documents)),
    so AS (SELECT lang, source, row_number() OVER (ORDER BY lang, source) - 1 + 1000000 AS source_seq FROM (SELECT DISTINCT lang, source FROM documents)),
    t AS (SELECT 0 AS seq, NULL::BIGINT AS parent_seq, '' AS path, 'dir' AS kind, 0 AS depth UNION ALL SELECT lang_seq, 0, lang, 'dir', 1 FROM lg
      UNION ALL SELECT source_seq, lang_seq, lang || '/' || source, 'dir', 2 FROM so JOIN lg USING (lang)
      UNION ALL SELECT doc_id + 1000000000, source_seq, lang || '/' || source || '/' || doc_id || '.txt', 'file', 3 FROM documents JOIN so USING (lang, source))"""


def _tree(spark: SparkSession, d: str) -> DataFrame:
    rows = virtual.entries(_docs(spark, d)).select(F.col("seq").alias("node"), F.col("parent_seq").alias("parent"), "name", "kind", "mode", "uid", "gid")
    return tree.paths(materialize(rows, "tree"))


@query("b01_tree_paths", f"{_TREE} SELECT seq::BIGINT AS node, path, kind, depth::BIGINT AS depth FROM t")
def b01(spark: SparkSession, d: str) -> DataFrame:
    """All entries with their paths."""
    return _tree(spark, d).select("node", "path", "kind", "depth")


@query("j09_path_resolve", "SELECT DISTINCT array_to_string(parts[4:k::INT], '/') AS path FROM (SELECT parts, unnest(range(4, len(parts) + 1)) AS k FROM (SELECT string_split(url, '/') AS parts FROM pages)) WHERE array_to_string(parts[4:k::INT], '/') <> ''")
def j09(spark: SparkSession, d: str) -> DataFrame:
    """Every directory on the way of each page's path."""
    parts = F.split("url", "/")
    path = F.array_join(F.slice(parts, 4, F.size(parts)), "/")
    return table(spark, d, "pages").where(F.size(parts) > 3).select(F.explode(tree.prefixes(path)).alias("path")).where("path <> ''").distinct()


@query("j09_path_lookup", f"{_TREE} SELECT path, seq::BIGINT AS node FROM t WHERE path IN ('', 'en', 'de/src3', 'en/src1/no.txt') OR path LIKE '%/1_.txt'")
def j09_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Paths looked up by one equi-join; a path that isn't there gives no row."""
    listed = _tree(spark, d)
    wanted = spark.createDataFrame([("",), ("en",), ("de/src3",), ("en/src1/no.txt",)], "path string")
    also = listed.where(F.col("path").rlike(r"/1\d\.txt$")).select("path")
    return tree.lookup(listed, wanted.unionByName(also).distinct()).select("path", "node")


@query("j10_name_lookup", f"{_TREE} SELECT path, seq::BIGINT AS node FROM t WHERE parent_seq = 0 AND path = 'en'")
def j10(spark: SparkSession, d: str) -> DataFrame:
    return tree.children(_tree(spark, d), 0, "en").select("path", "node")


@query("a03_entries_per_dir", f"{_TREE} SELECT a.path, count(b.seq) AS n FROM t a LEFT JOIN t b ON b.parent_seq = a.seq WHERE a.kind = 'dir' GROUP BY a.path")
def a03(spark: SparkSession, d: str) -> DataFrame:
    listed = _tree(spark, d)
    counts = listed.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n"))
    return listed.where("kind = 'dir'").join(counts, "node", "left").fillna(0, ["n"]).select("path", "n")


@query("o07_path_sort", f"{_TREE} SELECT path, row_number() OVER (ORDER BY path) - 1 AS place FROM t")
def o07(spark: SparkSession, d: str) -> DataFrame:
    return scans.ranked(_tree(spark, d).select("path"), ["path"], "place")


@query("o06_mtree_order", f"{_TREE} SELECT path, row_number() OVER (ORDER BY CASE depth WHEN 0 THEN '' WHEN 1 THEN '1' || path ELSE '1' || split_part(path, '/', 1) END, CASE WHEN depth < 2 THEN '' ELSE '1' || split_part(path, '/', 2) END, CASE WHEN depth < 3 THEN '' ELSE '0' || split_part(path, '/', 3) END) - 1 AS place FROM t WHERE depth > 0")
def o06(spark: SparkSession, d: str) -> DataFrame:
    """Files before directories, each directory before its subtree."""
    listed = _tree(spark, d).where("depth > 0").select("path", tree.mtree_key(F.col("path"), F.col("kind") == "dir").alias("key"))
    return scans.ranked(listed, ["key"], "place").select("path", "place")


@query(
    "k09_mtree_dump",
    f"""{_TREE} SELECT './' || path || ' type=' || kind || ' mode=' || CASE kind WHEN 'dir' THEN '0755' ELSE '0644' END || ' uid=' || (seq % 7) || ' gid=' || (seq % 3)
      || CASE WHEN kind = 'file' THEN ' size=' || (SELECT {_BYTES} FROM documents WHERE doc_id = seq - 1000000000) ELSE '' END AS line FROM t WHERE depth > 0""",
)
def k09(spark: SparkSession, d: str) -> DataFrame:
    """K9: the listing as mtree lines."""
    sizes = _docs(spark, d).select((F.col("doc_id") + virtual.FILES_FROM).alias("node"), F.octet_length("text").alias("size"))
    listed = _tree(spark, d).join(sizes, "node", "left").withColumns({"permissions": F.col("mode"), "target": F.lit(None).cast("string"), "device_id": F.lit(None).cast("string")})
    return tree.mtree_lines(listed).select("line")


@query("u05_listing_diff", "SELECT p_name, -1 AS side FROM (SELECT p_name FROM part WHERE p_partkey % 3 <> 0 EXCEPT ALL SELECT p_name FROM part WHERE p_partkey % 2 = 0) UNION ALL SELECT p_name, 1 FROM (SELECT p_name FROM part WHERE p_partkey % 2 = 0 EXCEPT ALL SELECT p_name FROM part WHERE p_partkey % 3 <> 0)")
def u05(spark: SparkSession, d: str) -> DataFrame:
    """What each of two listings has that the other has not."""
    a, b = (table(spark, d, "part").where(f"p_partkey % {m}").select("p_name") for m in ("3 <> 0", "2 = 0"))
    return a.exceptAll(b).withColumn("side", F.lit(-1)).unionByName(b.exceptAll(a).withColumn("side", F.lit(1)))


# Range joins and checks.


@query("j04_dir_range_join", "SELECT o_custkey, o_orderkey FROM orders")
def j04(spark: SparkSession, d: str) -> DataFrame:
    """Entries of each directory by half-open ranges, planned as an equi-join."""
    placed = scans.ranked(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], "entry_idx")
    sizes = placed.groupBy("o_custkey").agg(F.min("entry_idx").alias("first_entry"), F.count("*").alias("n"))
    dirs = scans.positions(sizes, "o_custkey", "inode_num")
    sentinel = dirs.agg(F.count("*").alias("inode_num"), F.coalesce(F.sum("n"), F.lit(0)).alias("first_entry"))
    directories = dirs.select("inode_num", "first_entry").unionByName(sentinel)
    found = tree.directory_entries(directories, placed.select("entry_idx", "o_orderkey"))
    return found.join(dirs.select(F.col("inode_num").alias("dir_inode"), "o_custkey"), "dir_inode").select("o_custkey", "o_orderkey")


@query("j05_file_chunks", f"SELECT doc_id, k::BIGINT AS nth, least(4096, n - k * 4096)::BIGINT AS size FROM (SELECT doc_id, n, unnest(range(0, (n + 4095) // 4096)) AS k FROM (SELECT doc_id, {_BYTES} AS n FROM documents))")
def j05(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each file through the chunk table."""
    files = scans.positions(_docs(spark, d).select("doc_id", F.octet_length("text").cast("long").alias("bytes")), "doc_id", "file_idx")
    counted = scans.prefix_sum(files.withColumn("n", F.expr("(bytes + 4095) div 4096")), "file_idx", F.col("n"), "end").withColumn("first_chunk", F.col("end") - F.col("n"))
    sentinel = counted.agg(F.count("*").alias("file_idx"), F.max("end").alias("first_chunk"))
    every = C.explode_range(counted, F.lit(0).cast("long"), F.col("n"), "nth").select((F.col("first_chunk") + F.col("nth")).alias("chunk_idx"), "nth", F.least(F.lit(4096), F.col("bytes") - F.col("nth") * 4096).cast("long").alias("size"))
    found = tree.file_chunks(counted.select("file_idx", "first_chunk").unionByName(sentinel), every)
    return found.join(counted.select("file_idx", "doc_id"), "file_idx").select("doc_id", "nth", "size")


@query("j06_shared_slots", "SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS slot FROM documents")
def j06(spark: SparkSession, d: str) -> DataFrame:
    """Files of one content share a slot."""
    rows = _docs(spark, d).select("doc_id", F.sha2("text", 256).alias("digest"))
    return rows.join(rows.groupBy("digest").agg(F.min("doc_id").alias("slot")), "digest").select("doc_id", "slot")


@query("f06_fk_violations", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem ANTI JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_custkey % 7 <> 0) USING (l_orderkey)")
def f06(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose parent is missing."""
    parents = table(spark, d, "orders").where("o_custkey % 7 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return validate.orphans(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), parents, ["l_orderkey"])


@query("f04_unique_section", "SELECT o_orderstatus AS section_type, CASE count(*) WHEN 1 THEN 'ok' ELSE 'duplicate' END AS state FROM orders GROUP BY 1 UNION ALL SELECT 'none', 'missing'")
def f04(spark: SparkSession, d: str) -> DataFrame:
    """sections that must be there once."""
    wanted = table(spark, d, "orders").select(F.col("o_orderstatus").alias("section_type")).distinct().unionByName(spark.createDataFrame([("none",)], "section_type string"))
    counts = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("section_type")).agg(F.count("*").alias("n"))
    state = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").otherwise("ok")
    return wanted.join(counts, "section_type", "left").select("section_type", state.alias("state"))


@query("f14_duplicate_names", "SELECT split_part(url, '/', 3) AS parent, split_part(url, '/', 4) AS name, count(*) AS n FROM pages GROUP BY ALL HAVING count(*) > 1")
def f14(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("parent"), F.split_part("url", F.lit("/"), F.lit(4)).alias("name"))
    return validate.duplicate_names(rows, "parent", "name")


@query("f15_chunk_bounds", f"{_SLICES} SELECT doc_id, block FROM x WHERE block_offset + size > {BLOCK // 2}")
def f15(spark: SparkSession, d: str) -> DataFrame:
    """chunks that a block of half the size could not hold."""
    return x02(spark, d).where(F.col("block_offset") + F.col("size") > BLOCK // 2).select("doc_id", "block")


@query(
    "f16_limits",
    "SELECT 'entries' AS what, count(*) >= 4294967296 AS broken FROM orders UNION ALL SELECT 'bytes', sum(o_orderkey) >= 281474976710656 FROM orders UNION ALL SELECT 'epoch', min(epoch(o_orderdate)) < 0 FROM orders",
)
def f16(spark: SparkSession, d: str) -> DataFrame:
    """F16: limits on counts, bytes and times."""
    one = table(spark, d, "orders").agg(
        (F.count("*") >= 1 << 32).alias("entries"), (F.sum("o_orderkey") >= 1 << 48).alias("bytes"), (F.min(F.unix_timestamp("o_orderdate")) < 0).alias("epoch")
    )
    return one.unpivot([], ["entries", "bytes", "epoch"], "what", "broken")


# The builder's catalogue.


def _catalogue(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return build.catalogue(materialize(virtual.entries(_docs(spark, d)), "entries"), materialize(virtual.chunks(_docs(spark, d), BLOCK), "chunks"), BLOCK)


@query("b08_catalogue_counts", f"{_TREE}, {_SLICES[5:]} SELECT 'inodes' AS name, count(*) AS n FROM t UNION ALL SELECT 'dir_entries', count(*) FROM t UNION ALL SELECT 'directories', count(*) + 1 FROM t WHERE kind = 'dir' UNION ALL SELECT 'chunk_table', count(*) + 1 FROM documents UNION ALL SELECT 'chunks', count(*) FROM x UNION ALL SELECT 'violations', 0")
def b08(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the tables that the builder makes; none of its rows breaks a rule."""
    c = _catalogue(spark, d)
    c["sections"] = c["chunks"].select("section_idx").distinct()
    counts = [c[n].agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("inodes", "dir_entries", "directories", "chunk_table", "chunks")]
    counts.append(validate.violations(c).agg(F.lit("violations").alias("name"), F.count("*").alias("n")))
    out = counts[0]
    for x in counts[1:]:
        out = out.unionByName(x)
    return out


@query("b08_directory_entries", f"{_TREE} SELECT a.seq::BIGINT AS dir, b.seq::BIGINT AS child FROM t a JOIN t b ON b.parent_seq = a.seq")
def b08_entries(spark: SparkSession, d: str) -> DataFrame:
    """What each directory lists, read back from the catalogue by position."""
    c = _catalogue(spark, d)
    names = c["names"].select(F.col("pos").alias("name_index"), F.col("value").alias("name"))
    listed = tree.directory_entries(c["directories"], c["dir_entries"]).join(names, "name_index")
    own = c["directories"].select(F.col("inode_num").alias("dir_inode"), "self_entry", "parent_entry")
    by_entry = c["dir_entries"].select(F.col("entry_idx").alias("self_entry"), F.col("inode_num").alias("again"))
    checked = listed.join(own, "dir_inode").join(by_entry, "self_entry").where("again = dir_inode")
    # Inode numbers keep the order of seq inside a kind, so both sides are named by rank.
    seqs = materialize(virtual.entries(_docs(spark, d)).select("seq", "kind"), "seqs")
    number = scans.renumber(seqs, F.when(F.col("kind") == "dir", 0).otherwise(1), "seq", "inode_num", 2).select("seq", "inode_num")
    parent = number.select(F.col("inode_num").alias("dir_inode"), F.col("seq").alias("dir"))
    return checked.join(parent, "dir_inode").join(number, "inode_num").select("dir", F.col("seq").alias("child"))


@query("p07_entry_names", f"{_TREE} SELECT string_split(path, '/')[-1] AS name, count(*) AS n FROM t WHERE depth > 0 GROUP BY 1")
def p07(spark: SparkSession, d: str) -> DataFrame:
    """Names of all entries through the dictionary."""
    c = _catalogue(spark, d)
    return c["dir_entries"].where("entry_idx > 0").join(c["names"].withColumnRenamed("pos", "name_index"), "name_index").groupBy(F.col("value").alias("name")).agg(F.count("*").alias("n"))


@query("p15_inode_view", f"{_TREE} SELECT seq::BIGINT AS seq, CASE kind WHEN 'dir' THEN 'drwxr-xr-x' ELSE '-rw-r--r--' END AS mode, (seq % 7)::BIGINT AS uid, (seq % 3)::BIGINT AS gid, (seq % 1000 * 60)::BIGINT AS mtime FROM t")
def p15(spark: SparkSession, d: str) -> DataFrame:
    """A row for each inode with all its dictionaries resolved."""
    c = _catalogue(spark, d)
    code = lambda t, k, v: c[t].select(F.col("pos").alias(k), F.col("value").alias(v))
    view = c["inodes"].join(code("modes", "mode_index", "m"), "mode_index").join(code("uids", "owner_index", "uid"), "owner_index").join(code("gids", "group_index", "gid"), "group_index")
    o = F.broadcast(c["options"])
    timed = view.crossJoin(o).withColumn("mtime", C.entry_time(F.col("mtime_offset"), F.col("timestamp_base"), F.col("time_resolution_sec"), F.col("scaled")))
    seqs = materialize(virtual.entries(_docs(spark, d)).select("seq", "kind"), "seqs")
    number = scans.renumber(seqs, F.when(F.col("kind") == "dir", 0).otherwise(1), "seq", "inode_num", 2).select("seq", "inode_num")
    return timed.join(number, "inode_num").select("seq", C.mode_string(F.col("m")).alias("mode"), "uid", "gid", "mtime")


# Codecs and whole images: what goes in comes out.


@query("c02_fsst_roundtrip", "SELECT p_partkey, sha256(p_name) AS digest FROM part")
def c02(spark: SparkSession, d: str) -> DataFrame:
    """All names through a symbol table that was itself written and parsed; the table is
    trained on the first 200 of them."""
    samples = [r["p_name"].encode() for r in table(spark, d, "part").orderBy("p_partkey").select("p_name").limit(200).collect()]
    symbols = fsst.parse(fsst.to_bytes(fsst.train(samples)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            back = [fsst.decode(symbols, fsst.encode(symbols, n.encode())) for n in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.sha256(b).hexdigest() for b in back])], ["p_partkey", "digest"])

    return table(spark, d, "part").select("p_partkey", "p_name").mapInArrow(run, "p_partkey long, digest string")


@query("c15_codec_roundtrip", "SELECT doc_id, algo, sha256(text) AS digest FROM documents, (SELECT unnest([0, 1, 2, 3]) AS algo)")
def c15(spark: SparkSession, d: str) -> DataFrame:
    """Each text sealed by each algorithm, verified and read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for algo in (section.NONE, section.LZMA, section.ZSTD, section.LZ4):
                    sealed = section.seal(0, section.BLOCK, text.encode(), algo, 1 if algo == section.LZMA else None)
                    _, back = section.read_section(lambda o, n, s=sealed: s[o : o + n], 0, len(text.encode()) + 1, "slow")
                    rows.append((doc_id, algo, hashlib.sha256(back).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.string()), strict=True)], ["doc_id", "algo", "digest"])

    return _docs(spark, d).select("doc_id", "text").mapInArrow(run, "doc_id long, algo int, digest string")


@query("x03_cdc_chunks", f"SELECT doc_id, {_BYTES}::BIGINT AS bytes, sha256(text) AS digest, true AS in_bounds FROM documents WHERE text <> ''")
def x03(spark: SparkSession, d: str) -> DataFrame:
    """Content-defined chunks, joined again, and their bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, parts in zip(batch.column(0).to_pylist(), cdc.chunked([t.encode() for t in batch.column(1).to_pylist()]), strict=True):
                sizes = [len(p) for p in parts]
                bounded = all(cdc.MIN_CHUNK - 1 <= n < cdc.MAX_CHUNK for n in sizes[:-1]) and 0 < sizes[-1] <= cdc.MAX_CHUNK
                rows.append((doc_id, sum(sizes), hashlib.sha256(b"".join(parts)).hexdigest(), bounded))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["doc_id", "bytes", "digest", "in_bounds"])

    return _docs(spark, d).where("text <> ''").select("doc_id", "text").mapInArrow(run, "doc_id long, bytes long, digest string, in_bounds boolean")


def _image(spark: SparkSession, d: str) -> tuple[str, dict[str, DataFrame]]:
    path = new_path(spark, "image") + ".img"
    nodes = materialize(virtual.entries(_docs(spark, d), content=True), "entries")
    return path, write_image(nodes, path, 256 << 10, metadata_limit=ROOM["metadata_size_limit"])


@query("s01_image_roundtrip", "SELECT doc_id, sha256(text) AS digest FROM documents")
def s01(spark: SparkSession, d: str) -> DataFrame:
    """Documents written to an image with content-defined chunks, and every
    file read back through the data source."""
    path, _ = _image(spark, d)
    content = extract(read_catalogue(spark, path, **ROOM), read_table(spark, path, "blocks", **ROOM))
    slots = scans.positions(_docs(spark, d).select("doc_id"), "doc_id", "file_idx")  # inode order is that of the ids
    return slots.join(content, "file_idx").select("doc_id", F.sha2("content", 256).alias("digest"))


@query("a09_file_checksums", "SELECT doc_id, octet_length(encode(text))::BIGINT AS size, md5(text) AS digest FROM documents")
def a09(spark: SparkSession, d: str) -> DataFrame:
    """A checksum of each file over its ordered chunks."""
    pieces = chunks.fixed_pieces(_docs(spark, d).select("doc_id", "text"), "doc_id", "text", 1000)
    whole = _docs(spark, d).select("doc_id").join(chunks.reassemble(pieces, "doc_id"), "doc_id", "left")
    content = F.coalesce("content", F.lit(""))
    return whole.select("doc_id", F.octet_length(content).cast("long").alias("size"), F.md5(content).alias("digest"))
