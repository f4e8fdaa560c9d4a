"""Operators on small trees: what is built, refused, written and read back."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quern.codec import section
from quern.functions import columns as C
from quern.model import ENTRIES, ImageError
from quern.operators import build, chunks, scans, tree, validate
from quern.sources import image_writer
from quern.sources.image import read_catalogue, read_table
from quern.sources.image_writer import extract, write_image


def entry(seq, parent, name, kind, **more):
    row = dict(seq=seq, parent_seq=parent, name=name, kind=kind, link_to=None, mode=0o755, uid=0, gid=0, mtime=42, atime=666, ctime=7, target=None, device_id=None, content=None)
    return tuple((row | more)[f] for f in ENTRIES.names)


def frame(spark, rows):
    return spark.createDataFrame(rows, ENTRIES)


SMOKE = [
    entry(0, None, "", "dir"), entry(1, 0, "0dir", "dir"), entry(2, 0, "1file", "file", content=b"bar", mode=0o644), entry(3, 0, "2symlink", "symlink", target="../x"),
    entry(4, 0, "3blkdev", "blkdev", device_id=Decimal(0x0123456789ABCDEF)), entry(5, 0, "4chardev", "chardev", device_id=Decimal(0xFEDCBA9876543210)), entry(6, 0, "5fifo", "fifo"),
    entry(7, 0, "6socket", "socket"), entry(8, 0, "7hardlink", "hardlink", link_to=2), entry(9, 1, "empty", "file", content=b""), entry(10, 1, "long", "file", content=bytes(range(256)) * 30),
]


@pytest.mark.parametrize("chunker", ["basic", "cdc"])
def test_image_of_all_kinds(spark, tmp_path, chunker):
    path = str(tmp_path / "smoke.img")
    write_image(frame(spark, SMOKE), path, block_size=1 << 12, chunker=chunker, source_date_epoch=100)
    c = read_catalogue(spark, path, verify="slow")
    kinds = [r["kind"] for r in c["inodes"].orderBy("inode_num").collect()]
    assert kinds == ["dir", "dir", "symlink", "file", "file", "file", "device", "device", "ipc", "ipc"]
    assert build.tally(c) == {"symlink": 2, "file": 3, "shared": 6, "device": 6, "ipc": 8}
    assert validate.violations(c).count() == 0
    names = c["names"].withColumnRenamed("pos", "name_index")
    listed = tree.directory_entries(c["directories"], c["dir_entries"]).join(names, "name_index").where("dir_inode = 0").orderBy("entry_idx").collect()
    assert [r["value"] for r in listed] == ["0dir", "1file", "2symlink", "3blkdev", "4chardev", "5fifo", "6socket", "7hardlink"]
    by_name = {r["value"]: r["inode_num"] for r in listed}
    assert by_name["7hardlink"] == by_name["1file"]
    assert [int(r[0]) for r in c["devices"].orderBy("pos").select("device_id").collect()] == [0x0123456789ABCDEF, 0xFEDCBA9876543210]
    assert [r["value"] for r in c["symlinks"].collect()] == ["../x"]
    assert {r["mtime_offset"] for r in c["inodes"].collect()} == {42} and {r["atime_offset"] for r in c["inodes"].collect()} == {100}
    found = {r["file_idx"]: bytes(r["content"]) for r in extract(c, read_table(spark, path, "blocks")).collect()}
    assert found == {0: b"bar", 1: b"", 2: bytes(range(256)) * 30}


def test_pushed_section_filter(spark, tmp_path):
    path = str(tmp_path / "two.img")
    rows = [entry(0, None, "", "dir"), entry(1, 0, "a", "file", content=b"a" * 5000 + bytes(range(256)))]
    write_image(frame(spark, rows), path, block_size=1 << 12, chunker="basic")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        blocks = read_table(spark, path, "blocks")
        assert blocks.rdd.getNumPartitions() == 2
        assert blocks.where("section_idx = 1").rdd.getNumPartitions() == 1
        assert len(blocks.where("section_idx = 1").first()["data"]) == 5256 - 4096
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_empty_tree(spark, tmp_path):
    path = str(tmp_path / "empty.img")
    write_image(frame(spark, [entry(0, None, "", "dir")]), path)
    c = read_catalogue(spark, path)
    assert c["inodes"].count() == 1 and c["directories"].count() == 2 and c["chunks"].count() == 0
    assert tree.directory_entries(c["directories"], c["dir_entries"]).count() == 0


@pytest.mark.parametrize(
    "rows,kind",
    [
        ([entry(1, 0, "a", "file"), entry(2, 0, "a", "dir")], "duplicate_name"),
        ([entry(1, 9, "a", "file")], "parent"),
        ([entry(1, 0, "a", "file", mtime=-1)], "time"),
        ([entry(1, 0, "a", "file", mode=0o4755)], "mode"),
        ([entry(1, 0, "d", "dir"), entry(2, 0, "l", "hardlink", link_to=1)], "hard_link"),
    ],
)
def test_refused_entries(spark, rows, kind):
    none = spark.createDataFrame([], "seq long, idx long, section_idx long, offset long, size long")
    with pytest.raises(ImageError) as e:
        build.check(frame(spark, [entry(0, None, "", "dir"), *rows]), none, 4096)
    assert e.value.kind == kind


def test_refused_chunk(spark):
    with pytest.raises(ImageError, match="exceeds its block"):
        build.check(frame(spark, [entry(0, None, "", "dir")]), spark.createDataFrame([(1, 0, 0, 4000, 100)], "seq long, idx long, section_idx long, offset long, size long"), 4096)


def test_violations_are_found(spark):
    none = spark.createDataFrame([], "seq long, idx long, section_idx long, offset long, size long")
    c = build.catalogue(frame(spark, [entry(0, None, "", "dir"), entry(1, 0, "a", "file")]), none, 4096)
    c["sections"] = spark.createDataFrame([(0, 0)], "section_idx long, section_type int")
    c["chunks"] = spark.createDataFrame([(0, 0, 4000, 200), (1, 5, 0, 1)], "chunk_idx long, section_idx long, offset long, size long")
    c["options"] = spark.createDataFrame([(True, 1, 2**32 - 40, 4097, True)], "mtime_only boolean, time_resolution_sec long, timestamp_base long, block_size long, scaled boolean")
    c["symlink_table"] = spark.createDataFrame([(0, 3)], "pos long, target_index long")
    rules = {r["rule"] for r in validate.violations(c).collect()}
    assert {"block_size_power_of_two", "chunk_section", "chunk_in_block", "mtime_overflow", "mtime_only", "symlink_target"} <= rules


def test_sections(spark):
    sections = spark.createDataFrame([(0, 0, 0), (1, 0, 50), (2, 7, 40)], "section_idx long, section_type int, offset long")
    assert validate.unique_section(sections, 7, "SCHEMA") == 2
    for kind, what in ((8, "missing"), (0, "duplicate")):
        with pytest.raises(ImageError, match=what):
            validate.unique_section(sections, kind, "X")
    assert [r["section_idx"] for r in validate.section_order(sections).collect()] == [2]


def test_empty_ranges_give_no_rows(spark):
    rows = spark.createDataFrame([(5, 5), (5, 4), (2, 4)], "a long, b long")
    assert sorted(r["k"] for r in C.explode_range(rows, F.col("a"), F.col("b"), "k").collect()) == [2, 3]
    files = spark.createDataFrame([(1, 0), (2, 5), (3, 0)], "id long, n long")
    assert [tuple(r) for r in chunks.block_slices(files, "id", "n", 4).orderBy("block").collect()] == [(2, 0, 0, 4), (2, 1, 0, 1)]
    assert {tuple(r) for r in chunks.file_sizes(files, spark.createDataFrame([(2, 5)], "id long, size long"), "id", "size").collect()} == {(1, 0, 0), (2, 5, 1), (3, 0, 0)}


def test_buckets_hold_as_many_rows(spark):
    """Keys that lie far apart are dealt evenly: no task has over twice the mean."""
    keys = spark.range(11).unionByName(spark.range(10**9, 10**9 + 40_000)).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in scans.bucketed(keys, "k", 16).groupBy("bucket").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) == 16 and max(sizes) < 2 * sum(sizes) / len(sizes)
    got = scans.prefix_sum(keys, "k", F.col("v"), "s").where("k = 10 or k = 1000000000 or k = 1000039999").orderBy("k").collect()
    assert [r["s"] for r in got] == [11, 12, 40_011]


@pytest.mark.parametrize("buckets", [1, 3, 1000])
def test_scans_over_buckets(spark, buckets):
    rows = spark.createDataFrame([(k * k, k % 5) for k in range(50)], "k long, v long")
    got = scans.prefix_sum(rows, "k", F.col("v"), "s", buckets=buckets).orderBy("k").collect()
    total = 0
    for r in got:
        total += r["v"]
        assert r["s"] == total
    lag = scans.previous(rows, "k", "v", "before", buckets=buckets).orderBy("k").collect()
    assert [r["before"] for r in lag] == [None, *(k % 5 for k in range(49))]


def test_scans_of_nothing(spark):
    none = spark.createDataFrame([], "k long, v long, t string")
    assert scans.prefix_sum(none, "k", F.col("v"), "s").count() == 0
    assert [tuple(r) for r in scans.offsets(none, "k", "t").collect()] == [(0, 0)]
    assert scans.is_sorted(none, "k", "v").first()[0] is True


def test_deep_and_lone_paths(spark):
    rows = [(0, None, "root")] + [(i, i - 1, f"d{i}") for i in range(1, 40)]
    listed = tree.paths(spark.createDataFrame(rows, "node long, parent long, name string"))
    last = listed.where("node = 39").first()
    assert last["path"] == "/".join(f"d{i}" for i in range(1, 40)) and last["depth"] == 39
    assert listed.where("node = 0").first()["path"] == ""


@pytest.mark.parametrize("seen", [True, False])
def test_blocks_written_by_tasks_or_streamed(spark, tmp_path, monkeypatch, seen):
    """The driver gets blocks only where no task sees the file; the image is the same."""
    streamed, path = [], str(tmp_path / "out.img")
    kept = image_writer.SectionFile.append
    monkeypatch.setattr(image_writer.SectionFile, "append", lambda self, kind, sealed: (streamed.append(kind), kept(self, kind, sealed)))
    if not seen:
        real = image_writer.place_blocks
        monkeypatch.setattr(image_writer, "place_blocks", lambda blocks, name, *rest: real(blocks, name + ".elsewhere", *rest))
    (tmp_path / "out.img").write_bytes(b"left of another image" * 10_000)
    rows = [entry(0, None, "", "dir"), *(entry(i, 0, f"f{i}", "file", content=bytes([i]) * (3000 * i)) for i in range(1, 9))]
    write_image(frame(spark, rows), path, block_size=1 << 12, chunker="basic", algo=section.NONE)
    assert streamed.count(section.BLOCK) == (0 if seen else 27)
    c, blocks = read_catalogue(spark, path, verify="slow"), read_table(spark, path, "blocks", verify="slow")
    assert blocks.count() == 27 and blocks.rdd.getNumPartitions() == 27
    assert sorted(bytes(r["content"]) for r in extract(c, blocks).collect()) == [bytes([i]) * (3000 * i) for i in range(1, 9)]


def test_many_blocks_share_parts(spark, tmp_path):
    path = str(tmp_path / "many.img")
    data = b"".join(i.to_bytes(4, "big") * 1024 for i in range(200)) + b"end"
    write_image(frame(spark, [entry(0, None, "", "dir"), entry(1, 0, "a", "file", content=data)]), path, block_size=1 << 12, chunker="basic", algo=section.NONE)
    blocks = read_table(spark, path, "blocks")
    assert blocks.rdd.getNumPartitions() == 67
    assert b"".join(bytes(r["data"]) for r in blocks.orderBy("section_idx").collect()) == data
    sections = read_table(spark, path, "sections").orderBy("section_idx").collect()
    assert [r["section_type"] for r in sections] == [0] * 201 + [7, 8, 9] and [r["section_idx"] for r in sections] == list(range(204))
