"""Trees of the operating system, and streams of files."""

import os

import pyarrow as pa
from pyspark.sql import functions as F

from quern.sources import files
from quern.sources.files import scan_tree
from quern.sources.image import read_catalogue, read_table
from quern.sources.image_writer import extract, write_image
from quern.streaming.first_seen import append_new, first_seen


def test_tree_to_image(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "dir" / "deep").mkdir(parents=True)
    (root / "dir" / "a.txt").write_bytes(b"content" * 1000)
    (root / "same").write_bytes(b"content" * 1000)
    (root / "empty").touch()
    os.symlink("../elsewhere", root / "link")
    os.link(root / "same", root / "same2")
    os.mkfifo(root / "pipe")
    found = {r["name"]: r for r in scan_tree(spark, str(root)).collect()}
    assert {n: r["kind"] for n, r in found.items()} == {"": "dir", "dir": "dir", "deep": "dir", "a.txt": "file", "empty": "file", "link": "symlink", "pipe": "fifo", "same": "file", "same2": "hardlink"}
    assert found["link"]["target"] == "../elsewhere" and found["same2"]["link_to"] == found["same"]["seq"]
    path = str(tmp_path / "tree.img")
    write_image(scan_tree(spark, str(root)), path, block_size=1 << 13)
    c = read_catalogue(spark, path)
    contents = sorted(bytes(r["content"]) for r in extract(c, read_table(spark, path, "blocks")).collect())
    assert contents == [b"", b"content" * 1000, b"content" * 1000]
    assert read_table(spark, path, "blocks").agg(F.sum(F.length("data"))).first()[0] < 14000


def test_large_directory_in_parts(spark, tmp_path):
    """Of a directory's entries a task holds some at a time; all are listed and read."""
    for i in range(600):
        (tmp_path / f"{i}").write_bytes(b"%d" % i)
    folders = pa.RecordBatch.from_arrays([pa.array([os.fsencode(tmp_path)], pa.binary())], ["path"])
    sizes = [len(b) for b in files._list(iter([folders]))]
    assert sum(sizes) == 600 and max(sizes) <= 256
    rows = scan_tree(spark, str(tmp_path)).where("kind = 'file'").collect()
    assert sorted((r["name"], bytes(r["content"])) for r in rows) == sorted((f"{i}", b"%d" % i) for i in range(600))


def test_stream_keeps_first(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    kind = "id long, text string, at timestamp"
    for k, texts in enumerate((["a", "b", "a"], ["b", "c"])):
        spark.createDataFrame([(10 * k + i, t) for i, t in enumerate(texts)], "id long, text string").withColumn("at", F.timestamp_seconds(F.lit(1000 + k))).write.mode("append").parquet(str(source))
        append_new(spark.readStream.schema(kind).parquet(str(source)), out, str(tmp_path / "state")).awaitTermination()
    assert sorted(r["text"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
    bounded = first_seen(spark.readStream.schema(kind).parquet(str(source)), event_time="at", delay="10 minutes")
    q = bounded.writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == 3
