"""Entries from a directory tree of the operating system."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.model import ENTRIES, ImageError
from quern.operators import scans
from quern.scratch import materialize

_KINDS = ((stat.S_ISDIR, "dir"), (stat.S_ISREG, "file"), (stat.S_ISLNK, "symlink"), (stat.S_ISBLK, "blkdev"), (stat.S_ISCHR, "chardev"), (stat.S_ISFIFO, "fifo"), (stat.S_ISSOCK, "socket"))


def metadata(status: os.stat_result) -> dict[str, int]:
    """What an inode keeps of a file's status: permission bits, owner, whole seconds."""
    if min(status.st_mtime, status.st_atime, status.st_ctime) < 0:
        raise ImageError("time", "a time is before the epoch")
    return {"mode": status.st_mode & 0o777, "uid": status.st_uid, "gid": status.st_gid, "mtime": int(status.st_mtime), "atime": int(status.st_atime), "ctime": int(status.st_ctime)}


def kind_of(mode: int) -> str:
    return next(name for test, name in _KINDS if test(mode))


#: Rows that a task turns into Python values at a time.
_ROWS = 256


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, len(batch), _ROWS):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, _ROWS).columns), strict=True)


_LISTED = "path binary, parent binary, name string, kind string, shared string"


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the directories of ``path`` hold; ``shared`` names an inode that has several names.
    Names that aren't UTF-8 are repaired.  Of a large directory _ROWS entries are held at a time."""
    kinds = [pa.binary(), pa.binary(), *[pa.string()] * 3]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "parent", "name", "kind", "shared"])

    for (folder,) in _rows(batches):
        rows = []
        with os.scandir(folder) as listed:
            for entry in listed:
                status = entry.stat(follow_symlinks=False)
                kind = kind_of(status.st_mode)
                # The status that os.scandir gives has no link count on every system.
                links = os.lstat(entry.path).st_nlink if kind != "dir" else 1
                rows.append((entry.path, folder, entry.name.decode("utf-8", "replace"), kind, f"{status.st_dev}:{status.st_ino}" if links > 1 else None))
                if len(rows) == _ROWS:
                    yield batch_of(rows)
                    rows = []
        yield batch_of(rows)


def names(spark: SparkSession, root: str) -> DataFrame:
    """(seq, parent_seq, name, path, link_to) of the tree at ``root``, parents before children,
    then by path.  Directories are listed by tasks, one level of the tree after another."""
    top = os.fsencode(root)
    level = spark.createDataFrame([(top, None, "", "dir", None)], _LISTED)
    found = level.withColumn("depth", F.lit(0))
    depth = 0
    while level.limit(1).count():
        depth += 1
        listed = materialize(level.select("path").repartition("path").mapInArrow(_list, _LISTED), "listed")
        found = found.unionByName(listed.withColumn("depth", F.lit(depth)))
        level = listed.where("kind = 'dir'")
    numbered = materialize(scans.ranked(found, ["depth", "path"], "seq"), "names")
    above = numbered.select(F.col("path").alias("parent"), F.col("seq").alias("parent_seq"))
    first = numbered.where("shared is not null").groupBy("shared").agg(F.min("seq").alias("first"))
    linked = numbered.join(above, "parent", "left").join(first, "shared", "left")
    return linked.select("seq", "parent_seq", "name", "path", F.when(F.col("first") != F.col("seq"), F.col("first")).alias("link_to"))


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """Entries of the tree at ``root``, all read by tasks.

    The tree must be mounted where the tasks run.  Further names of one inode are hard links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq, parent_seq, name, path, link_to in _rows(batches):
            status = os.lstat(path)
            kind = "hardlink" if link_to is not None else kind_of(status.st_mode)
            content = None
            if kind == "file":
                with open(path, "rb") as f:
                    content = f.read()
            row = {"seq": seq, "parent_seq": parent_seq, "name": name, "link_to": link_to} | metadata(status) | {"kind": kind, "content": content}
            row["target"] = os.fsdecode(os.readlink(path)) if kind == "symlink" else None
            row["device_id"] = status.st_rdev if kind in ("blkdev", "chardev") else None
            yield pa.RecordBatch.from_pylist([row], schema)

    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "decimal(20,0)": pa.decimal128(20, 0)}
    schema = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in ENTRIES.fields])
    return names(spark, root).mapInArrow(run, ENTRIES)
