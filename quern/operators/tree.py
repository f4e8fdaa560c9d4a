"""Hierarchies: paths, lookups, listings and the mtree order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.columns import explode_range, mtree_escape
from quern.scratch import materialize


def paths(entries: DataFrame, node: str = "node", parent: str = "parent", name: str = "name") -> DataFrame:
    """``entries`` with ``path``, the names from the root joined by ``/``, and ``depth``.

    The root is the row with a null parent; its path is empty.  Every round doubles how far up
    each row has looked, so a tree of depth d takes log2(d) joins.
    """
    rows = entries.select(F.col(node).alias("n"), F.col(parent).alias("up"), F.when(F.col(parent).isNull(), "").otherwise(F.col(name)).alias("path"), F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("depth"))
    while True:
        above = rows.select(F.col("n").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"), F.col("depth").alias("higher"))
        rows = materialize(
            rows.join(above, "up", "left").select(
                "n",
                F.col("next").alias("up"),
                F.when(F.coalesce(F.col("head"), F.lit("")) == "", F.col("path")).otherwise(F.concat_ws("/", "head", "path")).alias("path"),
                (F.col("depth") + F.coalesce("higher", F.lit(0))).alias("depth"),
            ),
            "paths",
        )
        if rows.where(F.col("up").isNotNull()).limit(1).count() == 0:
            return entries.join(rows.select(F.col("n").alias(node), "path", "depth"), node)


def directory_entries(directories: DataFrame, entries: DataFrame) -> DataFrame:
    """(inode_num, entry_idx, ...): each directory's half-open range of entries, as an equi-join.

    ``directories`` (inode_num, first_entry) ends with its sentinel; a range join of the two
    tables would compare every directory with every entry.
    """
    following = directories.select((F.col("inode_num") - 1).alias("inode_num"), F.col("first_entry").alias("end"))
    ranges = directories.select("inode_num", "first_entry").join(following, "inode_num")
    return explode_range(ranges, F.col("first_entry"), F.col("end"), "entry_idx").select(F.col("inode_num").alias("dir_inode"), "entry_idx").join(entries, "entry_idx")


def file_chunks(chunk_table: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_idx, chunk_idx, ...): each file's range of chunks; empty files have none."""
    following = chunk_table.select((F.col("file_idx") - 1).alias("file_idx"), F.col("first_chunk").alias("end"))
    ranges = chunk_table.join(following, "file_idx")
    return explode_range(ranges, F.col("first_chunk"), F.col("end"), "chunk_idx").select("file_idx", "chunk_idx").join(chunks, "chunk_idx")


def prefixes(path: Column) -> Column:
    """Every prefix of a path, from its first component to the whole."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def lookup(listed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``listed`` by their path; a path that isn't there gives no row."""
    return wanted.join(listed, "path")


def children(listed: DataFrame, parent: object, name: str | None = None) -> DataFrame:
    found = listed.where(F.col("parent") == parent)
    return found if name is None else found.where(F.col("name") == name)


def mtree_key(path: Column, is_dir: Column) -> Column:
    """Sorts files before directories at each level, then by name, subtrees after their root."""
    parts = F.split(path, "/")
    last = F.size(parts) - 1
    return F.transform(parts, lambda p, i: F.struct(F.when(i < last, True).otherwise(is_dir).alias("is_dir"), p.alias("name")))


def mtree_lines(listed: DataFrame) -> DataFrame:
    """(sort_key, line) of ``listed`` (path, kind, permissions, uid, gid, size, target, device_id).

    Pipes, sockets and devices are written too, as an extension of the format.
    """
    kinds = {"dir": "dir", "file": "file", "symlink": "link", "blkdev": "block", "chardev": "char", "fifo": "fifo", "socket": "socket"}
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("kind"))
    escaped = F.array_join(F.transform(F.split("path", "/"), mtree_escape), "/")
    line = F.concat_ws(
        " ",
        F.concat(F.lit("./"), escaped),
        F.concat(F.lit("type="), kind),
        F.concat(F.lit("mode="), F.lpad(F.conv(F.col("permissions").cast("string"), 10, 8), 4, "0")),
        F.concat(F.lit("uid="), F.col("uid").cast("string")),
        F.concat(F.lit("gid="), F.col("gid").cast("string")),
        F.when(F.col("kind") == "file", F.concat(F.lit("size="), F.col("size").cast("string"))),
        F.when(F.col("kind") == "symlink", F.concat(F.lit("link="), F.col("target"))),
        F.when(F.col("kind").isin("blkdev", "chardev"), F.concat(F.lit("device="), F.col("device_id").cast("string"))),
    )
    return listed.where("path <> ''").select(mtree_key(F.col("path"), F.col("kind") == "dir").alias("sort_key"), line.alias("line"))
