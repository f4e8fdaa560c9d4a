"""From a table of entries to the catalogue of an image."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.columns import compose_mode, stored_time
from quern.model import ImageError
from quern.operators import scans, validate
from quern.scratch import materialize

#: Order of the kinds among inode numbers.
RANK = {"dir": 0, "symlink": 1, "file": 2, "blkdev": 3, "chardev": 3, "fifo": 4, "socket": 4}


def check(entries: DataFrame, chunks: DataFrame, block_size: int) -> None:
    """Refuse entries that no image can hold; all rules are looked up in one job."""
    named = entries.where(F.col("parent_seq").isNotNull())
    parents = entries.where("kind = 'dir'").select(F.col("seq").alias("parent_seq"))
    linked = entries.where("kind = 'hardlink'").select(F.col("link_to").alias("target"))
    targets = entries.where("kind not in ('dir', 'hardlink')").select(F.col("seq").alias("target"))
    rules = {
        "duplicate_name": ("a name occurs twice in a directory", validate.duplicate_names(named, "parent_seq", "name")),
        "chunk_bounds": ("a chunk exceeds its block", chunks.where(F.col("offset") + F.col("size") > block_size)),
        "time": ("a time is before the epoch", entries.where((F.col("mtime") < 0) | (F.col("atime") < 0) | (F.col("ctime") < 0))),
        "mode": ("a mode has more than permission bits", entries.where((F.col("mode") < 0) | (F.col("mode") > 0o777))),
        "parent": ("an entry's parent is no directory", validate.orphans(named, parents, ["parent_seq"])),
        "hard_link": ("a hard link's target is missing or a directory", validate.orphans(linked, targets, ["target"])),
    }
    broken = [bad.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*[c for c in bad.columns if c != "content"])).alias("row")) for kind, (_, bad) in rules.items()]
    found = reduce(DataFrame.unionByName, broken).limit(1).collect()
    if found:
        raise ImageError(found[0]["kind"], f"{rules[found[0]['kind']][0]}: {found[0]['row']}")


def catalogue(
    entries: DataFrame,
    chunks: DataFrame,
    block_size: int = 16 << 20,
    mtime_only: bool = False,
    time_resolution_sec: int = 1,
    source_date_epoch: int | None = None,
) -> dict[str, DataFrame]:
    """The tables of an image of ``entries`` (one root with a null parent, which comes first)
    and ``chunks`` (seq of the file, idx, section_idx, offset, size)."""
    spark = entries.sparkSession
    check(entries, chunks, block_size)
    own = entries.where("kind <> 'hardlink'")
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), F.col("kind"))
    moded = own.withColumn("full_mode", compose_mode(F.col("kind"), F.col("mode")))
    numbered = materialize(scans.renumber(moded.drop("content"), rank, "seq", "inode_num", len(set(RANK.values()))), "inodes")

    out: dict[str, DataFrame] = {}
    coded = numbered
    for table, column, index in (("modes", "full_mode", "mode_index"), ("uids", "uid", "owner_index"), ("gids", "gid", "group_index")):
        words = materialize(scans.dictionary(numbered, "seq", column), table)
        out[table] = words.select("pos", F.col("value").cast("long").alias("value"))
        coded = coded.join(words.select(F.col("value").alias(column), F.col("pos").alias(index)), column)
    time = lambda c: stored_time(F.col(c), time_resolution_sec, source_date_epoch).cast("long")
    zero = F.lit(0).cast("long")
    out["inodes"] = coded.select(
        "inode_num",
        F.when(F.col("kind").isin("blkdev", "chardev"), "device").when(F.col("kind").isin("fifo", "socket"), "ipc").otherwise(F.col("kind")).alias("kind"),
        "mode_index", "owner_index", "group_index",
        time("mtime").alias("mtime_offset"),
        (zero if mtime_only else time("atime")).alias("atime_offset"),
        (zero if mtime_only else time("ctime")).alias("ctime_offset"),
    )

    number = numbered.select("seq", "inode_num", "kind")
    named = entries.where(F.col("parent_seq").isNotNull())
    names = materialize(scans.dictionary(named, "seq", "name"), "names")
    out["names"] = names.select("pos", "value")
    links = named.select("parent_seq", "name", F.coalesce("link_to", "seq").alias("seq"), F.when(F.col("kind") == "dir", F.col("seq")).alias("dir_seq"))
    sortable = links.join(number.select("seq", "inode_num"), "seq").join(names.select(F.col("value").alias("name"), F.col("pos").alias("name_index")), "name")
    sorted_entries = materialize(scans.ranked(sortable, ["parent_seq", "name"], "place").withColumn("entry_idx", F.col("place") + 1), "entries")
    root = number.where("inode_num = 0").select(F.lit(0).cast("long").alias("entry_idx"), F.lit(0).cast("long").alias("name_index"), "inode_num")
    out["dir_entries"] = root.unionByName(sorted_entries.select("entry_idx", "name_index", "inode_num"))

    dirs = number.where("kind = 'dir'").select("seq", "inode_num")
    sizes = sorted_entries.groupBy(F.col("parent_seq").alias("seq")).agg(F.count("*").alias("n"))
    counted = dirs.join(sizes, "seq", "left").fillna(0, ["n"])
    firsts = scans.prefix_sum(counted, "inode_num", F.col("n"), "end").select("seq", "inode_num", (F.col("end") - F.col("n") + 1).alias("first_entry"), (F.col("end") + 1).alias("stop"))
    own_entry = sorted_entries.where(F.col("dir_seq").isNotNull()).select(F.col("dir_seq").alias("seq"), F.col("entry_idx").alias("self_entry"), "parent_seq")
    placed = firsts.join(own_entry, "seq", "left").fillna(0, ["self_entry"])
    parent = placed.select(F.col("seq").alias("parent_seq"), F.col("self_entry").alias("parent_entry"))
    directories = placed.join(parent, "parent_seq", "left").fillna(0, ["parent_entry"])
    last = firsts.agg(F.max("inode_num").alias("n"), F.max("stop").alias("stop")).select((F.col("n") + 1).alias("inode_num"), zero.alias("parent_entry"), F.col("stop").alias("first_entry"), zero.alias("self_entry"))
    out["directories"] = directories.select("inode_num", "parent_entry", "first_entry", "self_entry").unionByName(last)

    files = number.where("kind = 'file'").select("seq", "inode_num")
    of_file = chunks.groupBy("seq").agg(F.count("*").alias("n"))
    slots = scans.positions(files, "inode_num", "file_idx")
    counted = materialize(scans.prefix_sum(slots.join(of_file, "seq", "left").fillna(0, ["n"]), "file_idx", F.col("n"), "end"), "files")
    begins = counted.select("seq", "file_idx", (F.col("end") - F.col("n")).alias("first_chunk"))
    sentinel = counted.agg(F.count("*").alias("file_idx"), F.coalesce(F.max("end"), F.lit(0)).alias("first_chunk"))
    out["chunk_table"] = begins.select("file_idx", "first_chunk").unionByName(sentinel)
    in_file = F.row_number().over(Window.partitionBy("seq").orderBy("idx")) - 1
    out["chunks"] = chunks.withColumn("nth", in_file).join(begins, "seq").select((F.col("first_chunk") + F.col("nth")).alias("chunk_idx"), "section_idx", "offset", "size")

    symlinks = numbered.where("kind = 'symlink'").select("seq", "inode_num", "target")
    targets = materialize(scans.dictionary(symlinks, "seq", "target"), "targets")
    out["symlinks"] = targets.select("pos", "value")
    out["symlink_table"] = scans.positions(symlinks, "inode_num", "place").join(targets.select(F.col("value").alias("target"), F.col("pos").alias("target_index")), "target").select(F.col("place").alias("pos"), "target_index")
    devices = numbered.where("kind in ('blkdev', 'chardev')").select("inode_num", "device_id")
    out["devices"] = scans.positions(devices, "inode_num", "pos").select("pos", "device_id")
    out["shared_files"] = spark.createDataFrame([], "pos long, file_slot long")
    out["options"] = spark.createDataFrame([(mtime_only, time_resolution_sec, 0, block_size, True)], "mtime_only boolean, time_resolution_sec long, timestamp_base long, block_size long, scaled boolean")
    return out


def block_size(c: dict[str, DataFrame]) -> int:
    """The block size of the catalogue ``c``."""
    return c["options"].first()["block_size"]


def root(c: dict[str, DataFrame]) -> DataFrame:
    """The one inode of the catalogue's root directory, to which new entries can be added."""
    return c["inodes"].join(c["dir_entries"].where("entry_idx = 0").select("inode_num"), "inode_num")


def tally(c: dict[str, DataFrame]) -> dict[str, int]:
    """Where each kind begins among the inode numbers, from the sizes of the tables."""
    count = lambda t: c[t].count()
    shared = count("shared_files")
    slots = count("chunk_table") - 1
    unique = slots - ((c["shared_files"].agg(F.max("file_slot")).first()[0] or 0) + 1 if shared else 0)
    starts = {"symlink": count("directories") - 1}
    starts["file"] = starts["symlink"] + count("symlink_table")
    starts["shared"] = starts["file"] + unique
    starts["device"] = starts["shared"] + shared
    starts["ipc"] = starts["device"] + count("devices")
    return starts
