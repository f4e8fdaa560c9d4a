"""Checks of a catalogue: every broken rule is a row of (rule, at)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.model import ImageError
from quern.operators import scans

U32 = (1 << 32) - 1


def orphans(child: DataFrame, parent: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``child`` without a parent."""
    return child.join(parent.select(*on), on, "left_anti")


def _broken(df: DataFrame, rule: str, at: str, bad: Column) -> DataFrame:
    return df.where(bad).select(F.lit(rule).alias("rule"), F.col(at).cast("long").alias("at"))


def violations(c: dict[str, DataFrame]) -> DataFrame:
    """(rule, at) for the catalogue ``c``: bounds between its tables, times and sizes.

    Counts of whole tables are one row each and cross to the rows they bound by broadcast.
    """

    def bound(df: DataFrame, parent: str, out: str = "n", less: int = 0) -> DataFrame:
        return df.crossJoin(F.broadcast(c[parent].agg((F.count("*") - less).alias(out))))

    options = F.broadcast(c["options"])
    block = c["options"].select("block_size", F.lit(0).alias("at"))
    chunks = bound(c["chunks"], "sections").crossJoin(options.select("block_size"))
    directories = bound(c["directories"], "dir_entries")
    inodes = bound(bound(bound(c["inodes"], "modes", "n_modes"), "uids", "n_uids"), "gids", "n_gids").crossJoin(options.select("timestamp_base", "mtime_only"))
    entries = bound(bound(c["dir_entries"], "inodes", "n_inodes"), "names", "n_names")
    late = lambda t: F.col("timestamp_base") + F.col(t) > U32
    found = [
        _broken(block, "block_size_power_of_two", "at", (F.col("block_size") <= 0) | (F.bit_count("block_size") != 1)),
        _broken(chunks, "chunk_section", "chunk_idx", F.col("section_idx") >= F.col("n")),
        _broken(chunks, "chunk_in_block", "chunk_idx", F.col("offset") + F.col("size") > F.col("block_size")),
        *(_broken(directories, f"directory_{k}", "inode_num", F.col(k) > F.col("n")) for k in ("first_entry", "parent_entry", "self_entry")),
        _broken(inodes, "inode_mode", "inode_num", F.col("mode_index") >= F.col("n_modes")),
        _broken(inodes, "inode_owner", "inode_num", F.col("owner_index") >= F.col("n_uids")),
        _broken(inodes, "inode_group", "inode_num", F.col("group_index") >= F.col("n_gids")),
        *(_broken(inodes, f"{k[:5]}_overflow", "inode_num", late(k)) for k in ("mtime_offset", "atime_offset", "ctime_offset")),
        _broken(inodes, "mtime_only", "inode_num", F.col("mtime_only") & ((F.col("atime_offset") != 0) | (F.col("ctime_offset") != 0))),
        _broken(bound(c["chunk_table"], "chunks"), "chunk_table", "file_idx", F.col("first_chunk") > F.col("n")),
        _broken(bound(c["symlink_table"], "symlinks"), "symlink_target", "pos", F.col("target_index") >= F.col("n")),
        _broken(entries, "entry_inode", "entry_idx", (F.col("entry_idx") > 0) & (F.col("inode_num") >= F.col("n_inodes"))),
        _broken(entries, "entry_name", "entry_idx", (F.col("entry_idx") > 0) & (F.col("name_index") >= F.col("n_names"))),
        _broken(c["dir_entries"], "root_entry", "entry_idx", (F.col("entry_idx") == 0) & (F.col("inode_num") != 0)),
    ]
    return reduce(DataFrame.unionByName, found)


def unique_section(sections: DataFrame, section_type: int, name: str) -> int:
    """The index of the one section of a type."""
    rows = sections.where(F.col("section_type") == section_type).select("section_idx").limit(2).collect()
    if len(rows) != 1:
        raise ImageError("duplicate_section" if rows else "missing_section", f"{'duplicate' if rows else 'missing'} section {name}")
    return rows[0]["section_idx"]


def section_order(sections: DataFrame) -> DataFrame:
    """Sections that do not begin after the one before them."""
    return scans.not_rising(sections, "section_idx", "offset")


def duplicate_names(entries: DataFrame, parent: str, name: str) -> DataFrame:
    """(parent, name, n) of names that a directory has more than once."""
    return entries.groupBy(parent, name).agg(F.count("*").alias("n")).where("n > 1")

