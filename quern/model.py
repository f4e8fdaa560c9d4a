"""Tables of an image's catalogue, and the fixed values of the format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Fixed values of the image format.
MAGIC = b"DWARFS"
VERSIONS = ((2, 3), (2, 4), (2, 5))
HEADER_BYTES = 64
SECTION_TYPES = {0: "BLOCK", 7: "METADATA_V2_SCHEMA", 8: "METADATA_V2", 9: "SECTION_INDEX", 10: "HISTORY"}
COMPRESSIONS = {0: "NONE", 1: "LZMA", 2: "ZSTD", 3: "LZ4", 4: "LZ4HC", 5: "BROTLI", 6: "FLAC", 7: "RICEPP"}
TYPE_BITS = {"dir": 0o040000, "symlink": 0o120000, "file": 0o100000, "blkdev": 0o060000, "chardev": 0o020000, "fifo": 0o010000, "socket": 0o140000}
KINDS = ("dir", "symlink", "file", "shared", "device", "ipc")
DEFAULT_BLOCK = 16 << 20
LIMITS = {"section_index_size_limit": 2 << 20, "schema_size_limit": 16 << 10, "metadata_size_limit": 64 << 20, "block_cache_size_limit": 512 << 20}
OFFSET_BITS = 48

_L, _S, _B, _I = T.LongType(), T.StringType(), T.BinaryType(), T.IntegerType()
U64 = T.DecimalType(20, 0)


def _t(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TABLES: dict[str, T.StructType] = {
    "sections": _t(section_idx=_L, section_type=_I, compress_algo=_I, section_number=_L, offset=_L, payload_size=_L, fast_hash=_B, slow_hash=_B),
    "inodes": _t(inode_num=_L, kind=_S, mode_index=_L, owner_index=_L, group_index=_L, mtime_offset=_L, atime_offset=_L, ctime_offset=_L),
    "dir_entries": _t(entry_idx=_L, name_index=_L, inode_num=_L),
    "directories": _t(inode_num=_L, parent_entry=_L, first_entry=_L, self_entry=_L),
    "chunk_table": _t(file_idx=_L, first_chunk=_L),
    "chunks": _t(chunk_idx=_L, section_idx=_L, offset=_L, size=_L),
    "modes": _t(pos=_L, value=_L),
    "uids": _t(pos=_L, value=_L),
    "gids": _t(pos=_L, value=_L),
    "names": _t(pos=_L, value=_S),
    "symlinks": _t(pos=_L, value=_S),
    "symlink_table": _t(pos=_L, target_index=_L),
    "devices": _t(pos=_L, device_id=U64),
    "shared_files": _t(pos=_L, file_slot=_L),
    "options": _t(mtime_only=T.BooleanType(), time_resolution_sec=_L, timestamp_base=_L, block_size=_L, scaled=T.BooleanType()),
}

ENTRIES = _t(
    seq=_L, parent_seq=_L, name=_S, kind=_S, link_to=_L, mode=_L, uid=_L, gid=_L, mtime=_L, atime=_L, ctime=_L, target=_S, device_id=U64, content=_B
)


def dimension(spark: SparkSession, values: dict[int, str]) -> DataFrame:
    """A table of known numbers and names; unknown numbers get a null name by a left join."""
    return spark.createDataFrame(list(values.items()), "number int, name string")


class ImageError(Exception):
    """An image that can't be read or written; ``kind`` names the fault."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind
