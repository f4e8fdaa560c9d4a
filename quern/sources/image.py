"""The data source ``imgfs``: a table of an image's catalogue, or its blocks.

    spark.dataSource.register(ImageSource)
    spark.read.format("imgfs").option("path", p).option("table", "inodes").load()

Options: table (a name of model.TABLES, or blocks), image_offset, section_index (use_embedded,
use_embedded_if_exists, build), verify (fast, slow, none), and the size limits of
model.LIMITS.  A table of the catalogue comes in parts of
equal rows, one for each PART_BYTES of the stored catalogue.  ``blocks`` has a partition for each
block, but of many blocks it takes as many as fill PART_BYTES; an equality on section_idx is pushed
down to read that block alone with the option pushdown=true, which needs
spark.sql.python.filterPushdown.enabled (read_table sets the option where the session has it).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from quern.codec import section
from quern.codec.image import Image, sections, table
from quern.model import LIMITS, TABLES

#: Stored bytes of the catalogue, or bytes of whole blocks, for each part in which they are read.
PART_BYTES = 8 << 20
#: Blocks share a part only if there are at least so many parts.
LEAST_PARTS = 64
BLOCKS = T.StructType([T.StructField("section_idx", T.LongType()), T.StructField("data", T.BinaryType())])


def open_image(options: dict[str, str]) -> Image:
    path = options["path"]
    fs, name = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path.removeprefix("file:"))
    source = fs.open_input_file(name)

    def read(offset: int, size: int) -> bytes:
        return source.read_at(size, offset)

    limits = {k: int(options[k]) for k in LIMITS if k in options}
    return Image(read, source.size(), int(options.get("image_offset", 0)), options.get("section_index", "use_embedded_if_exists"), options.get("verify", "fast"), **limits)


class ImageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "imgfs"

    def schema(self) -> T.StructType:
        name = self.options.get("table", "inodes")
        return BLOCKS if name == "blocks" else TABLES[name]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        options = dict(self.options)
        return PushingReader(options) if options.get("pushdown") == "true" else ImageReader(options)


class BlockPartition(InputPartition):
    def __init__(self, numbers: list[int], block_size: int):
        self.numbers, self.block_size = numbers, block_size


class RowsPartition(InputPartition):
    """Part ``number`` of ``count`` equal parts of a table's rows."""

    def __init__(self, number: int, count: int):
        self.number, self.count = number, count


class ImageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.wanted = options, None

    def partitions(self) -> list[InputPartition]:
        image = open_image(self.options)
        if self.options.get("table") != "blocks":
            count = -(-image.catalogue_bytes() // PART_BYTES)
            return [RowsPartition(i, count) for i in range(count)]
        size = int(image.metadata["block_size"])
        numbers = [i for i, (kind, _) in enumerate(image.index) if kind == section.BLOCK and (self.wanted is None or i in self.wanted)]
        step = max(1, min(PART_BYTES // size, len(numbers) // LEAST_PARTS))
        return [BlockPartition(numbers[i : i + step], size) for i in range(0, len(numbers), step)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        image = open_image(self.options)
        if isinstance(partition, BlockPartition):
            for number in partition.numbers:
                data = image.section(number, partition.block_size)[1]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([data], pa.binary())], ["section_idx", "data"])
        elif isinstance(partition, RowsPartition) and self.options.get("table") == "sections":
            yield from sections(image, *(k * len(image.index) // partition.count for k in (partition.number, partition.number + 1))).to_batches()
        elif isinstance(partition, RowsPartition):
            rows = table(image, self.options.get("table", "inodes"))
            start, end = (k * len(rows) // partition.count for k in (partition.number, partition.number + 1))
            yield from rows.slice(start, end - start).to_batches()


class PushingReader(ImageReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if self.options.get("table") == "blocks" and isinstance(f, (EqualTo, In)) and f.attribute == ("section_idx",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            else:
                yield f


def read_table(spark: SparkSession, path: str, name: str, **options: object) -> DataFrame:
    spark.dataSource.register(ImageSource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("imgfs").option("path", path).option("table", name).option("pushdown", pushdown.lower())
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def read_catalogue(spark: SparkSession, path: str, **options: object) -> dict[str, DataFrame]:
    return {name: read_table(spark, path, name, **options) for name in TABLES}
