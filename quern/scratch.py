"""Intermediate tables in the folder that driver and executors share.

A written table cuts lineage as a checkpoint does, survives lost executors, and keeps
Python stages from running once for each consumer.  Files stay until ``clean`` is called
or the cluster expires its checkpoint folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder: there, driver and
    executors are one process.  A cluster without it is refused.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/quern"
    return f"{base.rstrip('/')}/quern-{sc.applicationId}"


#: Paths given out, in order.
_given: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _given.append(f"{root(spark)}/{name}-{uuid.uuid4().hex}")
    return _given[-1]


def given() -> int:
    """How many paths have been given out, for ``release``."""
    return len(_given)


def release(spark: SparkSession, begun: int) -> None:
    """Delete all paths given out since ``begun`` but the last, which holds the result."""
    for path in _given[begun:-1]:
        _delete(spark, path)
    del _given[begun:-1]


def materialize(df: DataFrame, name: str, spread: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and return it as read back.

    ``spread`` lets one small file be read as several tasks by keeping the row groups small.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if spread:
        writer = writer.option("parquet.block.size", 8 << 20)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete all that this application has left in the shared folder."""
    _delete(spark, root(spark))


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
