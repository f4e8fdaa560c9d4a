"""Content deduplication of a stream of files: the persistent counterpart of the chunk store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_seen(files: DataFrame, content: str = "text", event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """The files whose content the stream hasn't had before.

    Without ``event_time`` every digest is kept as state for good, as a store must; with it,
    digests older than ``delay`` behind the watermark are let go, so the state is bounded.
    """
    digested = files.withColumn("digest", F.sha2(F.col(content), 256))
    if event_time is None:
        return digested.dropDuplicates(["digest"])
    return digested.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["digest"])


def append_new(files: DataFrame, path: str, checkpoint: str, content: str = "text", **limits: str) -> StreamingQuery:
    """Append to the Parquet table at ``path`` what is available now and not stored yet."""
    return first_seen(files, content, **limits).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
