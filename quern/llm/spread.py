"""Joins of many rows with what is known of their key, where one key may hold most of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is known of all keys is broadcast up to this size.
BROADCAST_BYTES = 16 << 20
#: Keys that are dealt to parts: there are fewer than this, whatever the input.
MOST_PARTED = 20_000


def lean(rows: DataFrame, row_bytes: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Written ``rows``, marked for broadcast if they, counted, take no more than that; a join on
    a key that no row shares needs no parts beyond it."""
    return F.broadcast(rows) if rows.count() * row_bytes <= broadcast_bytes else rows


class Spread:
    """``weights`` is (key, weight): what each key's rows weigh; ``part`` the weight from which a
    key is dealt to parts in proportion to it."""

    def __init__(self, weights: DataFrame, key: str, part: int, broadcast_bytes: int = BROADCAST_BYTES):
        self.key, self.most = key, broadcast_bytes
        total = weights.agg(F.sum("weight")).first()[0] or 0
        self.part = max(part, total // MOST_PARTED)
        # Each has more than one in MOST_PARTED of the whole weight, which bounds their number.
        parts = F.ceil(F.col("weight") / F.lit(self.part)).cast("int")
        self.parted = weights.where(F.col("weight") > self.part).select(key, parts.alias("parts"))

    def join(self, rows: DataFrame, known: DataFrame, dealt_by: str, size: Column) -> DataFrame:
        """``rows`` (left) with ``known``, one row a key, of ``size`` bytes a row beside a few of
        its own.  If that is much in all, the rows of heavy keys are dealt by ``dealt_by``."""
        held = known.agg(F.sum(size + F.octet_length(F.col(self.key).cast("string")) + 16)).first()[0] or 0
        if held <= self.most:
            return rows.join(F.broadcast(known), self.key, "left")
        part = F.pmod(F.xxhash64(dealt_by), F.coalesce("parts", F.lit(1))).cast("int")
        dealt = rows.join(F.broadcast(self.parted), self.key, "left").withColumn("part", part).drop("parts")
        each = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
        copies = known.join(F.broadcast(self.parted), self.key, "left").withColumn("part", each).drop("parts")
        return dealt.join(copies, [self.key, "part"], "left").drop("part")
