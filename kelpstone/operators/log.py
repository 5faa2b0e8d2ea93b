"""The mutation log: its valid beginning, replay, and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import MAX_PAYLOAD


def valid_prefix(records: DataFrame, at: str = "lsn") -> DataFrame:
    """Records before the first corrupt one: ``payload`` against ``crc``, ``length`` against the bound.

    The first bad position is one number, found by an aggregation and compared with every record; nothing is sorted.
    """
    bad = (F.crc32("payload") != F.col("crc")) | (F.col("length") > MAX_PAYLOAD) | (F.octet_length("payload") < F.col("length"))
    first = records.where(F.coalesce(bad, F.lit(True))).agg(F.min(at).alias("__first"))
    return records.join(F.broadcast(first), F.col("__first").isNull() | (F.col(at) < F.col("__first"))).drop("__first")


def replay(log: DataFrame, last_flushed: int) -> DataFrame:
    """Mutations that no run holds yet; their number is how many a recovery applies."""
    return log.where(F.col("lsn") > last_flushed)


def summary(log: DataFrame) -> DataFrame:
    return log.agg(F.max("lsn").alias("max_lsn"), F.count_if(F.col("op") == 1).alias("puts"), F.count_if(F.col("op") == 2).alias("deletes"))


def size_in_memory(overhead: int = 64) -> Column:
    """Approximate bytes of a version: key, value, and a fixed overhead."""
    return F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + overhead


def memory(log: DataFrame, overhead: int = 64) -> DataFrame:
    """Approximate bytes in memory of what a log holds: the newest version of each key."""
    newest = log.groupBy("key").agg(F.max_by("value", "lsn").alias("value"))
    return newest.agg(F.coalesce(F.sum(size_in_memory(overhead)), F.lit(0)).cast("long").alias("bytes"))
