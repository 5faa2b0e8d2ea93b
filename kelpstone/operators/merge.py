"""Flushing logs into runs and merging runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import encoded_size
from .versions import newest


def flush(log: DataFrame) -> DataFrame:
    """Entries of a run: the newest version of each key, tombstones too, with its lsn as ``seq``."""
    return log.groupBy("key").agg(F.max_by("value", "lsn").alias("value"), F.max_by(F.col("op") == 2, "lsn").alias("is_tombstone"), F.max("lsn").alias("seq"))


def run_meta(entries: DataFrame, run: str = "run") -> DataFrame:
    """Key range, entries and encoded bytes of each run."""
    return entries.groupBy(run).agg(
        F.min("key").alias("smallest_key"), F.max("key").alias("largest_key"), F.count("*").alias("entries"),
        F.sum(encoded_size(F.col("key").cast("string"), F.col("value"))).alias("encoded_bytes"),
    )


def merge(entries: DataFrame, bottom: bool, order: str = "seq") -> DataFrame:
    """The newest version of each key over all runs; at the bottom level, winning tombstones go."""
    out = newest(entries, order)
    return out.where(~F.col("is_tombstone")) if bottom else out


def merge_stats(entries: DataFrame, bottom: bool, order: str = "seq") -> DataFrame:
    """Counts of a merge: entries read, losers, dropped tombstones, entries written. One aggregation by key, one over it."""
    per = entries.groupBy("key").agg(F.count("*").alias("n"), F.max_by("is_tombstone", order).alias("dead"))
    dropped = F.count_if("dead") if bottom else F.lit(0).cast("long")
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("keys_merged"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_keys_dropped"),
        dropped.alias("tombstones_dropped"), (F.count("*") - dropped).alias("keys_written"),
    )
