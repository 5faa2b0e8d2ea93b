"""Reading versioned data: the newest version of each key decides, tombstones included.

A log is a DataFrame with key, value, is_tombstone and one or more ordering
columns. Predicates on the key pass below the aggregation into the scan;
predicates on values and tombstones must not, and don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest(log: DataFrame, order: str | Column = "seq", key: str = "key", columns: list[str] | None = None) -> DataFrame:
    """One row per key with the columns of its newest version, tombstones as well. Column by column, so that unused columns aren't read."""
    kept = columns if columns is not None else [c for c in log.columns if c != key]
    return log.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in kept])


def latest(log: DataFrame, order: str | Column = "seq", key: str = "key", columns: list[str] | None = None) -> DataFrame:
    """The live newest versions."""
    kept = columns if columns is not None else [c for c in log.columns if c not in (key, "is_tombstone")]
    return newest(log, order, key, [*kept, "is_tombstone"]).where(~F.col("is_tombstone")).drop("is_tombstone")


def get(log: DataFrame, value, order: str | Column = "seq", key: str = "key") -> DataFrame:
    """The live version of one key, or no row."""
    return latest(log.where(F.col(key) == F.lit(value)), order, key)


def multi_get(log: DataFrame, keys: DataFrame, order: str | Column = "seq", key: str = "key") -> DataFrame:
    """A row for each wanted key, with nulls where it has no live version. Only wanted keys are aggregated."""
    wanted = keys.select(key).distinct()
    found = latest(log.join(wanted, key, "left_semi"), order, key)
    return wanted.join(found, key, "left")


def missing(log: DataFrame, keys: DataFrame, order: str | Column = "seq", key: str = "key") -> DataFrame:
    """Wanted keys without a live version."""
    wanted = keys.select(key).distinct()
    return wanted.join(latest(log.join(wanted, key, "left_semi"), order, key, []), key, "left_anti")


def scan_range(log: DataFrame, low, high, order: str | Column = "seq", key: str = "key") -> DataFrame:
    """Live versions with low <= key <= high."""
    return latest(log.where(F.col(key).between(low, high)), order, key)


def scan_prefix(log: DataFrame, prefix: str, order: str | Column = "seq", key: str = "key") -> DataFrame:
    return latest(log.where(F.col(key).startswith(prefix)), order, key)


def as_of(log: DataFrame, lsn: int, order: str = "lsn", key: str = "key") -> DataFrame:
    """Live versions as they were after the mutation ``lsn``."""
    return latest(log.where(F.col(order) <= lsn), order, key)
