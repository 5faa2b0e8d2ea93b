"""The catalogue of runs and the levelled policy over it. A catalogue has a row per run, so it is small next to what it describes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError

# Fixed values of the levelled policy.
LEVELS, L0_TRIGGER, L0_SLOWDOWN, L0_STOP = 7, 4, 8, 12
L1_BYTES, GROWTH, RUN_BYTES = 10 << 20, 10, 64 << 20


def max_bytes(level: int) -> int:
    """The budget of a level; level 0 has none, its files are counted."""
    return L1_BYTES * GROWTH ** (level - 1) if level > 0 else 0


def max_bytes_column(level: Column) -> Column:
    return F.when(level <= 0, 0).otherwise(F.lit(L1_BYTES) * F.pow(F.lit(GROWTH), level - 1)).cast("long")


def add_file(catalogue: DataFrame, meta: DataFrame, levels: int = LEVELS) -> DataFrame:
    wrong = meta.where((F.col("level") < 0) | (F.col("level") >= levels) | F.col("level").isNull())
    if not wrong.isEmpty():
        raise EngineError("InvalidArgument", f"level out of 0..{levels - 1}")
    return catalogue.unionByName(meta)


def remove_files(catalogue: DataFrame, paths: DataFrame) -> DataFrame:
    return catalogue.join(paths.select("filepath"), "filepath", "left_anti")


def files_at(catalogue: DataFrame, level: int) -> DataFrame:
    return catalogue.where(F.col("level") == level).orderBy("smallest_key")


def level_bytes(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy("level").agg(F.count("*").alias("files"), F.sum("file_size_bytes").alias("bytes"))


def pick_level(catalogue: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One row: the level to compact (0 if it has enough files, else the first level over its budget), or -1."""
    per = level_bytes(catalogue)
    due = F.when(F.col("level") == 0, F.col("files") >= L0_TRIGGER).otherwise((F.col("level") <= levels - 2) & (F.col("bytes") > max_bytes_column(F.col("level"))))
    return per.agg(F.coalesce(F.min(F.when(due, F.col("level"))), F.lit(-1)).alias("level"))


def overlaps(low: Column, high: Column, other_low: Column, other_high: Column) -> Column:
    """Whether closed key ranges meet."""
    return ~((high < other_low) | (low > other_high))


def select_files(catalogue: DataFrame, source: int) -> DataFrame:
    """Inputs of a compaction: all runs of level 0, or the run with the smallest first key; and what they meet one level down."""
    at = catalogue.where(F.col("level") == source)
    chosen = at if source == 0 else at.orderBy("smallest_key", "sequence_number").limit(1)
    # Ranges of level 0 may overlap one another; a run below is an input if it meets any of them.
    below = catalogue.where(F.col("level") == source + 1)
    spans = chosen.select(F.col("smallest_key").alias("__low"), F.col("largest_key").alias("__high"))
    met = below.join(F.broadcast(spans), overlaps(F.col("smallest_key"), F.col("largest_key"), F.col("__low"), F.col("__high")), "left_semi")
    return chosen.unionByName(met)
