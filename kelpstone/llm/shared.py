"""Pieces that several operators of this subpackage use."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import fresh, materialize, scope, settled, shared_dir

#: White space in the contracts of these operators: U+0020 and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"

__all__ = ["BLANKS", "NOT_SPACE", "SPACE", "StorageLevel", "fresh", "let", "materialize", "released", "scope", "settled", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(x)`` with x bound to ``value``, which is then evaluated once instead of once per use."""
    return F.transform(F.array(value), body)[0]


def released(walk: Callable[[Iterable[Any]], Iterator[Any]]) -> Callable[[Iterable[Any]], Iterator[Any]]:
    """``walk`` (a function for partitions), after which the Python worker gives back memory that it no longer uses: it lives on beside the executor."""

    @functools.wraps(walk)
    def run(batches: Iterable[Any]) -> Iterator[Any]:
        yield from walk(batches)
        _give_back()

    return run


def _give_back() -> None:
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
