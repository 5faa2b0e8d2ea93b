"""Bloom filters with double hashing, as position lists and as packed bitmaps."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fnv1a32

# The seeds of the two hashes.
SEEDS = (0xBC9F1D34, 0x9747B28C)


def bits_for(keys: int, bits_per_key: int) -> int:
    return (max(keys * bits_per_key, 64) + 7) // 8 * 8


def hashes_for(bits_per_key: int) -> int:
    return min(30, max(1, round(math.log(2) * bits_per_key)))


def positions(key: Column, bits: int, hashes: int) -> Column:
    """Bit positions of a key: (h1 + i h2 mod 2**32) mod bits."""
    pair = F.struct(fnv1a32(key, SEEDS[0]).alias("a"), fnv1a32(key, SEEDS[1]).alias("b"))
    at = lambda h: F.transform(F.sequence(F.lit(0).cast("long"), F.lit(hashes - 1).cast("long")), lambda i: ((h["a"] + i * h["b"]) % (1 << 32)) % bits)
    return F.transform(F.array(pair), at)[0]


def build(keys: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """The set bits as rows (word, value) of 32-bit words: at most bits / 32 rows, whatever the keys."""
    at = keys.select(F.explode(positions(F.col(key), bits, hashes)).alias("bit")).distinct()
    return at.groupBy(F.floor(F.col("bit") / 32).cast("long").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 32).cast("int"))).alias("value"))


def might_contain(probes: DataFrame, key: str, filter_words: DataFrame, bits: int, hashes: int) -> DataFrame:
    """``probes`` with ``maybe``. The filter is a scalar of bits / 8 bytes, a size set by its maker, that every task gets once."""
    every = probes.sparkSession.range((bits + 31) // 32).withColumnRenamed("id", "word")
    filled = every.join(filter_words, "word", "left").agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("value", F.lit(0).cast("long")).alias("value")))).alias("__words"))
    dense = filled.select(F.col("__words.value")).scalar()
    bit = lambda p: F.call_function("shiftright", F.get(dense, F.floor(p / 32).cast("int")), (p % 32).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    at = probes.withColumn("__at", positions(F.col(key), bits, hashes))
    # One test per hash: a scalar can't stand inside a lambda.
    return at.withColumn("maybe", reduce(and_, [bit(F.get("__at", F.lit(i))) == 1 for i in range(hashes)])).drop("__at")
