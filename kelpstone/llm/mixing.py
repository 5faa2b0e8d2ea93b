"""Mixing sources to target weights (operator 3): subset-sum budget fitting.

Each source gets a budget of words. Whole passes over the source come first
(every document equally often); the rest of the budget is fitted by counting
the source's documents by exact length and choosing how many of each length
to take once more: an even share of every length, longest first, the
remainder carried on, whole documents where that leaves much, then bounded-knapsack dynamic programming over the words
still missing. Which documents of a length are taken is decided by a seeded
hash of their ids.

Style: DataFrame operations on (doc_id, source, size) rows; the fitting of one
source is a function over its length histogram, of one row per distinct length.

Defined results
---------------
null text: size 0; a document of size 0 takes part with 0 words. A null source
is a source of its own, ordered last. Ties (equal length, equal ids, repeated
rows) are broken by the hash of id and text, and rows equal in both are
interchangeable. Extra columns are dropped by ``mix`` and kept by ``repeated``.
An empty table gives an empty result. Reruns agree: nothing depends on row order.

Scale
-----
``mix`` reads the text once; ids, sources and sizes are written to the shared
folder. ``repeated`` reads it twice and shuffles it once. Documents of one
(source, length) are dealt into ``SALTS`` parts by hash, so that a length shared
by a third of all rows is ranked in many tasks. Sources may be many (hosts, say):
they are numbered by ranges, their budgets found by a few sums and joined, and
the driver holds single numbers and a row for each range.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import NOT_SPACE, materialize

#: Parts into which the documents of one source and length are dealt.
SALTS = 128
SEED = 20_011
#: Weights of the sources by code point order, repeating.
WEIGHTS = (1, 2, 3)
#: No document is taken more often, and no source's target exceeds so many times its size.
MOST = 3
#: Words at the end of a budget among which the dynamic program chooses. What is missing before it is less than the shortest document left, or at most this.
PROGRAM_WORDS = 1 << 22
#: Sources up to which their budgets (some 100 bytes each) are broadcast.
BROADCAST_SOURCES = 100_000


def _numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``number``, their place from 0 in code point order, null last. Ranges are numbered on their own and then shifted."""
    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("known").desc(), F.col("source")
    dealt = materialize(sources.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "source-ranges")
    starts, at = [], 0
    for r in sorted(dealt.groupBy("part").count().collect()):  # a row for each range
        starts.append((r["part"], at))
        at += r["count"]
    if not starts:
        return dealt.select("known", "source", "words", F.lit(0).alias("number"))
    shifts = F.broadcast(spark.createDataFrame(starts, "part int, start long"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("__place", place).join(shifts, "part").select("known", "source", "words", (F.col("start") + F.col("__place")).alias("number"))


def targets(sources: DataFrame, weights: Iterable[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (known, source, words) with ``target``: words by weight, none above ``most`` times its size, what that cuts off being reshared by weight.

    The share of a unit of weight rises as sources are filled. Each round is one sum over the sources; it ends with the one that fills no more.
    """
    cycle = [float(w) for w in weights]
    weight = F.element_at(F.lit(cycle), (F.pmod("number", F.lit(len(cycle))) + 1).cast("int"))
    known = materialize(_numbered(sources).withColumn("weight", weight), "source-weights")
    whole = known.agg(F.sum("words").alias("words"), F.sum("weight").alias("weight")).first()
    share, filled = (whole["words"] / whole["weight"] if whole["weight"] else 0.0), 0
    limit = F.col("words") * most
    while True:
        full = F.col("weight") * share > limit
        now = known.agg(F.count_if(full).alias("n"), F.coalesce(F.sum(F.when(full, limit)), F.lit(0)).alias("cut"), F.sum(F.when(~full, F.col("weight"))).alias("free")).first()
        if now["n"] == filled or not now["free"]:
            break
        filled, share = now["n"], (whole["words"] - now["cut"]) / now["free"]
    return known.select("known", "source", "words", F.least(F.col("weight") * share, limit.cast("double")).alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to ``budget`` as they can be brought."""
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    budget = max(0, min(budget, total))
    if not budget:
        return take
    carried = 0.0
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        if lengths[i] == 0:
            continue
        carried += float(lengths[i]) * float(counts[i]) * budget / total
        take[i] = min(counts[i], int(carried // lengths[i]))
        carried -= float(take[i]) * float(lengths[i])
    missing = budget - int((lengths * take).sum())
    for i in order:  # where shorter documents ran out: whole documents, longest first
        if 0 < lengths[i] <= missing:
            more = min(int(counts[i] - take[i]), missing // int(lengths[i]))
            take[i] += more
            missing -= more * int(lengths[i])
    # Gives the program choice: documents of every length are put back, in turn, while the remainder stays small.
    limit, put = min(PROGRAM_WORDS, 8 * int(lengths.max())), True
    while put:
        put = False
        for i in order[::-1]:
            if take[i] and lengths[i] and missing + lengths[i] <= limit:
                take[i] -= 1
                missing += int(lengths[i])
                put = True
    left = [i for i in order if take[i] < counts[i] and lengths[i]]
    if missing > 0 and left and lengths[left[-1]] > missing:  # every document left is longer: none, or the shortest
        take[left[-1]] += int(2 * missing > lengths[left[-1]])
        return take
    return take + _knapsack(lengths, counts - take, missing) if missing > 0 else take


def _knapsack(lengths: np.ndarray, left: np.ndarray, wanted: int) -> np.ndarray:
    """Bounded knapsack: counts whose sum is the reachable one nearest to ``wanted``, among sums up to ``wanted`` and the shortest length more.

    Sums that can be reached are the bits of one integer. Each length goes in as lots of 1, 2, 4 ... documents; a sum remembers the lot that first reached it.
    """
    take = np.zeros(len(lengths), np.int64)
    can = [i for i in np.argsort(-lengths, kind="stable") if left[i] > 0 and 0 < lengths[i]]
    if not can:
        return take
    top = wanted + int(lengths[can[-1]])
    mask = (1 << (top + 1)) - 1
    reached, lots = 1, []
    first = np.full(top + 1, -1, np.int32)
    for i in can:
        n, lot = min(int(left[i]), top // int(lengths[i])), 1
        while n > 0:
            lot = min(lot, n)
            words = lot * int(lengths[i])
            new = (reached << words) & mask & ~reached
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(top // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits)] = len(lots)
                reached |= new
            lots.append((i, lot, words))
            n -= lot
            lot *= 2
        if reached >> wanted & 1:
            break
    bits = np.flatnonzero(np.unpackbits(np.frombuffer(reached.to_bytes(top // 8 + 1, "little"), np.uint8), bitorder="little"))
    at = int(bits[np.abs(bits - wanted).argmin()])
    while at > 0:
        i, lot, words = lots[first[at]]
        take[i] += lot
        at -= words
    return take


def sized(docs: DataFrame, *others: Column) -> DataFrame:
    """(doc_id, known, source, size, salt, rank_by, others): ``size`` counts words, ``rank_by`` is the seeded hash that orders documents of one length."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(NOT_SPACE + "+")).cast("long")
    source = F.col("source").cast("string")
    hashed = F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("text"))
    return docs.select("doc_id", source.isNotNull().alias("known"), F.coalesce(source, F.lit("")).alias("source"), size.alias("size"), hashed.alias("rank_by"), F.pmod(hashed, F.lit(SALTS)).cast("int").alias("salt"), *others)


def quotas(rows: DataFrame, weights: Iterable[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """How often documents of each (known, source, size, salt) are taken: ``passes`` times all, and the first ``quota`` by rank once more; with source_size and target."""
    parts = materialize(rows.groupBy("known", "source", "size", "salt").agg(F.count("*").alias("n")), "length-parts")
    by_length = parts.groupBy("known", "source", "size").agg(F.sum("n").alias("n"))
    sources = by_length.groupBy("known", "source").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    budgets = materialize(targets(sources, weights, most).withColumnRenamed("words", "source_size"), "source-budgets")
    if budgets.count() <= BROADCAST_SOURCES:
        budgets = F.broadcast(budgets)

    def plan(lengths: pd.DataFrame) -> pd.DataFrame:
        lengths = lengths.sort_values("size")
        size, target = int(lengths["source_size"].iloc[0]), float(lengths["target"].iloc[0])
        passes = min(most, int(target // size)) if size else 0
        rest = 0 if passes == most else round(target - passes * size)
        # A document may be taken up to most times in all, which matters where a source's long documents don't fit its budget.
        number = lengths["n"].to_numpy(np.int64)
        chosen = fit(lengths["size"].to_numpy(np.int64), number * (most - passes), rest)
        return lengths[["known", "source", "size", "source_size", "target"]].assign(passes=passes + chosen // number, chosen=chosen % number)

    schema = "known boolean, source string, size long, source_size long, target double, passes long, chosen long"
    planned = by_length.join(budgets, ["known", "source"]).groupBy("known", "source").applyInPandas(plan, schema)
    before = Window.partitionBy("known", "source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cut = parts.join(planned, ["known", "source", "size"]).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return cut.select("known", "source", "size", "salt", "source_size", "target", "passes", F.greatest(F.lit(0), F.least("n", F.col("chosen") - F.col("before"))).alias("quota"))


def _taken(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """``rows`` of ``sized`` with ``times``; the ranks, so the choice, are the same wherever they are computed."""
    keys = ["known", "source", "size", "salt"]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("rank_by", "doc_id")))
    times = (F.col("passes") + (F.col("rank") <= F.col("quota")).cast("long")).cast("int")
    return ranked.join(shares, keys).withColumn("times", times)


def mix(docs: DataFrame, weights: Iterable[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken, times): how many times each document enters the mix, and its words in it."""
    rows = materialize(sized(docs), "sized-documents")
    taken = _taken(rows, quotas(rows, weights, most))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def repeated(docs: DataFrame, weights: Iterable[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` takes it. Rows are ranked as they are there, with their texts, so nothing is joined back by id."""
    whole = sized(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    taken = _taken(whole, quotas(sized(docs), weights, most)).where(F.col("times") > 0)
    copies = taken.select("__row", F.explode(F.sequence(F.lit(1), "times")))
    return copies.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
