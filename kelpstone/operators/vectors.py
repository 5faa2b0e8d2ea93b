"""Vector distances and exact nearest neighbours. By their public definitions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Query vectors that go with one reading of the base (some 25 MB for 64 floats each); more take more readings. A task scores FEW of them at a time.
PASS, FEW = 100_000, 256
#: Query vectors up to which the expression form is used.
EXPRESSED = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Measure, and whether small values are near.
MEASURES = {"l2": (l2, True), "cosine": (cosine, False), "dot": (dot, False)}


def top_k(pairs: DataFrame, k: int, ascending: bool, query: str = "query_id", item: str = "vec_id", score: str = "score") -> DataFrame:
    """The k best items of each query, ties by id. Spark cuts each task's rows to k per query before the shuffle."""
    order = F.col(score).asc() if ascending else F.col(score).desc()
    rank = F.row_number().over(Window.partitionBy(query).orderBy(order, item))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def knn_expressions(base: DataFrame, queries: DataFrame, k: int, measure: str = "l2", digits: int = 9) -> DataFrame:
    """(query_id, vec_id, score, rank) by expressions alone, for few queries: each row of the base meets the broadcast queries."""
    f, ascending = MEASURES[measure]
    few = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("__q"))
    if few.count() > EXPRESSED:
        return knn(base, queries, k, measure, digits)
    pairs = base.join(F.broadcast(few), F.col("vec_id") != F.col("query_id"))
    scored = pairs.select("query_id", "vec_id", F.round(f(F.col("embedding"), F.col("__q")), digits).alias("score"))
    return top_k(scored, k, ascending)


def scores(a: np.ndarray, b: np.ndarray, measure: str) -> np.ndarray:
    """Scores of all rows of a against all of b, in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    if measure == "l2":
        return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))
    if measure == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return a @ b.T / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)[None, :]
    return a @ b.T


class Best:
    """The k best of each query among the vectors seen so far. Ties go to the smaller id."""

    def __init__(self, queries: int, k: int, ascending: bool):
        self.k, self.sign = k, 1.0 if ascending else -1.0
        self.scores, self.ids = np.full((queries, 0), np.inf), np.zeros((queries, 0), np.int64)

    def add(self, at: slice, found: np.ndarray, ids: np.ndarray) -> None:
        """``found``: scores of the queries of ``at`` against vectors with ascending ``ids``; not finite where a pair doesn't count."""
        if self.scores.shape[1] < self.k:
            missing = self.k - self.scores.shape[1]
            self.scores = np.pad(self.scores, ((0, 0), (0, missing)), constant_values=np.inf)
            self.ids = np.pad(self.ids, ((0, 0), (0, missing)), constant_values=np.iinfo(np.int64).max)
        order = np.argsort(found * self.sign, axis=1, kind="stable")[:, : self.k]
        scores = np.concatenate((self.scores[at], np.take_along_axis(found, order, 1) * self.sign), 1)
        both = np.concatenate((self.ids[at], ids[order]), 1)
        order = np.lexsort((both, scores), axis=1)[:, : self.k]
        self.scores[at], self.ids[at] = np.take_along_axis(scores, order, 1), np.take_along_axis(both, order, 1)

    def frame(self, queries: np.ndarray) -> pd.DataFrame:
        width = self.scores.shape[1]
        out = pd.DataFrame({"query_id": np.repeat(queries, width), "vec_id": self.ids.ravel(), "score": (self.scores * self.sign).ravel()})
        return out[np.isfinite(out["score"])]


def passes(queries: DataFrame) -> Iterator:
    """The queries (ids and vectors), broadcast, PASS of them at a time on average."""
    n = queries.count()
    parts = max(1, -(-n // PASS))
    for part in range(parts):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part).select("vec_id", "embedding").toPandas()
        yield queries.sparkSession.sparkContext.broadcast((rows["vec_id"].to_numpy(np.int64), np.array(rows["embedding"].tolist(), np.float32)))


def knn(base: DataFrame, queries: DataFrame, k: int, measure: str = "l2", digits: int = 9, by: str | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank) as matrix products over Arrow batches; a task keeps its k best for each query. ``by``: the k best of each value of this column first."""
    ascending = MEASURES[measure][1]
    out = None
    for sent in passes(queries):
        columns = ["vec_id", "embedding", *([by] if by else [])]
        found = base.select(*columns).mapInPandas(_nearest(sent, k, measure, ascending, digits, by), "query_id long, vec_id long, score double" + (f", {by} {base.schema[by].dataType.simpleString()}" if by else ""))
        out = found if out is None else out.unionByName(found)
    if by:
        order = F.col("score").asc() if ascending else F.col("score").desc()
        local = F.row_number().over(Window.partitionBy("query_id", by).orderBy(order, "vec_id"))
        out = out.withColumn("__r", local).where(F.col("__r") <= k).drop("__r")
    return top_k(out, k, ascending)


def knn_batched(base: DataFrame, queries: DataFrame, k: int, measure: str = "l2", digits: int = 9) -> DataFrame:
    """The same as ``knn``, by its first name."""
    return knn(base, queries, k, measure, digits)


def _nearest(sent, k: int, measure: str, ascending: bool, digits: int, by: str | None):
    def walk(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, wanted = sent.value
        best: dict = {}
        for batch in batches:
            for name, part in batch.groupby(by) if by else [(None, batch)]:
                if not len(part) or not len(ids):
                    continue
                part = part.sort_values("vec_id", kind="stable")
                own, data = part["vec_id"].to_numpy(np.int64), np.array(part["embedding"].tolist(), np.float32)
                kept = best.setdefault(name, Best(len(ids), k, ascending))
                for at in range(0, len(ids), FEW):
                    few = slice(at, at + FEW)
                    found = np.round(scores(wanted[few], data, measure), digits)
                    found[ids[few, None] == own[None, :]] = np.inf if ascending else -np.inf
                    found[np.isnan(found)] = np.inf if ascending else -np.inf
                    kept.add(few, found, own)
        for name, kept in best.items():
            yield kept.frame(ids).assign(**({by: name} if by else {}))

    return walk
