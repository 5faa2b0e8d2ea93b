"""Approximate nearest neighbours: inverted file, product quantization, hyperplane hashing, small-world graphs.

Centres and code books are fitted on at most ``SAMPLE`` vectors; every vector is
indexed. Searches end with exact scores, so results are a subset of the exact
order. Codes and graphs can be stored and opened again.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import shard
from .vectors import FEW, MEASURES, Best, knn, passes, top_k

#: Vectors on which centres and codebooks are fitted, at most.
SAMPLE = 20_000


def sample(base: DataFrame, limit: int = SAMPLE) -> np.ndarray:
    """Vectors in the order of a hash of their ids; the same for every run."""
    rows = base.orderBy(F.xxhash64(F.lit(17), "vec_id")).limit(limit).select("embedding").toPandas()
    return np.array(rows["embedding"].tolist(), np.float32)


def centres(data: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's algorithm, started by k-means++."""
    rng = np.random.default_rng(seed)
    out = data[rng.integers(len(data))][None, :]
    while len(out) < min(k, len(data)):
        new = ((data - out[-1]) ** 2).sum(1)
        far = new if len(out) == 1 else np.minimum(far, new)
        out = np.vstack((out, data[rng.choice(len(data), p=far / far.sum())] if far.sum() > 0 else data[rng.integers(len(data))]))
    for _ in range(rounds):
        mine = _distances(data, out).argmin(1)
        order = np.argsort(mine, kind="stable")
        filled, first = np.unique(mine[order], return_index=True)
        out[filled] = np.add.reduceat(data[order], first) / np.diff(np.append(first, len(data)))[:, None]
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def _matrix(batch: pd.DataFrame) -> np.ndarray:
    return np.array(batch["embedding"].tolist(), np.float32)


def _exact(candidates: DataFrame, base: DataFrame, queries: DataFrame, k: int, measure: str = "l2") -> DataFrame:
    """The k best of candidate pairs (query_id, vec_id). Only pairs of ids met before; each vector joins them once."""
    f, ascending = MEASURES[measure]
    wanted = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("__q"))
    pairs = candidates.where(F.col("vec_id") != F.col("query_id")).join(base.select("vec_id", "embedding"), "vec_id").join(wanted, "query_id")
    return top_k(pairs.select("query_id", "vec_id", F.round(f(F.col("embedding"), F.col("__q")), 9).alias("score")), k, ascending)


class Ivf:
    """Cells around centres, about the square root of the vectors' number of them; a search looks into the cells nearest to the query."""

    def __init__(self, base: DataFrame, cells: int | None = None):
        self.base, self.centres = base, centres(sample(base), cells or max(1, math.isqrt(base.count())))
        self.cells = self._nearest(base, 1).select("vec_id", F.col("cells")[0].alias("cell"))

    def _nearest(self, rows: DataFrame, n: int) -> DataFrame:
        sent = rows.sparkSession.sparkContext.broadcast(self.centres)

        def nearest(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    order = np.argsort(_distances(_matrix(batch), sent.value), axis=1, kind="stable")[:, :n]
                    yield pd.DataFrame({"vec_id": batch["vec_id"], "cells": list(order.astype(np.int32))})

        return rows.select("vec_id", "embedding").mapInPandas(nearest, "vec_id long, cells array<int>")

    def search(self, queries: DataFrame, k: int, probes: int = 4, measure: str = "l2") -> DataFrame:
        wanted = self._nearest(queries, probes).select(F.col("vec_id").alias("query_id"), F.explode("cells").alias("cell"))
        return _exact(self.cells.join(wanted, "cell").select("query_id", "vec_id"), self.base, queries, k, measure)


class Pq:
    """Codes of sub-vectors in a table that may be stored and opened again; distances by table look-up, the best ``rerank`` scored exactly."""

    def __init__(self, base: DataFrame, parts: int = 16, codes: int = 256, books: list[np.ndarray] | None = None, coded: DataFrame | None = None):
        self.base, self.books = base, books or [centres(x, codes) for x in np.split(sample(base), parts, axis=1)]
        self.coded = coded if coded is not None else self._encode()

    def _encode(self) -> DataFrame:
        books = self.books

        def encode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    split = np.split(_matrix(batch), len(books), axis=1)
                    codes = np.stack([_distances(x, b).argmin(1) for x, b in zip(split, books, strict=True)], axis=1)
                    yield pd.DataFrame({"vec_id": batch["vec_id"], "codes": [c.tobytes() for c in codes.astype(np.uint8)]})

        return self.base.select("vec_id", "embedding").mapInPandas(encode, "vec_id long, codes binary")

    def save(self, path: str) -> None:
        """Codes and code books as tables: 16 bytes for each vector, and the books."""
        spark = self.base.sparkSession
        self.coded.write.parquet(f"{path}/codes")
        spark.createDataFrame([(i, b.tolist()) for i, b in enumerate(self.books)], "part int, book array<array<float>>").coalesce(1).write.parquet(f"{path}/books")

    @classmethod
    def open(cls, spark: SparkSession, path: str, base: DataFrame) -> Pq:
        rows = sorted(spark.read.parquet(f"{path}/books").collect())  # one row per part
        return cls(base, books=[np.array(r["book"], np.float32) for r in rows], coded=spark.read.parquet(f"{path}/codes"))

    def search(self, queries: DataFrame, k: int, rerank: int | None = None) -> DataFrame:
        """``rerank``: how many times k vectors are scored exactly. It grows with the square root of the table, as near codes become more."""
        books, most = self.books, k * (rerank or math.ceil(5 * max(1.0, math.sqrt(self.coded.count() / 1000))))
        out = None
        for sent in passes(queries):
            found = self.coded.mapInPandas(_by_codes(sent, books, most), "query_id long, vec_id long, score double")
            out = found if out is None else out.unionByName(found)
        return _exact(top_k(out, most, True).select("query_id", "vec_id"), self.base, queries, k)


def _by_codes(sent, books: list[np.ndarray], most: int):
    """The function for partitions of codes: ``most`` vectors for each query, by distances between it and the code books' entries."""

    def rough(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, wanted = sent.value
        best = Best(len(ids), most, True)
        tables = [_distances(x, b) for x, b in zip(np.split(wanted, len(books), axis=1), books, strict=True)] if len(ids) else []
        for batch in batches:
            if len(batch) and len(ids):
                batch = batch.sort_values("vec_id", kind="stable")
                own, codes = batch["vec_id"].to_numpy(np.int64), np.frombuffer(b"".join(batch["codes"]), np.uint8).reshape(len(batch), -1)
                for at in range(0, len(ids), FEW):
                    few = slice(at, at + FEW)
                    found = sum(t[few][:, c] for t, c in zip(tables, codes.T, strict=True)).astype(np.float64)
                    found[ids[few, None] == own[None, :]] = np.inf
                    best.add(few, found, own)
        yield best.frame(ids)

    return rough


class Lsh:
    """Tables of hyperplane signs; vectors that share a table's signs with the query are candidates. Only ids and signs are shuffled to find them."""

    def __init__(self, base: DataFrame, size: int, tables: int = 24, bits: int = 4, seed: int = 9):
        self.base, self.planes = base, np.random.default_rng(seed).normal(size=(size, tables, bits))
        self.coded = self._codes(base)

    def _codes(self, rows: DataFrame) -> DataFrame:
        planes, powers = self.planes, 1 << np.arange(self.planes.shape[2])

        def sign(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    side = np.tensordot(_matrix(batch).astype(np.float64), planes, 1) > 0
                    yield pd.DataFrame({"vec_id": batch["vec_id"], "codes": list((side * powers).sum(2).astype(np.int32))})

        found = rows.select("vec_id", "embedding").mapInPandas(sign, "vec_id long, codes array<int>")
        return found.select("vec_id", F.posexplode("codes").alias("table", "code"))

    def search(self, queries: DataFrame, k: int, measure: str = "l2") -> DataFrame:
        wanted = self._codes(queries).select(F.col("vec_id").alias("query_id"), "table", "code")
        return _exact(self.coded.join(wanted, ["table", "code"]).select("query_id", "vec_id").distinct(), self.base, queries, k, measure)


#: Vectors of one small-world graph: a task builds it from their exact neighbours, in blocks of matrix products.
PER_GRAPH = 20_000


class Graph:
    """A layered small-world graph over some vectors, in memory.

    Layers are drawn as usual, each node's top layer from an exponential distribution. Instead of inserting nodes one by one, each layer takes the
    exact nearest neighbours of its nodes, thins them to such in different directions, and adds the links back.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, tops: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        #: Of each layer, where a node's neighbours begin, and the neighbours.
        self.ids, self.vectors, self.tops, self.layers, self.scored = ids, vectors, tops, layers, 0

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, m: int = 16, seed: int = 3) -> Graph:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order], np.float32)
        tops = (-np.log(1 - np.random.default_rng(seed).random(len(ids))) / math.log(m)).astype(np.int64)
        layers = []
        for layer in range(int(tops.max(initial=0)) + 1):
            nodes = np.flatnonzero(tops >= layer)
            layers.append(cls._links(vectors, nodes, m))
        return cls(ids, vectors, tops, layers)

    @staticmethod
    def _links(vectors: np.ndarray, nodes: np.ndarray, m: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
        n, wide = len(nodes), min(2 * m, len(nodes) - 1)
        starts = np.zeros(len(vectors) + 1, np.int64)
        if wide < 1:
            return starts, np.zeros(0, np.int32)
        data = vectors[nodes]
        a, b, d = [], [], []
        for at in range(0, n, block):
            far = _distances(data[at : at + block], data)
            far[np.arange(len(far)), np.arange(at, at + len(far))] = np.inf
            near = np.argpartition(far, wide - 1, axis=1)[:, :wide]
            dist = np.take_along_axis(far, near, 1)
            order = np.lexsort((near, dist), axis=1)
            near, dist = np.take_along_axis(near, order, 1), np.take_along_axis(dist, order, 1)
            found = data[near]
            square = (found * found).sum(2)
            apart = square[:, :, None] + square[:, None, :] - 2 * found @ found.transpose(0, 2, 1)
            kept = np.zeros(near.shape, bool)
            for j in range(wide):  # one is taken if it is nearer to the node than to those taken
                kept[:, j] = ~(kept & (apart[:, j] < dist[:, j, None])).any(1)
            rank = np.where(kept, 0, wide) + np.arange(wide)  # then the nearest others
            chosen = np.argsort(rank, axis=1)[:, :m]
            a.append(np.repeat(np.arange(at, at + len(far)), chosen.shape[1]))
            b.append(np.take_along_axis(near, chosen, 1).ravel())
            d.append(np.take_along_axis(dist, chosen, 1).ravel())
        a, b, d = np.concatenate(a), np.concatenate(b), np.concatenate(d)
        a, b, d = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((d, d))
        order = np.lexsort((b, d, a))
        a, b = a[order], b[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        a, b = a[new], b[new]
        first = np.searchsorted(a, np.arange(n))
        few = np.arange(len(a)) - first[a] < 2 * m
        a, b = a[few], b[few]
        starts[1:] = np.cumsum(np.bincount(nodes[a], minlength=len(vectors)))
        return starts, nodes[b].astype(np.int32)

    def _walk(self, q: np.ndarray, starts: list[int], ef: int, layer: int) -> list[tuple[float, int]]:
        begins, links = self.layers[layer]
        seen = np.zeros(len(self.ids), bool)
        seen[starts] = True
        far = ((self.vectors[starts] - q) ** 2).sum(1)
        self.scored += len(starts)
        near = sorted(zip(far.tolist(), starts, strict=True))
        best = [(-d, n) for d, n in near]
        heapq.heapify(best)
        while near:
            d, node = heapq.heappop(near)
            if len(best) >= ef and d > -best[0][0]:
                break
            new = links[begins[node] : begins[node + 1]]
            new = new[~seen[new]]
            if not len(new):
                continue
            seen[new] = True
            far = self.vectors[new] - q
            far = np.einsum("ij,ij->i", far, far)
            self.scored += len(new)
            if len(best) >= ef:
                good = far < -best[0][0]
                far, new = far[good], new[good]
            for e, n in zip(far.tolist(), new.tolist(), strict=True):
                if len(best) < ef or e < -best[0][0]:
                    heapq.heappush(near, (e, n))
                    heapq.heappush(best, (-e, n))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-d, n) for d, n in best)

    def search(self, q: np.ndarray, k: int, ef: int, beam: int = 8) -> list[tuple[float, int]]:
        """The k nearest found; a few ways down are followed, as parts of a layer may not be linked."""
        starts = [int(np.argmax(self.tops))]
        for layer in range(len(self.layers) - 1, 0, -1):
            starts = [n for _, n in self._walk(q, starts, beam, layer)]
        return [(d, int(self.ids[n])) for d, n in self._walk(q, starts, max(ef, k), 0)[:k]]

    def rows(self) -> pd.DataFrame:
        """A row for each node, with its links by layer."""
        links = [[x[b[i] : b[i + 1]].tolist() for b, x in self.layers[: top + 1]] for i, top in enumerate(self.tops.tolist())]
        return pd.DataFrame({"place": np.arange(len(self.ids)), "vec_id": self.ids, "embedding": list(self.vectors), "links": links})

    @classmethod
    def of_rows(cls, rows: pd.DataFrame) -> Graph:
        rows = rows.sort_values("place")
        tops = np.array([len(x) - 1 for x in rows["links"]], np.int64)
        layers = []
        for layer in range(int(tops.max(initial=0)) + 1):
            own = [np.asarray(x[layer], np.int32) if len(x) > layer else np.zeros(0, np.int32) for x in rows["links"]]
            layers.append((np.concatenate(([0], np.cumsum([len(x) for x in own]))), np.concatenate(own)))
        return cls(rows["vec_id"].to_numpy(np.int64), np.array(rows["embedding"].tolist(), np.float32), tops, layers)


class Hnsw:
    """Small-world graphs over shards of the vectors, built once and stored: one row for each vector with its links."""

    ROWS = "shard int, place long, vec_id long, embedding array<float>, links array<array<int>>"

    def __init__(self, graphs: DataFrame):
        self.graphs = graphs

    @classmethod
    def build(cls, base: DataFrame, path: str, per_graph: int = PER_GRAPH, m: int = 16) -> Hnsw:
        """Shards are as many as graphs of ``per_graph`` vectors need, so a task's work and memory don't grow with the table."""
        shards = max(1, -(-base.count() // per_graph))

        def made(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            return Graph.build(part["vec_id"].to_numpy(np.int64), _matrix(part), m).rows().assign(shard=key[0])

        dealt = base.select(F.pmod(F.xxhash64(F.lit(31), "vec_id"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "embedding")
        dealt.groupBy("shard").applyInPandas(made, cls.ROWS).write.partitionBy("shard").parquet(path)
        return cls.open(base.sparkSession, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Hnsw:
        return cls(spark.read.schema(cls.ROWS).parquet(path))

    def search(self, queries: DataFrame, k: int, ef: int = 100) -> DataFrame:
        """Every graph is searched in a task of its own, and the best of all are taken. ``ef`` at least: it grows with the square root of a graph, see ``_in_graph``."""
        out = None
        for sent in passes(queries):
            found = self.graphs.groupBy("shard").applyInPandas(_in_graph(sent, k, ef), "query_id long, vec_id long, score double")
            out = found if out is None else out.unionByName(found)
        return top_k(out.withColumn("score", F.round(F.sqrt("score"), 6)), k, True)


def _in_graph(sent, k: int, ef: int):
    """Most queries aren't nodes of the graph, and are found less easily than nodes, which are linked to their neighbours: the larger the graph, the more ways are followed."""

    def searched(part: pd.DataFrame) -> pd.DataFrame:
        graph = Graph.of_rows(part)
        wide = max(ef, math.ceil(math.sqrt(8 * len(graph.ids))))
        rows = [(q, n, float(d)) for q, v in zip(*sent.value, strict=True) for d, n in graph.search(v, k + 1, wide) if n != q]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    return searched


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that were found."""
    hit = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.agg(F.count("*").alias("wanted"), F.count("hit").alias("found"), (F.count("hit") / F.count("*")).alias("recall"))


def shard_top_k(base: DataFrame, queries: DataFrame, k: int, shards: int, measure: str = "l2") -> DataFrame:
    """Scatter and gather: the k best of each shard, then of all."""
    return knn(base.withColumn("shard", shard(F.col("vec_id").cast("string"), shards)), queries, k, measure, by="shard")
