"""Ordered folds: hybrid clocks, leader-election histories, cache traces, block packing.

Each fold is one pure step over rows in order, used by ``fold`` here and by the
stateful streams of ``kelpstone.streaming``. A fold's group is a history whose
events depend on one another; histories are dealt out by their key, sorted by
Spark, and walked a batch at a time with the state carried along, so that a
history of any length takes the memory of a batch.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_BYTES, BLOCK_HEADER = 4096, 4
LOGICAL_MAX = 0xFFFF


def fold(rows: DataFrame, by: str, order: str, schema: str, begin: Callable[[Any], Any]) -> DataFrame:
    """``begin`` makes the state of a history from its key: an object with ``feed(rows)`` and ``end()``, which return result rows."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def walk(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = state = None
        for batch in batches:
            out: list[tuple] = []
            keys = batch[by].to_numpy()
            bounds = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(batch)]
            for low, high in zip(bounds, bounds[1:]):
                if low == high:
                    continue
                if state is None or keys[low] != key:
                    out += state.end() if state else []
                    key = keys[low]
                    state = begin(key)
                out += state.feed(batch.iloc[low:high])
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(state.end() if state else [], columns=names)

    return rows.repartition(F.col(by)).sortWithinPartitions(by, order).mapInPandas(walk, schema)


def hlc_now(events: DataFrame, node: str = "node", seq: str = "seq", physical: str = "physical") -> DataFrame:
    """Clock values of purely local events, in closed form: running maximum, and rank among events since it last rose.

    A node may have most of the events, so histories are cut by quantiles of ``seq``. What a stretch takes over from those before it
    (their maximum, and how many events share its first clock time) is computed from one row per stretch, and per clock time in it.
    """
    wanted = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = events.agg(F.percentile_approx(seq, [i / wanted for i in range(1, wanted)] or [0.5], 10 * wanted).alias("at")).first()["at"]
    bounds = F.lit(sorted(set(found or []))).cast("array<bigint>")
    cut = events.withColumn("__part", F.size(F.filter(bounds, lambda b: b <= F.col(seq))))
    before = Window.partitionBy(node).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut.groupBy(node, "__part").agg(F.max(physical).alias("__most")).select(node, "__part", F.greatest(F.max("__most").over(before), F.lit(0)).alias("__carried"))
    local = F.max(physical).over(Window.partitionBy(node, "__part").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0))
    rows = cut.withColumn("__local", local).join(carried, [node, "__part"]).withColumn("phys", F.greatest("__local", "__carried"))
    # Times rise along a history: of a stretch, only the first can have begun in stretches before it.
    earlier = Window.partitionBy(node, "phys").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(node, "__part", "phys").agg(F.count("*").alias("__n")).withColumn("__offset", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
    first = counts.groupBy(node, "__part").agg(F.min("phys").alias("__first"), F.min_by("__offset", "phys").alias("__offset"))
    rank = F.row_number().over(Window.partitionBy(node, "__part", "phys").orderBy(seq)) - 1
    ranked = rows.withColumn("__rank", rank).join(first, [node, "__part"])
    logical = F.col("__rank") + F.when(F.col("phys") == F.col("__first"), F.col("__offset")).otherwise(0)
    return ranked.withColumn("logical", F.when(F.col("phys") == 0, logical + 1).otherwise(logical).cast("int")).select(*events.columns, "phys", "logical")


def hlc_step(state: tuple[int, int], kind: str, now: int, remote: tuple[int, int] | None = None) -> tuple[int, int]:
    """The next clock value after a local event, or after a message with a remote clock value."""
    phys, logical = state
    if kind == "now" or remote is None:
        return (now, 0) if now > phys else (phys, logical + 1)
    top = max(phys, remote[0], now)
    if top == now and now > phys and now > remote[0]:
        return now, 0
    return top, 1 + max(x[1] for x in (state, remote) if x[0] == top)


class _Clock:
    def __init__(self, node):
        self.node, self.state = node, (0, 0)

    def feed(self, rows: pd.DataFrame) -> list[tuple]:
        out = []
        for seq, kind, now, phys, logical in zip(rows["seq"], rows["kind"], rows["physical"], rows["remote_phys"], rows["remote_logical"], strict=True):
            self.state = hlc_step(self.state, kind, int(now), None if pd.isna(phys) else (int(phys), int(logical)))
            out.append((self.node, seq, *self.state))
        return out

    def end(self) -> list[tuple]:
        return []


def hlc_update(events: DataFrame) -> DataFrame:
    """Clock values of local events and received messages, by node in order of seq."""
    return fold(events.select("node", "seq", "kind", "physical", "remote_phys", "remote_logical"), "node", "seq", "node string, seq long, phys long, logical int", _Clock)


class RaftNode:
    """Role, term, vote and known leader of one node."""

    def __init__(self, name: str, role: str = "Follower", term: int = 0, vote: str = "", leader: str = ""):
        self.name, self.role, self.term, self.vote, self.leader = name, role, term, vote, leader

    def apply(self, kind: str, term: int = 0, peer: str = "") -> tuple[str, bool]:
        """(status, whether listeners are told); a refused event changes nothing."""
        before = self.role
        match kind:
            case "candidate" if before != "Leader":
                self.role, self.term, self.vote, self.leader = "Candidate", self.term + 1, self.name, ""
                return "OK", True
            case "leader" if before == "Candidate":
                self.role, self.leader = "Leader", self.name
                return "OK", True
            case "stepdown" if term >= self.term:
                if term > self.term:
                    self.vote = ""
                self.role, self.term, self.leader = "Follower", term, peer
                return "OK", before != "Follower"
            case "vote":
                if self.vote not in ("", peer):
                    return "AlreadyExists", False
                self.vote = peer
                return "OK", False
            case "load":
                self.term, self.vote = term, peer
                return "OK", False
        return "InvalidArgument", False

    def state(self) -> tuple[str, int, str, str]:
        return self.role, self.term, self.vote, self.leader


RAFT_OUT = "node string, seq long, kind string, status string, told boolean, role string, term long, voted_for string, leader_id string"


def raft_rows(node: RaftNode, rows: pd.DataFrame) -> list[tuple]:
    out = []
    for seq, kind, term, peer in zip(rows["seq"], rows["kind"], rows["term"], rows["peer"], strict=True):
        status, told = node.apply(kind, 0 if pd.isna(term) else int(term), peer if isinstance(peer, str) else "")
        out.append((node.name, int(seq), kind, status, told, *node.state()))
    return out


class _Raft:
    def __init__(self, node):
        self.node = RaftNode(node)

    def feed(self, rows: pd.DataFrame) -> list[tuple]:
        return raft_rows(self.node, rows)

    def end(self) -> list[tuple]:
        return []


def raft_history(events: DataFrame) -> DataFrame:
    """The state after each event, by node in order of seq."""
    return fold(events.select("node", "seq", "kind", "term", "peer"), "node", "seq", RAFT_OUT, _Raft)


class LruCache:
    """Least recently used entries up to a capacity in bytes; an entry's size is its key's and its data's."""

    def __init__(self, capacity: int):
        self.capacity, self.used, self.hits, self.misses = capacity, 0, 0, 0
        self.entries: OrderedDict[str, int] = OrderedDict()

    def get(self, key: str) -> bool:
        hit = key in self.entries
        if hit:
            self.entries.move_to_end(key)
        self.hits, self.misses = self.hits + hit, self.misses + (not hit)
        return hit

    def put(self, key: str, size: int) -> int:
        """Entries that had to go."""
        size += len(key.encode())
        if size > self.capacity:
            return 0
        self.used += size - self.entries.pop(key, 0)
        self.entries[key] = size
        gone = 0
        while self.used > self.capacity:
            self.used -= self.entries.popitem(last=False)[1]
            gone += 1
        return gone


class _Cache:
    def __init__(self, shard, capacity: int):
        self.shard, self.cache = shard, LruCache(capacity)

    def feed(self, rows: pd.DataFrame) -> list[tuple]:
        out = []
        for seq, op, key, size in zip(rows["seq"], rows["op"], rows["key"], rows["bytes"], strict=True):
            hit, gone = (self.cache.get(key), 0) if op == "get" else (False, self.cache.put(key, int(size)))
            out.append((self.shard, seq, op, key, hit, gone, self.cache.used))
        return out

    def end(self) -> list[tuple]:
        return []


def lru_trace(ops: DataFrame, capacity: int, shard: str = "shard") -> DataFrame:
    """Hits and evictions of each operation of a trace, one cache for each shard of keys."""
    schema = f"{shard} {ops.schema[shard].dataType.simpleString()}, seq long, op string, key string, hit boolean, evicted int, used long"
    return fold(ops.select(shard, "seq", "op", "key", "bytes"), shard, "seq", schema, lambda name: _Cache(name, capacity))


class Blocks:
    """Packs a run's entries in order: a block is closed when the next entry would exceed it, and holds one entry at least."""

    def __init__(self, run, limit: int = BLOCK_BYTES):
        self.run, self.limit, self.block, self.offset = run, limit, 0, 0
        self.first = self.last = None
        self.used = self.entries = 0

    def end(self) -> list[tuple]:
        """The open block, if there is one."""
        if not self.entries:
            return []
        row = (self.run, self.block, self.first, self.last, self.offset, self.used + BLOCK_HEADER, self.entries)
        self.block, self.offset = self.block + 1, self.offset + self.used + BLOCK_HEADER
        self.used = self.entries = 0
        return [row]

    def feed(self, rows: pd.DataFrame) -> list[tuple]:
        out = []
        for key, size in zip(rows["key"].tolist(), rows["size"].tolist(), strict=True):
            if self.entries and BLOCK_HEADER + self.used + size > self.limit:
                out += self.end()
            if not self.entries:
                self.first = key
            self.last, self.used, self.entries = key, self.used + size, self.entries + 1
        return out


def block_index(entries: DataFrame, run: str = "run", limit: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of each run's sorted entries (key, size): first and last key, offset, bytes, entries."""
    schema = f"{run} {entries.schema[run].dataType.simpleString()}, block int, first_key string, last_key string, block_offset long, block_size long, entries long"
    return fold(entries.select(run, "key", "size"), run, "key", schema, lambda name: Blocks(name, limit))


#: Blocks of a run that are searched together.
CHUNK_BLOCKS = 64


def find_block(keys: DataFrame, index: DataFrame, run: str = "run", key: str = "key") -> DataFrame:
    """For each (run, key) the first block of the run whose last key isn't smaller, or nulls.

    An as-of lookup without a range join: probes and last keys are sorted together, and each probe takes the next index row. A run's index is cut into
    chunks of blocks first (their last keys, some hundreds for a run, are joined to the probes), so that the probes of one run are searched in many tasks.
    """
    fields = [c for c in index.columns if c != run]
    chunk = F.floor(F.col("block") / CHUNK_BLOCKS).cast("int")
    chunked = index.withColumn("__chunk", chunk)
    ends = chunked.groupBy(run, "__chunk").agg(F.max("last_key").alias("__end")).groupBy(run).agg(F.collect_list("__end").alias("__ends"))
    passed = F.coalesce(F.size(F.filter("__ends", lambda e: e < F.col("__at"))), F.lit(-1))
    none = F.lit(None).cast(index.select(F.struct(*fields)).schema[0].dataType).alias("__block")
    probes = keys.select(run, F.col(key).alias("__at")).join(ends, run, "left").select(run, passed.alias("__chunk"), "__at", F.lit(0).alias("__kind"), none)
    known = chunked.select(run, "__chunk", F.col("last_key").alias("__at"), F.lit(1).alias("__kind"), F.struct(*fields).alias("__block"))
    ahead = Window.partitionBy(run, "__chunk").orderBy("__at", "__kind").rowsBetween(0, Window.unboundedFollowing)
    found = probes.unionByName(known).withColumn("__next", F.first("__block", ignorenulls=True).over(ahead))
    return found.where("__kind = 0").select(run, F.col("__at").alias(key), "__next.*")
