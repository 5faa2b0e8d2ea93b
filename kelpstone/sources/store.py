"""A versioned key-value table: an append-only log and sorted Parquet runs under one manifest.

Everything that a reader needs is in a manifest: log batches with their first
numbers, the number up to which the log is in runs, and the runs. A manifest
is written as a new file and never changed, so a reader keeps its snapshot;
files that no kept manifest names are removed by ``vacuum`` only.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..model import DELETE, ENTRY, MUTATION, PUT, RUN_META
from ..operators import catalogue as policy
from ..operators import log as logs
from ..operators import merge as merging
from ..operators import versions
from . import files


@dataclass
class Manifest:
    version: int = 0
    next_lsn: int = 1
    next_run: int = 1
    last_flushed_lsn: int = 0
    batches: list[dict] = field(default_factory=list)  # path, first, last, bytes (of all its versions, as in memory)
    held: dict = field(default_factory=lambda: {"lsn": 0, "bytes": 0})  # bytes in memory up to a number, when last measured
    runs: list[dict] = field(default_factory=list)  # RUN_META, entries, and the files of a run that has several (parts)
    streams: dict[str, int] = field(default_factory=dict)  # last batch of each stream


class KvTable:
    def __init__(self, spark: SparkSession, path: str, memtable_bytes: int = 64 << 20, levels: int = policy.LEVELS, run_bytes: int = policy.RUN_BYTES):
        self.spark, self.path, self.memtable_bytes, self.levels = spark, path.rstrip("/"), memtable_bytes, levels
        self.run_bytes, self.flushes = run_bytes, 0
        self.manifest = self._newest()

    @classmethod
    def open(cls, spark: SparkSession, path: str, **settings) -> KvTable:
        return cls(spark, path, **settings)

    def __enter__(self) -> KvTable:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        if not self.unflushed().isEmpty():
            self.flush()

    # The manifest.
    def _newest(self) -> Manifest:
        names = [n for n in files.list_names(self.spark, f"{self.path}/manifests") if n.endswith(".json")]
        if not names:
            return Manifest()
        try:
            return Manifest(**json.loads(files.read_text(self.spark, f"{self.path}/manifests/{names[-1]}")))
        except (ValueError, TypeError) as wrong:
            raise EngineError("StorageCorruption", names[-1]) from wrong

    def _commit(self, **changes) -> None:
        now = Manifest(**{**asdict(self.manifest), **changes, "version": self.manifest.version + 1})
        try:
            files.write_text(self.spark, f"{self.path}/manifests/{now.version:012d}.json", json.dumps(asdict(now)))
        except FileExistsError as other:
            raise EngineError("Aborted", f"version {now.version} was written by another") from other
        self.manifest = now

    def checkpoint(self) -> DataFrame:
        """The catalogue of runs, one row each."""
        columns = [c.split()[0] for c in RUN_META.split(", ")]
        return self.spark.createDataFrame([tuple(r[c] for c in columns) for r in self.manifest.runs], RUN_META)

    # Writing.
    def append(self, batch: DataFrame, stream: tuple[str, int] | None = None) -> int:
        """Logs a batch (op, key, value[, seq]); numbers follow ``seq``, else the order of arrival. Returns the last number.

        ``stream``: (name, batch number) of a stream; a batch that the manifest knows isn't logged again.
        """
        if stream and self.manifest.streams.get(stream[0], -1) >= stream[1]:
            return self.manifest.next_lsn - 1
        name = uuid.uuid4().hex
        staged, final = f"{self.path}/staging/{name}", f"{self.path}/log/{name}"
        rows = batch.orderBy("seq") if "seq" in batch.columns else batch
        rows = rows.select(F.col("op").cast("tinyint").alias("op"), F.col("key"), F.col("value"))
        rows.withColumn("__id", F.monotonically_increasing_id()).write.parquet(staged)
        rows = self.spark.read.parquet(staged)
        part = F.shiftrightunsigned("__id", 33)
        counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum(logs.size_in_memory()).alias("bytes")).collect()  # one row per task that wrote
        starts, at = {}, self.manifest.next_lsn
        for r in sorted(counts):
            starts[r["part"]] = at
            at += r["n"]
        if starts:
            begin = self.spark.createDataFrame(list(starts.items()), "__part long, __start long")
            rows = rows.withColumn("__part", part).join(F.broadcast(begin), "__part")
            rows.select((F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).alias("lsn"), "op", "key", "value").write.parquet(final)
        files.delete(self.spark, staged)
        batches = [*self.manifest.batches, {"path": f"log/{name}", "first": self.manifest.next_lsn, "last": at - 1, "bytes": sum(r["bytes"] for r in counts)}] if starts else self.manifest.batches
        self._commit(next_lsn=at, batches=batches, streams={**self.manifest.streams, **({stream[0]: stream[1]} if stream else {})})
        if self._full():
            self.flush()
        return at - 1

    def _full(self) -> bool:
        """Whether what isn't flushed fills its memory. Bytes of batches are added up; only when they could fill it, newest versions are measured, and that is remembered."""
        held = self.manifest.held if self.manifest.held["lsn"] > self.manifest.last_flushed_lsn else {"lsn": self.manifest.last_flushed_lsn, "bytes": 0}
        if held["bytes"] + sum(b["bytes"] for b in self.manifest.batches if b["last"] > held["lsn"]) < self.memtable_bytes:
            return False
        now = self.memory()
        self.manifest.held = {"lsn": self.manifest.next_lsn - 1, "bytes": now}  # written with the next manifest
        return now >= self.memtable_bytes

    def write(self, mutations: Iterable[tuple[int, str, bytes | None]]) -> int:
        rows = [(i, op, key, None if value is None else bytes(value)) for i, (op, key, value) in enumerate(mutations)]
        return self.append(self.spark.createDataFrame(rows, "seq long, op tinyint, key string, value binary").coalesce(1))

    def put(self, key: str, value: bytes) -> int:
        return self.write([(PUT, key, value)])

    def delete(self, key: str) -> int:
        return self.write([(DELETE, key, None)])

    # Reading.
    def log(self) -> DataFrame:
        return self._read([b["path"] for b in self.manifest.batches], MUTATION)

    def unflushed(self) -> DataFrame:
        return logs.replay(self._read([b["path"] for b in self.manifest.batches if b["last"] > self.manifest.last_flushed_lsn], MUTATION), self.manifest.last_flushed_lsn)

    def memory(self) -> int:
        return logs.memory(self.unflushed()).first()["bytes"]

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in paths])

    def entries(self, low: str | None = None, high: str | None = None) -> DataFrame:
        """All versions in log and runs. Runs whose key range misses [low, high] aren't opened."""
        hit = [r for r in self._files(self.manifest.runs) if (high is None or r["smallest_key"] <= high) and (low is None or r["largest_key"] >= low)]
        return self._versions(hit)

    @staticmethod
    def _files(runs: list[dict]) -> list[dict]:
        """Path and key range of each file of the runs."""
        return [f for r in runs for f in r.get("parts", [r])]

    def _versions(self, runs: list[dict]) -> DataFrame:
        logged = self.unflushed().select("key", "value", (F.col("op") == DELETE).alias("is_tombstone"), F.col("lsn").alias("seq"))
        return logged.unionByName(self._read([r["filepath"] for r in runs], ENTRY))

    def scan(self) -> DataFrame:
        return versions.latest(self.entries())

    def scan_with_tombstones(self) -> DataFrame:
        return versions.newest(self.entries())

    def range(self, low: str, high: str) -> DataFrame:
        return versions.scan_range(self.entries(low, high), low, high)

    def ordered(self) -> DataFrame:
        """Live versions by ascending key."""
        return self.scan().orderBy("key")

    def prefix(self, prefix: str) -> DataFrame:
        """Live versions of keys that begin so. Runs that end before the first such key, or begin after the last, aren't opened."""
        hit = [r for r in self._files(self.manifest.runs) if r["largest_key"] >= prefix and (r["smallest_key"] <= prefix or r["smallest_key"].startswith(prefix))]
        return versions.scan_prefix(self._versions(hit), prefix)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return versions.multi_get(self.entries(), keys)

    def get(self, key: str) -> bytes | None:
        row = versions.get(self.entries(key, key), key).select("value").first()
        return None if row is None else bytes(row["value"])

    # Runs.
    def _write_run(self, entries: DataFrame, level: int, size: int) -> tuple[list[dict], int]:
        """Sorted files of one level, whose ranges don't overlap. ``size``: bytes that the entries may have, which are dealt to files of ``run_bytes``.

        What a flush writes is one run of level 0, however many files it has: its policy counts flushes. On other levels, neighbouring files that
        have at most ``run_bytes`` together are a run: how many there are follows from what was written, not from how many tasks wrote it.
        Returns their metas, which have the path of the first file, and the next run number.
        """
        name = f"runs/L{level}-{self.manifest.next_run:08d}-{uuid.uuid4().hex[:8]}"
        sorted_runs = entries.repartitionByRange(max(1, -(-size // self.run_bytes)), "key").sortWithinPartitions("key").write
        # Filters are sized by what they hold: of ten sizes from 2 KB to 1 MB (of five, the least would be 64 KB, more than a small file's entries).
        filtered = sorted_runs.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.bloom.filter.candidates.number#key", "10")
        filtered.parquet(f"{self.path}/{name}")
        written = self.spark.read.schema(ENTRY).parquet(f"{self.path}/{name}")
        metas = written.groupBy(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n"))
        found: list[dict] = []
        for r in sorted(metas.collect(), key=lambda r: r["low"]):  # one row per file
            file = {"filepath": f"{name}/{r['file']}", "smallest_key": r["low"], "largest_key": r["high"]}
            if found and (level == 0 or found[-1]["file_size_bytes"] + r["bytes"] <= self.run_bytes):
                run = found[-1]
                run.setdefault("parts", [{k: run[k] for k in file}]).append(file)
                run.update(largest_key=r["high"], file_size_bytes=run["file_size_bytes"] + r["bytes"], entries=run["entries"] + r["n"])
            else:
                found.append({**file, "level": level, "file_size_bytes": r["bytes"], "sequence_number": self.manifest.next_run + len(found), "entries": r["n"]})
        return found, self.manifest.next_run + len(found)

    def flush(self) -> bool:
        """Unflushed mutations become a run of level 0; nothing to flush is no error."""
        batch = self.unflushed()
        last = batch.agg(F.max("lsn").alias("last")).first()["last"]
        if last is None:
            return False
        size = sum(b["bytes"] for b in self.manifest.batches if b["last"] > self.manifest.last_flushed_lsn)
        found, number = self._write_run(merging.flush(batch.where(F.col("lsn") <= last)).select("key", "value", "is_tombstone", "seq"), 0, size)
        self._commit(last_flushed_lsn=last, runs=[*self.manifest.runs, *found], next_run=number)
        self.flushes += 1
        return True

    def pick_level(self) -> int:
        return policy.pick_level(self.checkpoint(), self.levels).first()["level"]

    def needs_compaction(self) -> bool:
        return self.pick_level() >= 0

    def compact(self) -> dict:
        """Merges the due level into the next one and returns the counts of the merge. Nothing due: NotFound."""
        began, level = time.time(), self.pick_level()
        if level < 0:
            raise EngineError("NotFound", "no level is due")
        inputs = {r["filepath"] for r in policy.select_files(self.checkpoint(), level).select("filepath").collect()}
        chosen = [r for r in self.manifest.runs if r["filepath"] in inputs]
        bottom = level + 1 == self.levels - 1
        entries = self._read([f["filepath"] for f in self._files(chosen)], ENTRY)
        read, size = sum(r["entries"] for r in chosen), sum(r["file_size_bytes"] for r in chosen)
        found, number = self._write_run(merging.merge(entries, bottom).select("key", "value", "is_tombstone", "seq"), level + 1, size)
        written = sum(r["entries"] for r in found)
        # What is read and written is known from the catalogue. Only at the bottom keys are counted, without their values, for the tombstones that went.
        dropped = merging.merge_stats(entries.drop("value"), bottom).first()["tombstones_dropped"] if bottom else 0
        self._commit(runs=[r for r in self.manifest.runs if r["filepath"] not in inputs] + found, next_run=number)  # what is flushed stays as it was
        return {
            "source_level": level, "target_level": level + 1, "files_read": len(chosen), "files_written": len(found), "bytes_read": size,
            "bytes_written": sum(r["file_size_bytes"] for r in found), "keys_merged": read, "tombstones_dropped": dropped,
            "duplicate_keys_dropped": read - written - dropped, "duration_ms": 1000 * (time.time() - began),
        }

    def compact_while_due(self, most: int = 100) -> list[dict]:
        """Merges until no level is due; ``most`` bounds the rounds."""
        done: list[dict] = []
        while len(done) < most and self.needs_compaction():
            done.append(self.compact())
        return done

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes files that none of the newest ``keep`` manifests names, flushed log batches included."""
        names = [n for n in files.list_names(self.spark, f"{self.path}/manifests") if n.endswith(".json")]
        kept = [Manifest(**json.loads(files.read_text(self.spark, f"{self.path}/manifests/{n}"))) for n in names[-keep:]]
        used = {r["filepath"].split("/")[1] for m in kept for r in m.runs} | {b["path"].split("/")[1] for m in kept for b in m.batches if b["last"] > m.last_flushed_lsn}
        gone = [f"{top}/{n}" for top in ("runs", "log") for n in files.list_names(self.spark, f"{self.path}/{top}") if n not in used]
        self._commit(batches=[b for b in self.manifest.batches if b["path"] not in gone])
        for name in [*gone, *(f"manifests/{n}" for n in names[:-keep])]:
            files.delete(self.spark, f"{self.path}/{name}")
        return gone
