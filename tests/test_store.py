"""The table: writes, flushes, merges, restarts, snapshots, streams; and the driver's entry points."""

import random
import sys
import time

import pytest
from pyspark.sql import functions as F

from kelpstone.errors import EngineError
from kelpstone.sources import files
from kelpstone.sources.store import KvTable
from kelpstone.streaming import ingest


def test_put_get_delete_across_flushes(spark, tmp_path):
    t = KvTable.open(spark, f"{tmp_path}/t")
    assert not t.flush() and t.get("x") is None
    assert t.write([(1, "apple", b"fruit"), (1, "banana", b"yellow"), (1, "", b""), (2, "ghost", None)]) == 4
    assert t.get("apple") == b"fruit" and t.get("") == b"" and t.get("ghost") is None and t.get("none") is None
    assert t.flush() and t.get("banana") == b"yellow"
    t.delete("apple")
    assert t.get("apple") is None
    t.flush()
    assert t.get("apple") is None and t.manifest.last_flushed_lsn == 5
    again = KvTable.open(spark, f"{tmp_path}/t")
    assert again.get("apple") is None and again.put("n", b"1") == 6
    assert {r.key for r in again.scan().collect()} == {"banana", "", "n"}
    assert {r.key for r in again.scan_with_tombstones().collect()} == {"banana", "", "n", "apple", "ghost"}
    assert {r.key for r in again.range("a", "c").collect()} == {"banana"} and {r.key for r in again.prefix("ba").collect()} == {"banana"}
    with pytest.raises(EngineError):  # another writer was first
        t.put("late", b"x")


def test_merging_keeps_the_newest_and_unflushed_writes(spark, tmp_path):
    t = KvTable.open(spark, f"{tmp_path}/t", levels=2)
    for i in range(4):  # keys in falling order, so that key order and age differ
        t.write([(1, f"k{9 - i}", b"%d" % i), (1, "same", b"%d" % i), *([(2, "k9", None)] if i == 3 else [])])
        t.flush()
    t.put("fresh", b"!")
    assert t.pick_level() == 0
    snapshot = t.scan().cache()
    out = t.compact()
    assert (out["files_read"], out["keys_merged"], out["duplicate_keys_dropped"], out["tombstones_dropped"]) == (4, 9, 4, 1)
    assert {r["level"] for r in t.manifest.runs} == {1} and snapshot.count() == 5
    back = KvTable.open(spark, f"{tmp_path}/t", levels=2)
    assert back.get("same") == b"3" and back.get("k9") is None and back.get("fresh") == b"!"
    with pytest.raises(EngineError):
        back.compact()
    assert back.vacuum(keep=1) and back.get("same") == b"3" and back.get("fresh") == b"!"


def test_runs_are_split_and_pruned(spark, tmp_path):
    t = KvTable.open(spark, f"{tmp_path}/t", levels=2, run_bytes=20_000)
    rnd = random.Random(1)
    for part in range(4):
        t.write([(1, f"key_{i:04d}", rnd.randbytes(100)) for i in range(part, 1200, 4)])
        t.flush()
    out = t.compact()
    runs = sorted(t.manifest.runs, key=lambda r: r["smallest_key"])
    assert out["files_written"] == len(runs) > 4 and all(a["largest_key"] < b["smallest_key"] for a, b in zip(runs, runs[1:]))
    assert (out["keys_merged"], out["duplicate_keys_dropped"], out["tombstones_dropped"]) == (1200, 0, 0)
    assert len(t.entries("key_0003", "key_0003").inputFiles()) == 1 and len(t.prefix("key_000").inputFiles()) == 1 and t.prefix("zzz").isEmpty()
    assert [r.key for r in t.ordered().collect()] == [f"key_{i:04d}" for i in range(1200)] and t.prefix("key_00").count() == 100
    plan = t.range("key_0003", "key_0004")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,key_0003)" in plan


def test_a_flush_is_one_run_of_any_size(spark, tmp_path):
    """Level 0 counts flushes, so a large one must not look like several; its files are pruned all the same."""
    t = KvTable.open(spark, f"{tmp_path}/t", levels=2, run_bytes=20_000)
    rnd = random.Random(2)
    for part in range(4):
        assert not t.needs_compaction()
        t.write([(1, f"key_{i:04d}", rnd.randbytes(100)) for i in range(part, 1200, 4)])
        t.flush()
    t = KvTable.open(spark, f"{tmp_path}/t", levels=2, run_bytes=20_000)
    found = [(r.sequence_number, r.level, r.smallest_key, r.largest_key) for r in t.checkpoint().collect()]
    assert found == [(i + 1, 0, f"key_{i:04d}", f"key_{1196 + i}") for i in range(4)]
    assert len(t.entries().inputFiles()) > 4 == len(t.entries("key_0003", "key_0003").inputFiles()) and t.get("key_0003") is not None
    t.vacuum(keep=1)
    assert t.scan().count() == 1200


def test_a_merge_counts_runs_not_their_files(spark, tmp_path):
    t = KvTable.open(spark, f"{tmp_path}/t", levels=2, run_bytes=20_000)
    rnd = random.Random(2)
    for part in range(4):
        t.write([(1, f"key_{i:04d}", rnd.randbytes(100)) for i in range(part, 1200, 4)])
        t.flush()
    out = t.compact()
    assert (out["files_read"], out["keys_merged"], out["duplicate_keys_dropped"]) == (4, 1200, 0) and out["files_written"] > 1
    assert t.vacuum(keep=1) and t.scan().count() == 1200


def test_a_merge_writes_runs_by_what_is_left(spark, tmp_path):
    """Four versions of a key are read, one is written: what then fits one run is one."""
    t = KvTable.open(spark, f"{tmp_path}/t", levels=2, run_bytes=1_000_000)
    rnd = random.Random(4)
    for _ in range(4):
        t.write([(1, f"key_{i:04d}", rnd.randbytes(1000)) for i in range(600)])
        t.flush()
    out = t.compact()
    assert out["bytes_read"] > 2_000_000 and out["bytes_written"] < 1_000_000
    assert (out["files_read"], out["files_written"], out["keys_merged"], out["duplicate_keys_dropped"]) == (4, 1, 2400, 1800)


def test_runs_follow_from_bytes_not_from_tasks(spark, tmp_path, monkeypatch):
    """However many tasks write, a run has the bytes of one; its files are read and pruned, and one of several runs of a folder can be merged."""
    frame, settings = type(spark.range(0)), {"levels": 3, "run_bytes": 1_000_000}
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, n, *by, f=frame.repartitionByRange: f(self, max(8, n), *by))
    t = KvTable.open(spark, f"{tmp_path}/t", **settings)
    rnd = random.Random(4)
    for part in range(4):
        t.write([(1, f"key_{i:04d}", rnd.randbytes(1000)) for i in range(part, 1200, 4)])
        t.flush()
    out = t.compact()
    assert (out["files_read"], out["files_written"], out["keys_merged"], out["duplicate_keys_dropped"]) == (4, 2, 1200, 0)
    t = KvTable.open(spark, f"{tmp_path}/t", **settings)
    one, two = t.checkpoint().orderBy("smallest_key").collect()
    assert (one.sequence_number, two.sequence_number, t.manifest.next_run) == (5, 6, 7) and one.filepath != two.filepath and max(one.file_size_bytes, two.file_size_bytes) <= 1_000_000
    assert one.smallest_key == "key_0000" and one.largest_key < two.smallest_key and two.largest_key == "key_1199"
    assert len(t.entries().inputFiles()) == 8 and len(t.entries("key_0003", "key_0003").inputFiles()) == 1
    monkeypatch.setattr(t, "pick_level", lambda: 1)
    out = t.compact()
    assert out["files_read"] == 1 and 0 < out["keys_merged"] < 1200 and [r["level"] for r in t.manifest.runs] == [1, 2]
    t.vacuum(keep=1)
    assert t.scan().count() == 1200 and t.get("key_0003") is not None and t.get("key_1199") is not None


def test_filters_are_written_for_keys(spark, tmp_path):
    """A run's file holds a Bloom filter of its keys, which lookups are checked against."""
    import pyarrow.parquet as pq

    t = KvTable.open(spark, f"{tmp_path}/t")
    t.write([(1, f"key_{2 * i:06d}", b"x" * 50) for i in range(3000)])
    t.flush()
    (run,) = t.manifest.runs
    meta = pq.ParquetFile(f"{tmp_path}/t/{run['filepath']}").metadata
    plain = sum(meta.row_group(g).column(c).total_compressed_size for g in range(meta.num_row_groups) for c in range(meta.num_columns))
    assert run["file_size_bytes"] > plain + 1000 and t.get("key_000003") is None and t.get("key_000004") == b"x" * 50


def test_memory_is_measured_only_when_it_could_be_full(spark, tmp_path, monkeypatch):
    measured = []
    t = KvTable.open(spark, f"{tmp_path}/t", memtable_bytes=1000)
    exact = t.memory
    monkeypatch.setattr(t, "memory", lambda: measured.append(exact()) or measured[-1])
    for i in range(4):
        t.put("same", b"v" * 132)  # 200 bytes of one key, again and again
    assert not measured and not t.flushes
    t.put("same", b"v" * 132)
    assert measured == [200] and not t.flushes
    t.write([(1, f"other{i}", b"v" * 130) for i in range(4)])
    assert t.flushes == 1 and t.unflushed().isEmpty()


def test_two_writers_of_one_version(spark, tmp_path):
    """However many write a file at the same time, one does, and the others are told."""
    from concurrent.futures import ThreadPoolExecutor

    def write(i):
        try:
            files.write_text(spark, f"{tmp_path}/m/000001.json", str(i))
            return i
        except FileExistsError:
            return None

    with ThreadPoolExecutor(8) as pool:
        done = [x for x in pool.map(write, range(16)) if x is not None]
    assert len(done) == 1 and files.read_text(spark, f"{tmp_path}/m/000001.json") == str(done[0]) and files.list_names(spark, f"{tmp_path}/m") == ["000001.json"]


def test_a_stream_that_goes_on(spark, tmp_path):
    schema = "seq long, op tinyint, key string, value binary"
    spark.createDataFrame([(1, 1, "a", b"1")], schema).write.parquet(f"{tmp_path}/in")
    t = KvTable.open(spark, f"{tmp_path}/t")
    query = ingest.into_table(ingest.read_files(spark, f"{tmp_path}/in", schema), t, f"{tmp_path}/c", every="200 milliseconds")
    try:
        for value in (b"1", b"2"):
            until = time.time() + 60
            while t.get("a") != value and time.time() < until:
                time.sleep(0.2)
            assert t.get("a") == value
            spark.createDataFrame([(2, 1, "a", b"2")], schema).write.mode("append").parquet(f"{tmp_path}/in")
    finally:
        query.stop()


def test_threshold_flushes(spark, tmp_path):
    with KvTable.open(spark, f"{tmp_path}/t", memtable_bytes=1024) as t:
        t.write([(1, f"vec_{i}", bytes([65 + i % 26]) * 50) for i in range(50)])
        assert t.flushes >= 1 and t.get("vec_0") == b"A" * 50
        t.put("last", b"x")
    assert t.unflushed().isEmpty()


def test_large_batches_are_numbered_without_gaps(spark, tmp_path):
    t = KvTable.open(spark, f"{tmp_path}/t")
    batch = spark.range(1000).repartition(7).select(F.lit(1).alias("op"), F.col("id").cast("string").alias("key"), F.lit(b"v").alias("value"))
    assert t.append(batch) == 1000
    assert t.log().agg(F.min("lsn"), F.max("lsn"), F.count_distinct("lsn")).first() == (1, 1000, 1000)


def test_streams_give_what_batches_give(spark, tmp_path):
    rows = [(i, 2 if i % 5 == 0 else 1, f"k{i % 9}", b"%d" % i) for i in range(60)]
    for part in range(3):
        spark.createDataFrame(rows[20 * part : 20 * part + 20], "seq long, op tinyint, key string, value binary").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = lambda: ingest.read_files(spark, f"{tmp_path}/in", schema, files_per_batch=1)
    t = KvTable.open(spark, f"{tmp_path}/t")
    ingest.into_table(stream(), t, f"{tmp_path}/c").awaitTermination()
    n = t.manifest.next_lsn
    assert t.append(spark.createDataFrame(rows[:1], schema), ("ingest", 0)) == n - 1 == 60  # a batch again is no batch
    live = {}
    for _, op, key, value in rows:
        live.pop(key, None) if op == 2 else live.__setitem__(key, value)
    frame = stream().select("key", "value", F.col("seq").alias("lsn"), (F.col("op") == 2).alias("is_tombstone"))
    found = ingest.run_to_memory(ingest.latest_of_stream(frame), "t_latest").where("not is_tombstone")
    assert {r.key: bytes(r.value) for r in found.collect()} == live


def test_stateful_streams(spark, tmp_path):
    raft = [("a", 1, "candidate", None, None), ("a", 2, "leader", None, None), ("a", 3, "stepdown", 5, "b")]
    spark.createDataFrame(raft, "node string, seq long, kind string, term long, peer string").write.parquet(f"{tmp_path}/raft")
    out = ingest.run_to_memory(ingest.raft_stream(ingest.read_files(spark, f"{tmp_path}/raft", spark.read.parquet(f"{tmp_path}/raft").schema)), "t_raft", "append")
    assert [(r.role, r.term) for r in out.orderBy("seq").collect()] == [("Candidate", 1), ("Leader", 1), ("Follower", 5)]
    clock = [("n", 1, "now", 100, None, None), ("n", 2, "update", 100, 200, 5)]
    spark.createDataFrame(clock, "node string, seq long, kind string, physical long, remote_phys long, remote_logical int").write.parquet(f"{tmp_path}/hlc")
    out = ingest.run_to_memory(ingest.hlc_stream(ingest.read_files(spark, f"{tmp_path}/hlc", spark.read.parquet(f"{tmp_path}/hlc").schema)), "t_hlc", "append")
    assert [(r.phys, r.logical) for r in out.orderBy("seq").collect()] == [(100, 0), (200, 6)]


def test_binary_logs(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a", b"x"), (2, 2, "a", None)], "lsn long, op tinyint, key string, value binary")
    data = b"".join(bytes(r.record) for r in files.encode_log(rows).orderBy("lsn").collect())
    (tmp_path / "log").write_bytes(data + b"torn")
    assert [(r.lsn, r.op, r.key) for r in files.read_log_files(spark, f"{tmp_path}/log").orderBy("lsn").collect()] == [(1, 1, "a"), (2, 2, "a")]


def test_large_binary_logs_are_read_in_parts(spark, tmp_path):
    """No file is loaded whole, and neither line ends nor splits of a file change a byte of it."""
    from kelpstone.functions.codec import encode_record

    rnd = random.Random(3)
    rows = [(i, 1, rnd.choice(("", "\n", "\r\n", "k")) + str(i), rnd.choice((b"", b"\n", b"\r", b"\n\n")) + rnd.randbytes(rnd.randrange(300)) + rnd.choice((b"", b"\n", b"\r\n"))) for i in range(1, 3001)]
    rows[1500] = (1501, 1, "long", b"x" * 200_000)
    records = [encode_record(*r) for r in rows]
    (tmp_path / "log").mkdir()
    for name, data in {
        "whole": b"".join(records), "ended": b"".join(records[:50]) + encode_record(51, 1, "e", b"\n"), "torn": b"".join(records[:20]) + records[20][:-1], "marked": b"\xef\xbb\xbfno log",
        "damaged": b"".join(records[:30]) + b"\0" * 40 + b"".join(records[31:]), "empty": b"",
    }.items():
        (tmp_path / "log" / name).write_bytes(data)
    settings = {"spark.sql.sources.binaryFile.maxLength": "1000", "spark.sql.files.maxPartitionBytes": "5000", "spark.sql.files.openCostInBytes": "100"}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = [(r.lsn, r.op, r.key, bytes(r.value)) for r in files.read_log_files(spark, f"{tmp_path}/log").collect()]
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert sorted(found) == sorted(rows + rows[:50] + [(51, 1, "e", b"\n")] + rows[:20] + rows[:30])
    (tmp_path / "log" / "marked").write_bytes(b"\xef\xbb\xbf\x00 may be a record")
    with pytest.raises(Exception, match="StorageCorruption"):
        files.read_log_files(spark, f"{tmp_path}/log").collect()


def test_entry_points_work_without_the_text_part(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("kelpstone.llm") or n in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import __spark_entry__ as entry

    assert "kv_latest" in entry.queries() and not any(n.startswith("op") for n in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


@pytest.mark.parametrize("name", ["kv_latest", "compaction_stats", "block_index_lookup", "knn_l2", "hlc_now", "hlc_update", "raft_fold", "lru_trace", "bloom_fpr", "table_merged", "table_compaction", "table_recovery", "stream_latest", "ann_recall"])
def test_queries_equal_their_sql(spark, name):
    import os

    import duckdb

    from kelpstone.plans import catalogue

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    db = duckdb.connect()
    for file in os.listdir(sf):
        db.sql(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{sf}/{file}'")
    out = catalogue.QUERIES[name](spark, sf)
    columns = sorted(out.columns)
    told = lambda rows: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    expected = db.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert told(out.select(*columns).collect()) == told(expected)
