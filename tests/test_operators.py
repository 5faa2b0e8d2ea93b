"""Versions, logs, catalogue, merges and folds on small frames."""

import random

import pytest
from pyspark.sql import functions as F

from kelpstone.errors import EngineError
from kelpstone.model import CACHE_OP, HLC_EVENT, RAFT_EVENT, RUN_META
from kelpstone.operators import ann, catalogue, folds, log, merge, routing, vectors, versions

LOG = "lsn long, op tinyint, key string, value string"


def entries(spark, rows):
    return spark.createDataFrame(rows, LOG).select("key", "value", (F.col("op") == 2).alias("is_tombstone"), F.col("lsn").alias("seq"))


def test_deletes_decide_and_empty_values_live(spark):
    rows = entries(spark, [(1, 1, "a", "x"), (2, 2, "a", None), (3, 1, "b", ""), (4, 2, "c", None), (5, 1, "", "e"), (6, 2, "d", None), (7, 1, "d", "again")])
    assert {r.key: r.value for r in versions.latest(rows).collect()} == {"b": "", "": "e", "d": "again"}
    assert {r.key for r in versions.newest(rows).collect()} == {"a", "b", "c", "", "d"}
    wanted = spark.createDataFrame([("a",), ("b",), ("zz",), ("b",)], "key string")
    assert {r.key: r.value for r in versions.multi_get(rows, wanted).collect()} == {"a": None, "b": "", "zz": None}
    assert {r.key for r in versions.missing(rows, wanted).collect()} == {"a", "zz"}
    assert {r.key for r in versions.scan_range(rows, "b", "d").collect()} == {"b", "d"}
    assert {r.key for r in versions.as_of(rows, 1, order="seq").collect()} == {"a"}


def test_key_predicates_reach_the_scan_and_value_predicates_do_not(spark, tmp_path):
    entries(spark, [(1, 1, "a", "x"), (2, 2, "a", None)]).write.parquet(f"{tmp_path}/e")
    stored = spark.read.parquet(f"{tmp_path}/e")
    plan = versions.get(stored, "a")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,a)" in plan
    plan = versions.latest(stored).where("value = 'x'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(value,x)" not in plan
    assert versions.latest(stored).where("value = 'x'").isEmpty()


def test_split_into_runs_and_merges_changes_nothing(spark):
    """Newest versions are the same however a log is cut into runs and merged."""
    rnd = random.Random(7)
    rows = [(i, rnd.choice((1, 1, 2)), rnd.choice("abcdefgh"), str(i)) for i in range(1, 200)]
    live: dict = {}
    for lsn, op, key, value in rows:
        live.pop(key, None) if op == 2 else live.__setitem__(key, value)
    frame = spark.createDataFrame(rows, LOG)
    for cuts in ([200], [50, 120, 200], [1, 2, 3, 199, 200]):
        runs, low = None, 0
        for high in cuts:
            part = merge.flush(frame.where((F.col("lsn") > low) & (F.col("lsn") <= high)))
            runs, low = part if runs is None else runs.unionByName(part), high
        merged = merge.merge(runs, bottom=False)
        assert {r.key: r.value for r in versions.latest(merged).collect()} == live
        assert {r.key: r.value for r in merge.merge(runs, bottom=True).collect()} == live


def test_merge_counts(spark):
    rows = entries(spark, [(1, 1, "key_001", "1"), (1, 1, "key_003", "3"), (2, 1, "key_001", "99"), (2, 1, "key_002", "2"), (3, 1, "filler_0", "f"), (4, 2, "filler_1", None)])
    r = merge.merge_stats(rows, bottom=True).first()
    assert (r.keys_merged, r.duplicate_keys_dropped, r.tombstones_dropped, r.keys_written) == (6, 1, 1, 4)
    assert {x.key: x.value for x in merge.merge(rows, bottom=True).collect()}["key_001"] == "99"


def test_log_prefix_replay_summary(spark):
    frame = spark.createDataFrame([(i, b"data%d" % i) for i in range(1, 6)], "lsn long, payload binary")
    records = frame.select("lsn", "payload", F.octet_length("payload").alias("length"), (F.crc32("payload") + F.when(F.col("lsn") == 4, 1).otherwise(0)).alias("crc"))
    assert [r.lsn for r in log.valid_prefix(records).orderBy("lsn").collect()] == [1, 2, 3]
    assert log.valid_prefix(records.where("lsn < 4")).count() == 3 and log.valid_prefix(records.limit(0)).isEmpty()
    rows = spark.createDataFrame([(1, 1, "key1", "a"), (2, 1, "key2", "b"), (3, 1, "key3", "c"), (4, 2, "key1", None)], LOG)
    assert log.replay(rows, 2).count() == 2
    assert tuple(log.summary(rows).first()) == (4, 3, 1)


def cat(spark, rows):
    return spark.createDataFrame([(f"f{i}", level, low, high, size, i) for i, (level, low, high, size) in enumerate(rows)], RUN_META)


def test_policy(spark):
    files = cat(spark, [(0, "a", "c", 1)] * 4)
    assert catalogue.pick_level(files).first().level == 0
    assert catalogue.pick_level(cat(spark, [(0, "a", "c", 1)] * 3 + [(1, "a", "b", 10 << 20)])).first().level == -1
    assert catalogue.pick_level(cat(spark, [(1, "a", "b", (10 << 20) + 1)])).first().level == 1
    assert catalogue.pick_level(cat(spark, [(6, "a", "b", 1 << 60)])).first().level == -1
    assert [catalogue.max_bytes(n) for n in (0, 1, 2)] == [0, 10 << 20, 100 << 20]
    rows = cat(spark, [(1, "d", "f", 1), (1, "a", "c", 1), (2, "c", "d", 1), (2, "e", "z", 1), (2, "A", "a", 1)])
    assert {r.filepath for r in catalogue.select_files(rows, 1).collect()} == {"f1", "f2", "f4"}
    with pytest.raises(EngineError):
        catalogue.add_file(rows, cat(spark, [(7, "a", "b", 1)]))
    assert catalogue.remove_files(rows, rows.where("filepath = 'f0'")).count() == 4


def test_blocks(spark):
    rows = [("r", f"key_{i:03d}", 9 + 7 + 2) for i in range(500)]
    index = folds.block_index(spark.createDataFrame(rows, "run string, key string, size long"))
    got = index.orderBy("block").collect()
    assert len(got) == 3 and sum(r.entries for r in got) == 500 and got[0].block_offset == 0
    probes = spark.createDataFrame([("r", "key_000"), ("r", got[0].last_key), ("r", got[1].first_key), ("r", "zzz")], "run string, key string")
    assert {r.key: r.block for r in folds.find_block(probes, index).collect()} == {"key_000": 0, got[0].last_key: 0, got[1].first_key: 1, "zzz": None}
    import pandas as pd

    packer = folds.Blocks("r")
    rows = packer.feed(pd.DataFrame({"key": ["a", "b", "c"], "size": [5000, 10, 10]})) + packer.end()
    assert rows == [("r", 0, "a", "a", 0, 5004, 1), ("r", 1, "b", "c", 5004, 24, 2)]


def test_blocks_are_found_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(folds, "CHUNK_BLOCKS", 3)
    rows = [(r, f"key_{i:04d}", 400) for r in "ab" for i in range(0, 300, 2)]
    index = folds.block_index(spark.createDataFrame(rows, "run string, key string, size long")).cache()
    probes = [(r, f"key_{i:04d}") for r in "abc" for i in range(0, 310, 3)]
    out = {(r.run, r.key): r.block for r in folds.find_block(spark.createDataFrame(probes, "run string, key string"), index).collect()}
    known = index.collect()
    assert len(known) > 20 and out == {(r, k): min((x.block for x in known if x.run == r and x.last_key >= k), default=None) for r, k in probes}


def test_folds_carry_their_state_over_batches(spark):
    """Histories longer than a batch, and many in one partition, give what a walk over all rows gives."""
    rnd = random.Random(3)
    rows = [(f"n{i % 3}", i, rnd.choice(["now", "update"]), rnd.randint(0, 300), rnd.randint(0, 300), rnd.randint(0, 3)) for i in range(900)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        out = {(r.node, r.seq): (r.phys, r.logical) for r in folds.hlc_update(spark.createDataFrame(rows, HLC_EVENT).repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    state = {}
    for node, seq, kind, now, phys, logical in rows:
        state[node] = folds.hlc_step(state.get(node, (0, 0)), kind, now, (phys, logical))
        assert out[(node, seq)] == state[node]


def test_hlc(spark):
    rows = [("n", 1, "now", 100, None, None), ("n", 2, "now", 100, None, None), ("n", 3, "now", 150, None, None), ("n", 4, "update", 150, 200, 5), ("n", 5, "update", 150, 200, 9), ("n", 6, "update", 900, 3, 9)]
    out = folds.hlc_update(spark.createDataFrame(rows, HLC_EVENT)).orderBy("seq").collect()
    assert [(r.phys, r.logical) for r in out] == [(100, 0), (100, 1), (150, 0), (200, 6), (200, 10), (900, 0)]
    local = spark.createDataFrame([("n", i, p) for i, p in enumerate([0, 0, 5, 4, 5, 9])], "node string, seq long, physical long")
    closed = [(r.phys, r.logical) for r in folds.hlc_now(local).orderBy("seq").collect()]
    state, want = (0, 0), []
    for p in [0, 0, 5, 4, 5, 9]:
        state = folds.hlc_step(state, "now", p)
        want.append(state)
    assert closed == want


def test_raft():
    n = folds.RaftNode("n1")
    assert n.apply("leader") == ("InvalidArgument", False) and n.state() == ("Follower", 0, "", "")
    assert n.apply("candidate") == ("OK", True) and n.state() == ("Candidate", 1, "n1", "")
    assert n.apply("candidate") == ("OK", True) and n.term == 2
    assert n.apply("leader") == ("OK", True) and n.leader == "n1"
    assert n.apply("candidate") == ("InvalidArgument", False)
    assert n.apply("stepdown", 1) == ("InvalidArgument", False) and n.role == "Leader"
    assert n.apply("stepdown", 2, "n9") == ("OK", True) and n.state() == ("Follower", 2, "n1", "n9")
    assert n.apply("vote", 0, "n2") == ("AlreadyExists", False) and n.apply("stepdown", 5) == ("OK", False) and n.vote == ""
    assert n.apply("vote", 0, "n2") == ("OK", False) and n.apply("vote", 0, "n2") == ("OK", False)
    assert n.apply("load", 9, "n4") == ("OK", False) and n.state() == ("Follower", 9, "n4", "")


def test_raft_history_and_leaders(spark):
    rows = [("a", 1, "candidate", None, None), ("a", 2, "leader", None, None), ("b", 1, "candidate", None, None), ("b", 2, "leader", None, None)]
    history = folds.raft_history(spark.createDataFrame(rows, RAFT_EVENT))
    assert [tuple(r) for r in routing.double_leaders(history).collect()] == [(1, 2)]
    matches = spark.createDataFrame([(1, 5), (1, 9), (1, 7)], "term long, match_index long")
    assert routing.commit_index(matches).first().commit_index == 7


def test_lru(spark):
    cache = folds.LruCache(1 << 20)
    for key in ("b1", "b2"):
        cache.put(key, 500_000)
    assert cache.get("b2") and cache.get("b1") and cache.put("b3", 500_000) == 1
    assert not cache.get("b2") and cache.get("b1") and cache.get("b3") and (cache.hits, cache.misses) == (4, 1)
    assert cache.put("huge", 2 << 20) == 0 and not cache.get("huge")
    ops = spark.createDataFrame([(1, "put", "k", 4096), (2, "get", "k", 0), (3, "get", "no", 0)], CACHE_OP).withColumn("shard", F.lit(0))
    assert [r.hit for r in folds.lru_trace(ops, 1 << 20).orderBy("seq").collect()] == [False, True, False]


def test_search(spark, tmp_path):
    import numpy as np

    data = np.random.default_rng(0).normal(size=(300, 16)).astype("float32")
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    wanted = base.where("vec_id < 10")
    exact = vectors.knn(base, wanted, 5).cache()
    order = np.argsort(((data[3] - data) ** 2).sum(1))[1:6]
    assert [r.vec_id for r in exact.where("query_id = 3").orderBy("rank").collect()] == order.tolist()
    for measure in vectors.MEASURES:
        a, b = vectors.knn_expressions(base, wanted, 5, measure, 6), vectors.knn_batched(base, wanted, 5, measure, 6)
        assert a.select("query_id", "vec_id").exceptAll(b.select("query_id", "vec_id")).isEmpty()
    ann.Pq(base, 4, 16).save(f"{tmp_path}/pq")
    graphs = ann.Hnsw.build(base, f"{tmp_path}/hnsw", per_graph=160)
    assert graphs.graphs.select("shard").distinct().count() == 2 and graphs.graphs.count() == 300
    found = {
        "ivf": ann.Ivf(base, 8).search(wanted, 5, 6), "pq": ann.Pq.open(spark, f"{tmp_path}/pq", base).search(wanted, 5, 20), "lsh": ann.Lsh(base, 16).search(wanted, 5),
        "hnsw": ann.Hnsw.open(spark, f"{tmp_path}/hnsw").search(wanted, 5), "shards": ann.shard_top_k(base, wanted, 5, 3),
    }
    for name, out in found.items():
        assert ann.recall(out, exact).first().recall >= (1 if name == "shards" else 0.9), name


def test_graphs_are_found_from_outside():
    """Queries that aren't nodes, as in all graphs but one when a table has several."""
    from types import SimpleNamespace

    import numpy as np

    rng, n = np.random.default_rng(4), 12_000
    data = rng.normal(size=(n + 60, 64)).astype(np.float32)
    data /= np.linalg.norm(data, axis=1)[:, None]
    wanted, ids = data[n:], np.arange(n)
    found = ann._in_graph(SimpleNamespace(value=(np.arange(n, n + 60), wanted)), 10, 100)(ann.Graph.build(ids, data[:n]).rows())
    exact = np.argsort(((wanted[:, None] - data[None, :n]) ** 2).sum(2), axis=1)[:, :10]
    hits = [len(set(exact[q - n]) & set(part.nsmallest(10, "score")["vec_id"])) for q, part in found.groupby("query_id")]
    assert sum(hits) >= 0.92 * 600


def test_searches_in_several_passes(spark, monkeypatch):
    """More queries than go with one reading give the same; ties go to the smaller id, a vector never meets itself."""
    import numpy as np

    rng = np.random.default_rng(2)
    data = rng.integers(0, 3, size=(200, 4)).astype("float32")
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>").repartition(5)
    monkeypatch.setattr(vectors, "PASS", 40)
    monkeypatch.setattr(vectors, "FEW", 16)
    out = {(r.query_id, r["rank"]): r.vec_id for r in vectors.knn(base, base, 6).collect()}
    far = np.sqrt(((data[:, None] - data[None]) ** 2).sum(2))
    far[np.arange(200), np.arange(200)] = np.inf
    order = np.lexsort((np.broadcast_to(np.arange(200), far.shape), np.round(far, 9)), axis=1)
    assert out == {(i, r + 1): int(order[i, r]) for i in range(200) for r in range(6)}
    assert vectors.knn(base, base.limit(0), 3).isEmpty() and vectors.knn(base.limit(0), base, 3).isEmpty()
