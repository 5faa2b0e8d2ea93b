"""Hashes, codecs, strings, configuration, status codes, logs."""

import json
import math
import struct

import pytest
from pyspark.sql import functions as F

from kelpstone import config, errors, logs
from kelpstone.functions import clocks, codec, hashing, text
from kelpstone.operators import bloom, metrics


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(("word", "code"), [("", "cbf29ce484222325"), ("a", "af63dc4c8601ec8c"), ("collection_alpha", "bb3a3d42558527b2"), ("collection_beta", "a0e85a1d97d541d8"), ("doc_7482", "630d8706fa641b47")])
def test_fnv64(spark, word, code):
    r = one(spark, hashing.fnv1a64_hex(F.lit(word)), hashing.shard(F.lit(word), 7))
    assert r[0] == code and r[1] == int(code, 16) % 7


def test_fnv64_of_other_letters(spark):
    h = 14695981039346656037
    for b in "é日本".encode():
        h = (h ^ b) * 1099511628211 % 2**64
    assert one(spark, hashing.fnv1a64_hex(F.lit("é日本")))[0] == f"{h:016x}"


def test_seeded_fnv32_and_crc(spark):
    r = one(spark, *[hashing.fnv1a32(F.lit("key_0"), s) for s in bloom.SEEDS], hashing.crc32(F.lit("123456789")))
    assert list(r) == [695450703, 2232971687, 3421780262]


def test_bloom_sizes():
    assert bloom.bits_for(1000, 10) == 10000 and bloom.bits_for(1, 1) == 64 and bloom.hashes_for(10) == 7 and bloom.hashes_for(100) == 30 and bloom.hashes_for(1) == 1


def test_bloom_filter(spark):
    keys = lambda a, b, name: spark.range(a, b).select(F.concat(F.lit(name), F.col("id").cast("string")).alias("k"))
    words = bloom.build(keys(0, 100, "exists_"), "k", 1000, 7)
    probe = bloom.might_contain(keys(0, 100, "exists_").unionByName(keys(0, 1000, "absent_")), "k", words, 1000, 7)
    found = {r["exists"]: r["n"] for r in probe.where("maybe").groupBy(F.col("k").startswith("exists").alias("exists")).agg(F.count("*").alias("n")).collect()}
    assert found == {True: 100, False: 26}


def test_split_and_trim(spark):
    r = one(spark, *[text.split_on(F.lit(x), ":") for x in ("192.168.1.100:8080", "", "a:", "a::b", ":")], text.trim_blank(F.lit("   raft_leader  \t ")))
    assert list(r) == [["192.168.1.100", "8080"], [], ["a"], ["a", "", "b"], [""], "raft_leader"]


def test_ids_and_names(spark):
    r = one(spark, text.uuid4(), text.short_id(), text.role_name(F.lit(2)), text.role_name(F.lit(9)), text.cache_key(F.lit("p"), F.lit(7)), config.role_column(F.lit("shard")), config.role_column(F.lit("x")))
    assert len(r[0]) == 36 and r[0][14] == "4" and len(r[1]) == 8 and int(r[1], 16) >= 0
    assert list(r)[2:] == ["Leader", "Unknown", "p:7", "shard", "standalone"]


def test_codec():
    out = codec.Writer().u32(42).u64(123456789012345).string("vector_test").floats([0.1, 0.2, 0.3, -0.4]).f32(1.5)
    r = codec.Reader(out.out)
    assert (r.u32(), r.u64(), r.string()) == (42, 123456789012345, "vector_test")
    assert [round(float(x), 6) for x in r.floats()] == [0.1, 0.2, 0.3, -0.4] and r.f32() == 1.5
    with pytest.raises(errors.EngineError) as wrong:
        r.u32()
    assert wrong.value.code == 101


def test_blocks_round_trip():
    rows = [("apple", b"\1\2\3", False), ("banana", b"\4\5", False), ("cherry", b"", True)]
    assert codec.decode_block(codec.encode_block(rows)) == rows


def test_log_records_and_torn_ends():
    rows = [(1, 1, b"vec_0", b"x"), (2, 1, b"", b""), (3, 2, b"\xff\xfe no text", None)]
    data = b"".join(codec.encode_record(*r) for r in rows)
    assert codec.decode_log(data) == rows
    assert codec.decode_log(data + bytes.fromhex("FFDEADBEEF00000042")) == rows
    assert codec.decode_log(data[:-1]) == rows[:2]
    broken = bytearray(data)
    broken[9] ^= 1
    assert codec.decode_log(bytes(broken)) == []
    assert codec.decode_log(struct.pack("<II", codec.MAX_PAYLOAD + 1, 0) + data) == []
    with pytest.raises(errors.EngineError) as wrong:  # a whole record of another type isn't passed over
        codec.decode_log(codec.encode_record(1, 3, "k", None) + data)
    assert wrong.value.name == "StorageCorruption"


def test_records_as_expressions(spark):
    from kelpstone.sources import files

    rows = [(1, 1, b"vec_0", b"x"), (1 << 40, 1, b"", b""), (3, 2, b"\xff\xfe no text", None), (4, 1, "é日".encode(), bytes(range(256)) * 20)]
    made = files.encode_log(spark.createDataFrame(rows, "lsn long, op tinyint, key binary, value binary"))
    records = {r.lsn: bytes(r.record) for r in made.select("lsn", "record").collect()}
    assert records == {r[0]: codec.encode_record(*r) for r in rows}
    back = files.decode_records(made).selectExpr("lsn", "op", "cast(key as binary) key", "value").collect()
    assert sorted((r.lsn, r.op, bytes(r.key), None if r.value is None else bytes(r.value)) for r in back) == sorted(rows)
    for wrong in (b"", records[1][:-1], records[1] + b"x", records[1][:9] + b"\0" + records[1][10:], codec.encode_record(1, 3, "k", None), struct.pack("<II", 21, 5) + b"\1" * 21):
        with pytest.raises(Exception, match="StorageCorruption"):
            files.decode_records(spark.createDataFrame([(wrong,)], "record binary")).collect()


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text('node:\n  node_id: "n1"\n  role: "shard"\nstorage:\n  memtable_size_mb: 128\n  block_cache_mb: 512\nraft:\n  snapshot_threshold: 50000\ncluster:\n  peers: ["a:1", "b:2"]\n')
    c = config.load(str(path))
    assert (c.node.node_id, c.node.role, c.storage.memtable_size_mb, c.storage.block_cache_mb, c.raft.snapshot_threshold, c.raft.election_timeout_ms, len(c.cluster.peers)) == ("n1", "shard", 128, 512, 50000, 300, 2)
    for content, name in (("storage: {}\n", "InvalidArgument"), ("a: [", "InvalidArgument"), (None, "NotFound")):
        if content is None:
            path.unlink()
        else:
            path.write_text(content)
        with pytest.raises(errors.EngineError) as wrong:
            config.load(str(path))
        assert wrong.value.name == name


def test_status_names(spark):
    assert errors.status_codes(spark).count() == 31
    assert list(one(spark, errors.status_name(F.lit(101)), errors.status_name(F.lit(999)))) == ["StorageCorruption", "Unknown Code"]


def test_logs_are_json(tmp_path):
    log = logs.logger("n1", str(tmp_path / "l.log"))
    log.info({"component": "raft", "msg": "Leader elected"})
    [handler.flush() for handler in log.handlers]
    line = json.loads((tmp_path / "l.log").read_text())
    assert line["node_id"] == "n1" and line["level"] == "INFO" and line["data"]["component"] == "raft"


def test_metrics(spark):
    rows = spark.createDataFrame([("c", 1.0, 1), ("c", 1.0, 2), ("g", 3.0, 1), ("g", 15.0, 2)], "name string, value double, ts long")
    assert {r.name: r.value for r in metrics.counters(rows, ["name"]).collect()}["c"] == 2
    assert {r.name: r.value for r in metrics.gauges(rows, ["name"]).collect()}["g"] == 15
    seen = spark.createDataFrame([("h", 3.5), ("h", 12.0), ("h", 2.0)], "name string, value double")
    out = metrics.histogram(seen, ["name"], [1, 5, 10, 50, 100]).collect()
    assert [r.bucket for r in out] == [0, 2, 2, 3, 3, 3] and math.isclose(out[0]["sum"], 17.5) and out[-1].le == "+Inf"
    assert metrics.exposition("x", "counter", "help", [{"labels": {"a": "b"}, "value": 2}]).endswith('x{a="b"} 2\n')


def test_clocks(spark):
    clock = clocks.FakeClock(100)
    clock.sleep(50)
    assert clock.now() == 150 and clocks.PhysicalClock().now() > 10**15
    packed = clocks.pack(F.lit(200), F.lit(6))
    assert list(one(spark, clocks.physical(packed), clocks.logical(packed))) == [200, 6]


def test_jobs_run_in_order_and_raise():
    from kelpstone.plans.jobs import run_all

    assert run_all([lambda i=i: i * i for i in range(8)]) == [i * i for i in range(8)]
    with pytest.raises(ZeroDivisionError):
        run_all([lambda: 1 / 0])
