"""All queries of the engine by name, and the SQL that states the same results.

The event table is read as a mutation log: key = user_id, lsn = event_id, an
"error" event is a delete, anything else a put of its value. Runs are the log
cut in four by event_id. Names of advertised-only features begin with knn,
ivf, pq, lsh, hnsw, shard or route.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import errors
from ..config import role_column
from ..functions import clocks, codec, hashing, text
from ..model import MERGE_STATS
from ..operators import ann, bloom, catalogue, folds, log, merge, metrics, routing, vectors, versions
from ..sources import files, scratch
from ..sources.store import KvTable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, value, payload (bytes of different length, of puts), is_tombstone, seq, op, lsn of the event table."""
    e = _table(spark, sf_dir, "events")
    dead = F.col("event_type") == "error"
    payload = F.concat("props", F.expr("repeat('x', cast(event_id * 37 % 300 as int))")).cast("binary")
    return e.select(
        F.col("user_id").alias("key"), "value", F.when(~dead, payload).alias("payload"), dead.alias("is_tombstone"), F.col("event_id").alias("seq"),
        F.when(dead, 2).otherwise(1).cast("tinyint").alias("op"), F.col("event_id").alias("lsn"),
    )


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of four flushed runs: the newest version of each key in each quarter of the log."""
    rows = event_log(spark, sf_dir)
    quarter = rows.agg((F.floor((F.max("lsn") + 4) / 4)).alias("__q"))
    cut = rows.join(F.broadcast(quarter)).withColumn("run", F.floor(F.col("lsn") / F.col("__q")).cast("long"))
    return cut.groupBy("run", "key").agg(F.max_by("value", "lsn").alias("value"), F.max_by("payload", "lsn").alias("payload"), F.max_by("is_tombstone", "lsn").alias("is_tombstone"), F.max("lsn").alias("seq"))


_LOG = "log AS (SELECT user_id AS key, value, CASE WHEN event_type <> 'error' THEN props || repeat('x', (event_id * 37 % 300)::INT) END AS payload, event_type = 'error' AS is_tombstone, event_id AS seq FROM events)"
_NEWEST = f"WITH {_LOG}, newest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"
_RUNS = f"""WITH {_LOG}, cut AS (SELECT *, seq // ((SELECT max(seq) + 4 FROM log) // 4) AS run FROM log),
runs AS (SELECT run, key, value, payload, is_tombstone, seq FROM cut QUALIFY row_number() OVER (PARTITION BY run, key ORDER BY seq DESC) = 1)"""


# Versions.
@query(f"{_NEWEST} SELECT key, value FROM newest WHERE NOT is_tombstone")
def kv_latest(spark, sf_dir):
    return versions.latest(event_log(spark, sf_dir), columns=["value"])


@query(f"{_NEWEST} SELECT key, value FROM newest WHERE NOT is_tombstone AND key = 42")
def kv_get(spark, sf_dir):
    return versions.get(event_log(spark, sf_dir), 42).select("key", "value")


@query(f"{_NEWEST} SELECT c_custkey AS key, value FROM customer LEFT JOIN (SELECT * FROM newest WHERE NOT is_tombstone) ON c_custkey = key")
def kv_multi_get(spark, sf_dir):
    keys = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return versions.multi_get(event_log(spark, sf_dir), keys).select("key", "value")


@query(f"{_NEWEST} SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT key FROM newest WHERE NOT is_tombstone)")
def kv_missing(spark, sf_dir):
    return versions.missing(event_log(spark, sf_dir), _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")))


@query(f"{_NEWEST} SELECT key, value FROM newest WHERE NOT is_tombstone AND key BETWEEN 10 AND 60")
def kv_scan_range(spark, sf_dir):
    return versions.scan_range(event_log(spark, sf_dir), 10, 60).select("key", "value")


@query(f"{_NEWEST} SELECT key::VARCHAR AS key, value FROM newest WHERE NOT is_tombstone AND key::VARCHAR LIKE '1%'")
def kv_scan_prefix(spark, sf_dir):
    return versions.scan_prefix(event_log(spark, sf_dir).withColumn("key", F.col("key").cast("string")), "1").select("key", "value")


@query(f"{_NEWEST} SELECT key, value, is_tombstone, seq FROM newest")
def kv_scan_with_tombstones(spark, sf_dir):
    return versions.newest(event_log(spark, sf_dir), columns=["value", "is_tombstone", "seq"])


@query(f"WITH {_LOG} SELECT key, value FROM (SELECT * FROM log WHERE seq <= 500 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE NOT is_tombstone")
def kv_as_of_lsn(spark, sf_dir):
    return versions.as_of(event_log(spark, sf_dir), 500).select("key", "value")


# The log.
@query("SELECT max(event_id) AS max_lsn, count_if(event_type <> 'error')::BIGINT AS puts, count_if(event_type = 'error')::BIGINT AS deletes FROM events")
def wal_summary(spark, sf_dir):
    return log.summary(event_log(spark, sf_dir))


@query("SELECT event_id AS lsn, event_type FROM events WHERE event_id < 700")
def wal_valid_prefix(spark, sf_dir):
    e = _table(spark, sf_dir, "events").withColumn("payload", F.concat_ws("|", "event_type", "props").cast("binary"))
    damaged = F.col("event_id").isin(700, 900)
    records = e.select(F.col("event_id").alias("lsn"), "event_type", "payload", F.octet_length("payload").alias("length"), (F.crc32("payload") + damaged.cast("long")).alias("crc"))
    return log.valid_prefix(records).select("lsn", "event_type")


@query("SELECT event_id AS lsn, user_id AS key, count(*) OVER () AS applied FROM events WHERE event_id > 800")
def wal_replay_after_lsn(spark, sf_dir):
    rest = log.replay(event_log(spark, sf_dir), 800)
    return rest.select("lsn", "key").join(F.broadcast(rest.agg(F.count("*").alias("applied"))))


@query(f"{_NEWEST} SELECT sum(strlen(key::VARCHAR) + coalesce(strlen(payload), 0) + 64)::BIGINT AS bytes FROM newest")
def wal_memory(spark, sf_dir):
    return log.memory(event_log(spark, sf_dir).select("lsn", F.col("key").cast("string").alias("key"), F.col("payload").alias("value")))


@query(f"WITH {_LOG} SELECT seq AS lsn, CASE WHEN is_tombstone THEN 2 ELSE 1 END::TINYINT AS op, key::VARCHAR AS key, payload AS value FROM log")
def wal_codec(spark, sf_dir):
    """All mutations as binary records, and back."""
    rows = event_log(spark, sf_dir).select("lsn", "op", F.col("key").cast("string").alias("key"), F.col("payload").alias("value"))
    back = files.decode_records(files.encode_log(rows))
    return back.select("lsn", "op", "key", F.col("value").cast("string").alias("value"))


@query("""SELECT n_nationkey AS shard, 'node' || n_regionkey AS node, h.status, h.reported FROM nation
LEFT JOIN (SELECT 'node' || (user_id % 4) AS node, arg_max(event_type, event_id) AS status, max(event_id) AS reported FROM events GROUP BY 1) h ON h.node = 'node' || n_regionkey""")
def cluster_topology(spark, sf_dir):
    node = lambda c: F.concat(F.lit("node"), c.cast("string"))
    shards = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("shard"), node(F.col("n_regionkey")).alias("node"))
    health = _table(spark, sf_dir, "events").select(node(F.pmod("user_id", F.lit(4))).alias("node"), F.col("event_type").alias("status"), F.col("event_id").alias("ts"))
    return routing.topology(shards, health).select("shard", "node", "status", "reported")


# Runs, merges, catalogue.
@query(f"{_RUNS} SELECT run, key, value, is_tombstone, seq FROM runs")
def flush_runs(spark, sf_dir):
    return event_runs(spark, sf_dir).select("run", "key", "value", "is_tombstone", "seq")


_SIZED = "SELECT run, lpad(key::VARCHAR, 8, '0') AS key, 9 + 8 + coalesce(strlen(payload), 0) AS size FROM runs"


@query(f"{_RUNS}, e AS ({_SIZED}) SELECT run, min(key) AS smallest_key, max(key) AS largest_key, count(*) AS entries, sum(size)::BIGINT AS encoded_bytes FROM e GROUP BY run")
def sst_meta(spark, sf_dir):
    return merge.run_meta(_named_runs(spark, sf_dir))


def _named_runs(spark, sf_dir):
    """The runs' entries with keys as strings of eight digits, and their payloads."""
    return event_runs(spark, sf_dir).select("run", F.lpad(F.col("key").cast("string"), 8, "0").alias("key"), F.col("payload").alias("value"))


@query(f"{_RUNS} SELECT key, value, is_tombstone FROM runs QUALIFY row_number() OVER (PARTITION BY key ORDER BY run DESC) = 1")
def compact_mid(spark, sf_dir):
    return merge.merge(event_runs(spark, sf_dir), bottom=False, order="run").select("key", "value", "is_tombstone")


@query(f"{_RUNS} SELECT key, value FROM (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY key ORDER BY run DESC) = 1) WHERE NOT is_tombstone")
def compact_bottom(spark, sf_dir):
    return merge.merge(event_runs(spark, sf_dir), bottom=True, order="run").select("key", "value")


@query(f"""{_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY run DESC) AS n FROM runs)
SELECT count(*) AS keys_merged, count_if(n > 1)::BIGINT AS duplicate_keys_dropped, count_if(n = 1 AND is_tombstone)::BIGINT AS tombstones_dropped,
  count_if(n = 1 AND NOT is_tombstone)::BIGINT AS keys_written FROM r""")
def compaction_stats(spark, sf_dir):
    return merge.merge_stats(event_runs(spark, sf_dir), bottom=True, order="run")


def run_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue with a row for each supplier: levels 0 to 3 by key, key ranges from names, sizes from balances."""
    s = _table(spark, sf_dir, "supplier")
    return s.select(
        F.concat(F.lit("run"), F.col("s_suppkey").cast("string")).alias("filepath"), F.pmod("s_suppkey", F.lit(4)).cast("int").alias("level"), F.col("s_name").alias("smallest_key"),
        F.concat(F.substring("s_name", 1, 17), F.lit("9")).alias("largest_key"), F.floor(F.abs("s_acctbal") * 1000).cast("long").alias("file_size_bytes"), F.col("s_suppkey").alias("sequence_number"),
    )


_CAT = """WITH cat AS (SELECT 'run' || s_suppkey AS filepath, (s_suppkey % 4)::INT AS level, s_name AS smallest_key, substr(s_name, 1, 17) || '9' AS largest_key,
  floor(abs(s_acctbal) * 1000)::BIGINT AS file_size_bytes, s_suppkey AS sequence_number FROM supplier)"""
_DUE = "CASE WHEN level = 0 THEN files >= 4 ELSE level <= 5 AND bytes > 10485760 * 10 ** (level - 1) END"


@query(f"{_CAT} SELECT level, count(*) AS files, sum(file_size_bytes)::BIGINT AS bytes FROM cat GROUP BY level")
def level_bytes(spark, sf_dir):
    return catalogue.level_bytes(run_catalogue(spark, sf_dir))


@query(f"{_CAT} SELECT coalesce(min(level) FILTER ({_DUE}), -1)::INT AS level FROM (SELECT level, count(*) AS files, sum(file_size_bytes) AS bytes FROM cat GROUP BY level)")
def pick_compaction_level(spark, sf_dir):
    """Level 0 has more than its four runs, so it is first."""
    return catalogue.pick_level(run_catalogue(spark, sf_dir))


@query(f"{_CAT} SELECT coalesce(min(level) FILTER ({_DUE}), -1)::INT AS level FROM (SELECT level, count(*) AS files, sum(file_size_bytes) AS bytes FROM cat WHERE level > 0 OR sequence_number <= 12 GROUP BY level)")
def pick_compaction_level_by_bytes(spark, sf_dir):
    """With three runs at level 0, the first level over its budget."""
    return catalogue.pick_level(run_catalogue(spark, sf_dir).where("level > 0 or sequence_number <= 12"))


@query(f"{_CAT} SELECT filepath, smallest_key, row_number() OVER (ORDER BY smallest_key)::INT AS place FROM cat WHERE level = 2")
def files_at_level(spark, sf_dir):
    found = catalogue.files_at(run_catalogue(spark, sf_dir), 2)
    place = F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).alias("place")  # a row for each run of a level; in the order as given
    return found.select("filepath", "smallest_key", place)


@query(f"""{_CAT}, src AS (SELECT * FROM cat WHERE level = 0)
SELECT filepath, level FROM src UNION ALL SELECT filepath, level FROM cat c WHERE level = 1 AND EXISTS (SELECT 1 FROM src WHERE c.largest_key >= src.smallest_key AND c.smallest_key <= src.largest_key)""")
def select_overlaps_of_level_0(spark, sf_dir):
    return catalogue.select_files(run_catalogue(spark, sf_dir), 0).select("filepath", "level")


@query("SELECT l::INT AS level, CASE WHEN l <= 0 THEN 0 ELSE (10485760 * 10 ** (l - 1))::BIGINT END::BIGINT AS max_bytes FROM range(0, 7) t(l)")
def max_bytes_for_level(spark, sf_dir):
    return spark.range(7).select(F.col("id").cast("int").alias("level"), catalogue.max_bytes_column(F.col("id")).alias("max_bytes"))


@query(f"""{_CAT}, src AS (SELECT * FROM cat WHERE level = 1 ORDER BY smallest_key, sequence_number LIMIT 1)
SELECT filepath, level FROM src UNION ALL SELECT filepath, level FROM cat c WHERE level = 2 AND EXISTS (SELECT 1 FROM src WHERE NOT (c.largest_key < src.smallest_key OR c.smallest_key > src.largest_key))""")
def select_overlaps(spark, sf_dir):
    return catalogue.select_files(run_catalogue(spark, sf_dir), 1).select("filepath", "level")


@query(f"{_CAT} SELECT filepath, level FROM cat WHERE level <> 3 UNION ALL SELECT filepath || '.new', 4 FROM cat WHERE level = 3")
def add_files(spark, sf_dir):
    """What a merge does to a catalogue: the runs of level 3 go, their successors at level 4 come."""
    cat = run_catalogue(spark, sf_dir)
    old = cat.where("level = 3")
    new = old.withColumns({"filepath": F.concat("filepath", F.lit(".new")), "level": F.lit(4)})
    return catalogue.add_file(catalogue.remove_files(cat, old), new).select("filepath", "level")


@query(f"{_CAT} SELECT filepath FROM cat WHERE filepath NOT IN (SELECT filepath FROM cat WHERE level = 0)")
def remove_files(spark, sf_dir):
    cat = run_catalogue(spark, sf_dir)
    return catalogue.remove_files(cat, cat.where("level = 0")).select("filepath")


_BLOCKS = f"""{_RUNS.replace("WITH", "WITH RECURSIVE", 1)}, e AS ({_SIZED}), o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY key) AS i FROM e),
pack AS (
  SELECT run, i, key, size, 0 AS block, 4 + size AS used FROM o WHERE i = 1
  UNION ALL
  SELECT o.run, o.i, o.key, o.size, CASE WHEN p.used + o.size > 4096 THEN p.block + 1 ELSE p.block END, CASE WHEN p.used + o.size > 4096 THEN 4 + o.size ELSE p.used + o.size END
  FROM pack p JOIN o ON o.run = p.run AND o.i = p.i + 1
), b AS (SELECT run, block::INT AS block, min(key) AS first_key, max(key) AS last_key, (4 + sum(size))::BIGINT AS block_size, count(*) AS entries FROM pack GROUP BY run, block),
idx AS (SELECT run, block, first_key, last_key, (sum(block_size) OVER (PARTITION BY run ORDER BY block) - block_size)::BIGINT AS block_offset, block_size, entries FROM b)"""


def _blocks(spark, sf_dir):
    rows = _named_runs(spark, sf_dir)
    return folds.block_index(rows.select("run", "key", text.encoded_size(F.col("key"), F.col("value")).alias("size")))


@query(f"{_BLOCKS} SELECT * FROM idx")
def block_pack(spark, sf_dir):
    return _blocks(spark, sf_dir)


@query(f"""{_BLOCKS}, probes AS (SELECT run, lpad((7 * i)::VARCHAR, 8, '0') AS key FROM range(0, 60) t(i), (SELECT DISTINCT run FROM runs))
SELECT p.run, p.key, x.block, x.block_offset, x.block_size FROM probes p ASOF LEFT JOIN idx x ON p.run = x.run AND p.key <= x.last_key""")
def block_index_lookup(spark, sf_dir):
    index = _blocks(spark, sf_dir)
    probes = spark.range(60).select(F.lpad((F.col("id") * 7).cast("string"), 8, "0").alias("key")).join(index.select("run").distinct())
    return folds.find_block(probes, index).select("run", "key", "block", "block_offset", "block_size")


@query(f"{_BLOCKS}, v AS (SELECT run, lpad(key::VARCHAR, 8, '0') AS key, payload AS value, is_tombstone FROM runs) SELECT x.run, x.block, v.key, coalesce(v.value, '') AS value, v.is_tombstone FROM v JOIN idx x ON v.run = x.run AND v.key BETWEEN x.first_key AND x.last_key")
def block_codec(spark, sf_dir):
    """All entries packed into blocks, as bytes, and back."""
    rows = event_runs(spark, sf_dir).select("run", F.lpad(F.col("key").cast("string"), 8, "0").alias("key"), F.col("payload").alias("value"), "is_tombstone")
    at = folds.find_block(rows.select("run", "key"), _blocks(spark, sf_dir)).select("run", "key", "block")
    packed = rows.join(at, ["run", "key"]).groupBy("run", "block").agg(F.sort_array(F.collect_list(F.struct("key", "value", "is_tombstone"))).alias("entries"))  # a block is 4 KB

    def there_and_back(batches):
        for batch in batches:
            out = []
            for run, block, entries in zip(batch["run"], batch["block"], batch["entries"], strict=True):
                data = codec.encode_block((e["key"], e["value"], e["is_tombstone"]) for e in entries)
                out += [(run, block, key, value.decode(), dead) for key, value, dead in codec.decode_block(data)]
            yield pd.DataFrame(out, columns=["run", "block", "key", "value", "is_tombstone"])

    return packed.mapInPandas(there_and_back, "run long, block int, key string, value string, is_tombstone boolean")


# Hashes, filters, strings, names.
_BYTES = "list_transform(range(1, length({0}) + 1), lambda i: ord({0}[i]))"
_FNV32 = "list_reduce(list_prepend({1}::HUGEINT, " + _BYTES + "), lambda h, x: (xor(h, x::HUGEINT) * 16777619) % 4294967296)"
_H1, _H2 = (_FNV32.format("{0}", hashing.FNV32_OFFSET ^ s) for s in bloom.SEEDS)
_POSITIONS = f"list_transform(range(0, 7), lambda i: ((({_H1}) + i * ({_H2})) % 4294967296) % {{1}})"


@query(f"SELECT c_name AS key, array_to_string({_POSITIONS.format('c_name', 10000)}, ',') AS positions FROM customer")
def bloom_positions(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), F.array_join(bloom.positions(F.col("c_name"), 10000, 7).cast("array<string>"), ",").alias("positions"))


_FILTER = f"""WITH member AS (SELECT 'key_' || i AS k FROM range(0, 1000) t(i)), probe AS (SELECT 'key_' || i AS k FROM range({{low}}, {{high}}) t(i)),
bits AS (SELECT DISTINCT unnest({_POSITIONS.format('k', 10000)}) AS bit FROM member), hit AS (SELECT k, unnest({_POSITIONS.format('k', 10000)}) AS bit FROM probe),
found AS (SELECT k, count(*) = count(bits.bit) AS maybe FROM hit LEFT JOIN bits USING (bit) GROUP BY k)"""


def _filtered(spark, low, high):
    named = lambda a, b: spark.range(a, b).select(F.concat(F.lit("key_"), F.col("id").cast("string")).alias("k"))
    bits, hashes = bloom.bits_for(1000, 10), bloom.hashes_for(10)
    return bloom.might_contain(named(low, high), "k", bloom.build(named(0, 1000), "k", bits, hashes), bits, hashes)


@query(_FILTER.format(low=500, high=1500) + " SELECT k, maybe FROM found")
def bloom_might_contain(spark, sf_dir):
    return _filtered(spark, 500, 1500)


@query(_FILTER.format(low=1000, high=11000) + " SELECT count(*) AS probes, count_if(maybe)::BIGINT AS passed, round(count_if(maybe) / count(*), 6) AS rate FROM found")
def bloom_fpr(spark, sf_dir):
    return _filtered(spark, 1000, 11000).agg(F.count("*").alias("probes"), F.count_if("maybe").alias("passed"), F.round(F.count_if("maybe") / F.count("*"), 6).alias("rate"))


_FNV64 = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, " + _BYTES.replace("ord({0}[i])", "ord({0}[i])::UHUGEINT") + "), lambda h, x: (xor(h, x) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"


@query(f"SELECT c_name AS key, lower(lpad(hex(h::UBIGINT), 16, '0')) AS hash, (h % 16)::INT AS shard FROM (SELECT c_name, {_FNV64.format('c_name')} AS h FROM customer)")
def fnv1a64_shard(spark, sf_dir):
    name = F.col("c_name")
    return _table(spark, sf_dir, "customer").select(name.alias("key"), hashing.fnv1a64_hex(name).alias("hash"), hashing.shard(name, 16).alias("shard"))


_BITS = "flatten(list_transform(range(1, length(c_name) + 1), lambda i: list_transform(range(0, 8), lambda k: ((ord(c_name[i]) >> k) & 1)::BIGINT)))"


@query(f"""SELECT c_name AS key, xor(list_reduce(list_prepend(4294967295::BIGINT, {_BITS}), lambda c, b: xor(c >> 1, CASE WHEN (xor(c, b) & 1) = 1 THEN 3988292384 ELSE 0 END::BIGINT)), 4294967295) AS crc
FROM customer""")
def crc32_keys(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), hashing.crc32(F.col("c_name")).alias("crc"))


@query("SELECT c_custkey, array_to_string(string_split(c_name, '#'), '/') AS parts, len(string_split(c_name, '#'))::INT AS n FROM customer")
def str_split(spark, sf_dir):
    parts = text.split_on(F.col("c_name"), "#")
    return _table(spark, sf_dir, "customer").select("c_custkey", F.array_join(parts, "/").alias("parts"), F.size(parts).alias("n"))


@query(r"SELECT c_custkey, regexp_replace(E' \t' || c_name || E'\r\n ', '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g') AS name FROM customer")
def str_trim(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", text.trim_blank(F.concat(F.lit(" \t"), "c_name", F.lit("\r\n "))).alias("name"))


@query("SELECT c_custkey, (9 + strlen(c_name) + strlen(c_mktsegment))::BIGINT AS entry, (13 + strlen(c_name) + 4 + strlen(c_mktsegment))::BIGINT AS put, (13 + strlen(c_name))::BIGINT AS del FROM customer")
def encoded_size(spark, sf_dir):
    key, value = F.col("c_name"), F.col("c_mktsegment").cast("binary")
    sizes = [text.encoded_size(key, value).alias("entry"), text.payload_size(F.lit(1), key, value).alias("put"), text.payload_size(F.lit(2), key, value).alias("del")]
    return _table(spark, sf_dir, "customer").select("c_custkey", *sizes)


_NAMES = ", ".join(f"({c}, '{n}')" for c, n in errors.STATUS.items())


@query(f"SELECT c::INT AS code, coalesce(n, 'Unknown Code') AS name FROM range(0, 410) t(c) LEFT JOIN (VALUES {_NAMES}) s(k, n) ON c = k")
def status_codes(spark, sf_dir):
    return spark.range(410).select(F.col("id").cast("int").alias("code"), errors.status_name(F.col("id")).alias("name"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'router' WHEN 2 THEN 'shard' WHEN 3 THEN 'metadata' ELSE 'standalone' END AS node_role,
CASE l_orderkey % 4 WHEN 0 THEN 'Follower' WHEN 1 THEN 'Candidate' WHEN 2 THEN 'Leader' ELSE 'Unknown' END AS role FROM lineitem""")
def role_names(spark, sf_dir):
    """Known roles of nodes as they are, others as standalone; roles of consensus by number."""
    written = F.get(F.array(*[F.lit(x) for x in ("router", "shard", "metadata", "Shard", "", "leader")]), F.col("l_linenumber") - 1)
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", role_column(written).alias("node_role"), text.role_name(F.pmod("l_orderkey", F.lit(4))).alias("role"))


@query("SELECT event_id, user_id || ':' || event_id AS cache_key FROM events")
def cache_keys(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", text.cache_key(F.col("user_id").cast("string"), F.col("event_id")).alias("cache_key"))


@query()
def random_ids(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", text.uuid4().alias("uuid"), text.short_id().alias("short_id"))


@query("SELECT vec_id, (4 + 4 * len(embedding))::BIGINT AS bytes, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 9) AS total, embedding[64]::DOUBLE AS last FROM embeddings")
def vector_codec(spark, sf_dir):
    """All vectors as bytes, and back: what comes back is added up."""
    rows = codec.decode_vectors(codec.encode_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))
    total = F.aggregate("decoded", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return rows.select("vec_id", F.octet_length("encoded").cast("long").alias("bytes"), F.round(total, 9).alias("total"), F.get("decoded", F.lit(63)).cast("double").alias("last"))


# Clocks, histories, caches.
def _hlc_events(spark, sf_dir):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return _table(spark, sf_dir, "events").select(F.col("event_type").alias("node"), F.col("event_id").alias("seq"), F.floor(micros / 3_600_000_000).cast("long").alias("physical"))


@query("""WITH e AS (SELECT event_type AS node, event_id AS seq, epoch_us(ts) // 3600000000 AS p FROM events),
m AS (SELECT *, max(p) OVER (PARTITION BY node ORDER BY seq) AS phys FROM e)
SELECT node, seq, phys, (row_number() OVER (PARTITION BY node, phys ORDER BY seq) - 1)::INT AS logical FROM m""")
def hlc_now(spark, sf_dir):
    return folds.hlc_now(_hlc_events(spark, sf_dir)).select("node", "seq", "phys", "logical")


@query("""WITH e AS (SELECT event_type AS node, event_id AS seq, epoch_us(ts) // 3600000000 AS p FROM events),
m AS (SELECT *, max(p) OVER (PARTITION BY node ORDER BY seq) AS phys FROM e),
h AS (SELECT node, seq, phys, row_number() OVER (PARTITION BY node, phys ORDER BY seq) - 1 AS logical FROM m)
SELECT node, seq, (phys * 65536 + logical)::BIGINT AS packed, phys AS physical, logical::INT AS logical FROM h""")
def hlc_packed(spark, sf_dir):
    rows = folds.hlc_now(_hlc_events(spark, sf_dir)).select("node", "seq", clocks.pack(F.col("phys"), F.col("logical")).alias("packed"))
    return rows.select("node", "seq", "packed", clocks.physical(F.col("packed")).alias("physical"), clocks.logical(F.col("packed")).alias("logical"))


@query("""WITH RECURSIVE e AS (SELECT event_type AS node, event_id AS seq, event_id % 3 = 0 AS got, epoch_us(ts) // 3600000000 AS p, epoch_us(ts) // 3600000000 + event_id % 5 - 2 AS rp, event_id % 7 AS rl FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY seq) AS i FROM e),
h AS (
  SELECT node, 0::BIGINT AS seq, 0::BIGINT AS phys, 0::BIGINT AS logical, 0::BIGINT AS i FROM (SELECT DISTINCT node FROM e)
  UNION ALL
  SELECT o.node, o.seq, CASE WHEN got THEN greatest(phys, rp, p) ELSE greatest(phys, p) END,
    CASE WHEN NOT got AND p > phys OR got AND p > phys AND p > rp THEN 0 WHEN NOT got THEN logical + 1
      ELSE 1 + greatest(CASE WHEN phys = greatest(phys, rp, p) THEN logical ELSE -1 END, CASE WHEN rp = greatest(phys, rp, p) THEN rl ELSE -1 END) END, o.i
  FROM h JOIN o ON o.node = h.node AND o.i = h.i + 1
) SELECT node, seq, phys, logical::INT AS logical FROM h WHERE i > 0""")
def hlc_update(spark, sf_dir):
    rows = _hlc_events(spark, sf_dir)
    received = F.pmod("seq", F.lit(3)) == 0
    return folds.hlc_update(
        rows.select("node", "seq", F.when(received, "update").otherwise("now").alias("kind"), "physical", F.when(received, F.col("physical") + F.pmod("seq", F.lit(5)) - 2).alias("remote_phys"), F.when(received, F.pmod("seq", F.lit(7)).cast("int")).alias("remote_logical"))
    )


def _raft_events(spark, sf_dir):
    kinds = F.create_map(*[F.lit(x) for p in {"signup": "load", "purchase": "candidate", "view": "leader", "click": "vote", "error": "stepdown"}.items() for x in p])
    return _table(spark, sf_dir, "events").select(F.concat(F.lit("node"), (F.pmod("user_id", F.lit(5))).cast("string")).alias("node"), F.col("event_id").alias("seq"), F.element_at(kinds, F.col("event_type")).alias("kind"), F.floor(F.col("event_id") / 10).cast("long").alias("term"), F.concat(F.lit("node"), F.pmod("event_id", F.lit(5)).cast("string")).alias("peer"))


_RAFT = """WITH RECURSIVE e AS (SELECT 'node' || (user_id % 5) AS node, event_id AS seq, event_id // 10 AS t, 'node' || (event_id % 5) AS peer,
  CASE event_type WHEN 'signup' THEN 'load' WHEN 'purchase' THEN 'candidate' WHEN 'view' THEN 'leader' WHEN 'click' THEN 'vote' ELSE 'stepdown' END AS kind FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY seq) AS i FROM e),
f AS (
  SELECT node, 0::BIGINT AS i, 0::BIGINT AS seq, '' AS kind, '' AS status, false AS told, 'Follower' AS role, 0::BIGINT AS term, '' AS vote, '' AS leader FROM (SELECT DISTINCT node FROM e)
  UNION ALL
  SELECT node, i, seq, kind, CASE WHEN done THEN 'OK' WHEN kind = 'vote' THEN 'AlreadyExists' ELSE 'InvalidArgument' END, done AND (kind IN ('candidate', 'leader') OR kind = 'stepdown' AND role <> 'Follower'),
    CASE WHEN NOT done OR kind IN ('vote', 'load') THEN role WHEN kind = 'candidate' THEN 'Candidate' WHEN kind = 'leader' THEN 'Leader' ELSE 'Follower' END,
    CASE WHEN NOT done OR kind IN ('vote', 'leader') THEN term WHEN kind = 'candidate' THEN term + 1 ELSE t END,
    CASE WHEN NOT done OR kind = 'leader' THEN vote WHEN kind = 'candidate' THEN node WHEN kind = 'stepdown' THEN CASE WHEN t > term THEN '' ELSE vote END ELSE peer END,
    CASE WHEN NOT done OR kind IN ('vote', 'load') THEN leader WHEN kind = 'candidate' THEN '' WHEN kind = 'leader' THEN node ELSE peer END
  FROM (SELECT o.*, f.role, f.term, f.vote, f.leader,
      CASE o.kind WHEN 'candidate' THEN f.role <> 'Leader' WHEN 'leader' THEN f.role = 'Candidate' WHEN 'stepdown' THEN o.t >= f.term WHEN 'vote' THEN f.vote IN ('', o.peer) ELSE true END AS done
    FROM f JOIN o ON o.node = f.node AND o.i = f.i + 1)
), raft AS (SELECT node, seq, kind, status, told, role, term, vote AS voted_for, leader AS leader_id FROM f WHERE i > 0)"""


@query(f"{_RAFT} SELECT * FROM raft")
def raft_fold(spark, sf_dir):
    return folds.raft_history(_raft_events(spark, sf_dir))


@query(f"{_RAFT} SELECT term, count(DISTINCT node) AS leaders FROM raft WHERE role = 'Leader' GROUP BY term HAVING count(DISTINCT node) > 1")
def raft_double_leaders(spark, sf_dir):
    return routing.double_leaders(folds.raft_history(_raft_events(spark, sf_dir)))


@query("""WITH m AS (SELECT event_id // 100 AS term, user_id AS i FROM events)
SELECT term, list_sort(list(i), 'DESC')[len(list(i)) // 2 + 1] AS commit_index FROM m GROUP BY term""")
def raft_commit_index(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 100).cast("long").alias("term"), F.col("user_id").alias("match_index"))
    return routing.commit_index(rows)


@query("""WITH RECURSIVE o AS (SELECT (user_id % 4)::INT AS shard, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'put' ELSE 'get' END AS op, user_id::VARCHAR AS key,
  row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS i FROM events),
f AS (
  SELECT DISTINCT shard, 0::BIGINT AS i, 0::BIGINT AS seq, '' AS op, '' AS key, false AS hit, 0::BIGINT AS evicted, []::VARCHAR[] AS held FROM o
  UNION ALL
  SELECT shard, i, seq, op, key, op = 'get' AND present, gone, moved[gone + 1 :]
  FROM (SELECT *, list_filter(range(0, len(moved) + 1), lambda g: coalesce(list_sum(list_transform(moved[g + 1 :], lambda k: strlen(k) + 4096)), 0) <= 65536)[1] AS gone
    FROM (SELECT o.*, list_contains(f.held, o.key) AS present, CASE WHEN o.op = 'put' OR list_contains(f.held, o.key) THEN list_append(list_filter(f.held, lambda k: k <> o.key), o.key) ELSE f.held END AS moved
      FROM f JOIN o ON o.shard = f.shard AND o.i = f.i + 1))
) SELECT shard, seq, op, key, hit, evicted::INT AS evicted, coalesce(list_sum(list_transform(held, lambda k: strlen(k) + 4096)), 0)::BIGINT AS used FROM f WHERE i > 0""")
def lru_trace(spark, sf_dir):
    op = F.when(F.pmod("event_id", F.lit(3)) == 0, "put").otherwise("get")
    rows = _table(spark, sf_dir, "events").select(F.pmod("user_id", F.lit(4)).cast("int").alias("shard"), F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").cast("string").alias("key"), F.lit(4096).cast("long").alias("bytes"))
    return folds.lru_trace(rows, 64 * 1024)


# Metrics.
@query("SELECT event_type, sum(1)::BIGINT AS value FROM events GROUP BY event_type")
def metric_counter(spark, sf_dir):
    return metrics.counters(_table(spark, sf_dir, "events").withColumn("one", F.lit(1)), ["event_type"], "one")


@query("SELECT event_type, arg_max(value, event_id) AS value FROM events GROUP BY event_type")
def metric_gauge(spark, sf_dir):
    return metrics.gauges(_table(spark, sf_dir, "events"), ["event_type"], at="event_id")


_BOUNDS = [1.0, 5.0, 10.0, 50.0, 100.0]
_LE = ", ".join(f"({b}, '{b:g}')" for b in _BOUNDS)


@query(f"""WITH b(bound, le) AS (VALUES {_LE}, ('inf'::DOUBLE, '+Inf'))
SELECT event_type, le, count_if(value <= bound)::BIGINT AS bucket, round(sum(value), 4) AS sum, count(value) AS count FROM events, b GROUP BY event_type, le""")
def metric_histogram(spark, sf_dir):
    return metrics.histogram(_table(spark, sf_dir, "events"), ["event_type"], _BOUNDS).withColumn("sum", F.round("sum", 4))


# The table itself, in the shared folder: key and value are strings and bytes there.
_tables: dict[tuple[str, str], str] = {}


def _mutations(spark, sf_dir):
    return event_log(spark, sf_dir).select("op", F.col("key").cast("string").alias("key"), F.col("payload").alias("value"), "seq")


def _quarters(spark, sf_dir) -> str:
    """A table to which the events came in four batches, each flushed; made once for a session, and only read by queries."""
    made = (spark.sparkContext.applicationId, sf_dir)
    if made not in _tables:
        rows = _mutations(spark, sf_dir)
        quarter = rows.agg(F.floor((F.max("seq") + 4) / 4).alias("q")).first()["q"]
        path = scratch.fresh(spark, "table")
        table = KvTable.open(spark, path)
        for run in range(4):
            table.append(rows.where(F.floor(F.col("seq") / quarter) == run))
            table.flush()
        _tables[made] = path
    return _tables[made]


def _text(found: DataFrame) -> DataFrame:
    return found.select("key", F.col("value").cast("string").alias("value"))


_NEWEST_TEXT = f"{_NEWEST} SELECT key::VARCHAR AS key, payload AS value FROM newest WHERE NOT is_tombstone"


@query(_NEWEST_TEXT)
def table_scan(spark, sf_dir):
    """Four flushed runs, read after opening the table again."""
    return _text(KvTable.open(spark, _quarters(spark, sf_dir)).scan())


@query(f"{_NEWEST_TEXT} AND key::VARCHAR BETWEEN '2' AND '35'")
def table_range(spark, sf_dir):
    return _text(KvTable.open(spark, _quarters(spark, sf_dir)).range("2", "35"))


@query(f"{_NEWEST_TEXT} AND key::VARCHAR LIKE '12%'")
def table_prefix(spark, sf_dir):
    return _text(KvTable.open(spark, _quarters(spark, sf_dir)).prefix("12"))


@query(f"{_RUNS} SELECT run + 1 AS sequence_number, 0 AS level, min(key::VARCHAR) AS smallest_key, max(key::VARCHAR) AS largest_key FROM runs GROUP BY run")
def table_checkpoint(spark, sf_dir):
    return KvTable.open(spark, _quarters(spark, sf_dir)).checkpoint().select("sequence_number", "level", "smallest_key", "largest_key")


@query(_NEWEST_TEXT.replace("payload AS value", "payload || '!' AS value"))
def table_merged(spark, sf_dir):
    """Three flushed runs and a fourth, with what was written over it still in the log; the due level is merged, the table opened again."""
    rows = _mutations(spark, sf_dir)
    path = scratch.fresh(spark, "table")
    table = KvTable.open(spark, path, levels=2)
    for run in range(4):
        table.append(rows.where(F.pmod("seq", F.lit(4)) <= run))  # every mutation comes again with those after it
        table.flush()
    table.append(rows.withColumn("value", F.concat("value", F.lit(b"!"))))
    table.compact()
    return _text(KvTable.open(spark, path, levels=2).scan())


@query(f"""{_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY run DESC) AS n FROM runs)
SELECT 0 AS source_level, 1 AS target_level, 4::BIGINT AS files_read, 1::BIGINT AS files_written, count(*) AS keys_merged, count_if(n > 1)::BIGINT AS duplicate_keys_dropped,
  count_if(n = 1 AND is_tombstone)::BIGINT AS tombstones_dropped FROM r""")
def table_compaction(spark, sf_dir):
    """Counts of the merge of four runs into the bottom level."""
    path = scratch.fresh(spark, "table")
    rows = _mutations(spark, sf_dir)
    quarter = rows.agg(F.floor((F.max("seq") + 4) / 4).alias("q")).first()["q"]
    table = KvTable.open(spark, path, levels=2)
    for run in range(4):
        table.append(rows.where(F.floor(F.col("seq") / quarter) == run))
        table.flush()
    out = table.compact()
    columns = [c.strip() for c in MERGE_STATS.split(",")]
    stats = spark.createDataFrame([tuple(out[c.split()[0]] for c in columns)], MERGE_STATS)
    return stats.select("source_level", "target_level", "files_read", "files_written", "keys_merged", "duplicate_keys_dropped", "tombstones_dropped")


@query("""WITH half AS (SELECT max(event_id) // 2 AS h, max(event_id) + 1 AS n FROM events)
SELECT n AS last_lsn, h + 1 AS last_flushed_lsn, n - h - 1 AS replayed, (SELECT count(DISTINCT user_id) FROM events WHERE event_id > h) AS keys FROM half""")
def table_recovery(spark, sf_dir):
    """Half of the events flushed, the rest only logged; what opening the table again replays."""
    path = scratch.fresh(spark, "table")
    rows = _mutations(spark, sf_dir)
    half = rows.agg(F.floor(F.max("seq") / 2).alias("h")).first()["h"]
    table = KvTable.open(spark, path)
    table.append(rows.where(F.col("seq") <= half))
    table.flush()
    table.append(rows.where(F.col("seq") > half))
    again = KvTable.open(spark, path)
    rest = again.unflushed().agg(F.count("*").alias("replayed"), F.count_distinct("key").alias("keys"))
    return rest.select(F.lit(again.manifest.next_lsn - 1).cast("long").alias("last_lsn"), F.lit(again.manifest.last_flushed_lsn).cast("long").alias("last_flushed_lsn"), "replayed", "keys")


@query(f"WITH {_LOG} SELECT seq AS lsn, CASE WHEN is_tombstone THEN 2 ELSE 1 END::TINYINT AS op, key::VARCHAR AS key, payload AS value FROM log WHERE seq > 0")
def wal_file(spark, sf_dir):
    """The events as one binary log file with a torn end, read back."""
    path = scratch.fresh(spark, "log")
    rows = event_log(spark, sf_dir).where("lsn > 0").select("lsn", "op", F.col("key").cast("string").alias("key"), F.col("payload").alias("value"))
    files.write_log_file(rows, f"{path}/whole.log")
    files.write_text(spark, f"{path}/torn.log", "\x00\x00\x00\x15 no record")
    return files.read_log_files(spark, path).select("lsn", "op", "key", F.col("value").cast("string").alias("value"))


@query("SELECT count(*) AS last_lsn, 2::BIGINT AS batches, (SELECT count(DISTINCT user_id) FROM events) AS keys FROM events")
def table_exactly_once(spark, sf_dir):
    """Two batches of a stream, each delivered twice."""
    table, rows = KvTable.open(spark, scratch.fresh(spark, "table")), _mutations(spark, sf_dir)
    for number in range(2):
        part = rows.where(F.pmod("seq", F.lit(2)) == number)
        last = [table.append(part, ("events", number)) for _ in range(2)]
        assert last[0] == last[1]
    keys = table.scan_with_tombstones().agg(F.count("*").alias("keys"))
    return keys.select(F.lit(table.manifest.next_lsn - 1).cast("long").alias("last_lsn"), F.lit(len(table.manifest.batches)).cast("long").alias("batches"), "keys")


@query(f"{_NEWEST} SELECT true AS flushed, count_if(NOT is_tombstone)::BIGINT AS keys, 0::BIGINT AS unflushed FROM newest")
def table_threshold(spark, sf_dir):
    """A memory of some bytes: every append goes into a run at once, closing leaves nothing."""
    path = scratch.fresh(spark, "table")
    with KvTable.open(spark, path, memtable_bytes=100) as table:
        table.append(_mutations(spark, sf_dir))
    again = KvTable.open(spark, path)
    return again.scan().agg(F.count("*").alias("keys")).select(F.lit(table.flushes > 0).alias("flushed"), "keys", F.lit(again.unflushed().count()).cast("long").alias("unflushed"))


@query(_NEWEST_TEXT)
def stream_latest(spark, sf_dir):
    """The events as a stream into a table, batch by batch."""
    from ..streaming import ingest

    e = ingest.read_files(spark, sf_dir, spark.read.parquet(f"{sf_dir}/events.parquet").schema, glob="events.parquet")
    dead = F.col("event_type") == "error"
    payload = F.concat("props", F.expr("repeat('x', cast(event_id * 37 % 300 as int))")).cast("binary")
    rows = e.select(F.when(dead, 2).otherwise(1).cast("tinyint").alias("op"), F.col("user_id").cast("string").alias("key"), F.when(~dead, payload).alias("value"), F.col("event_id").alias("seq"))
    path = scratch.fresh(spark, "stream")
    table = KvTable.open(spark, f"{path}/table")
    ingest.into_table(rows, table, f"{path}/checkpoint").awaitTermination()
    return _text(table.scan())


@query(f"{_NEWEST} SELECT key, value FROM newest WHERE NOT is_tombstone")
def stream_aggregate(spark, sf_dir):
    """The newest versions as a streaming aggregation."""
    from ..streaming import ingest

    e = ingest.read_files(spark, sf_dir, spark.read.parquet(f"{sf_dir}/events.parquet").schema, glob="events.parquet")
    dead = F.col("event_type") == "error"
    found = ingest.latest_of_stream(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("lsn"), "value", dead.alias("is_tombstone")))
    return ingest.run_to_memory(found, "kelpstone_latest").where(~F.col("is_tombstone")).select("key", "value")


# Vectors.
def _vectors(spark, sf_dir):
    """All vectors, and those that are searched for: every one whose id is divisible by 50."""
    base = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return base, base.where(F.col("vec_id") % 50 == 0)


def _knn_sql(score: str, order: str) -> str:
    return f"""SELECT * FROM (SELECT q.vec_id AS query_id, b.vec_id, round({score.format('b.embedding::DOUBLE[]', 'q.embedding::DOUBLE[]')}, 9) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round({score.format('b.embedding::DOUBLE[]', 'q.embedding::DOUBLE[]')}, 9) {order}, b.vec_id)::INT AS rank
FROM embeddings b JOIN embeddings q ON q.vec_id % 50 = 0 AND q.vec_id <> b.vec_id) WHERE rank <= 10"""


@query(_knn_sql("list_distance({0}, {1})", "ASC"))
def knn_l2(spark, sf_dir):
    return vectors.knn(*_vectors(spark, sf_dir), 10, "l2")


@query(_knn_sql("list_cosine_similarity({0}, {1})", "DESC"))
def knn_cosine(spark, sf_dir):
    return vectors.knn(*_vectors(spark, sf_dir), 10, "cosine")


@query(_knn_sql("list_inner_product({0}, {1})", "DESC"))
def knn_dot(spark, sf_dir):
    return vectors.knn(*_vectors(spark, sf_dir), 10, "dot")


@query(_knn_sql("list_distance({0}, {1})", "ASC"))
def knn_batched(spark, sf_dir):
    return vectors.knn_batched(*_vectors(spark, sf_dir), 10, "l2")


@query(_knn_sql("list_distance({0}, {1})", "ASC"))
def knn_expressions(spark, sf_dir):
    return vectors.knn_expressions(*_vectors(spark, sf_dir), 10, "l2")


@query(_knn_sql("list_distance({0}, {1})", "ASC"))
def shard_topk_merge(spark, sf_dir):
    return ann.shard_top_k(*_vectors(spark, sf_dir), 10, 4).drop("shard")


@query()
def ivf_search(spark, sf_dir):
    """The vectors are as good as uniform on a sphere, so that cells can't tell much: two thirds of them are looked into."""
    base, wanted = _vectors(spark, sf_dir)
    index = ann.Ivf(base)
    return index.search(wanted, 10, probes=math.ceil(0.67 * len(index.centres)))


@query()
def pq_search(spark, sf_dir):
    """Codes are stored and opened again; 2 to 10 % of the vectors are scored exactly."""
    base, wanted = _vectors(spark, sf_dir)
    path = scratch.fresh(spark, "codes")
    ann.Pq(base).save(path)
    return ann.Pq.open(spark, path, base).search(wanted, 10)


@query()
def lsh_search(spark, sf_dir):
    base, wanted = _vectors(spark, sf_dir)
    return ann.Lsh(base, 64).search(wanted, 10)


@query()
def hnsw_search(spark, sf_dir):
    base, wanted = _vectors(spark, sf_dir)
    return ann.Hnsw.build(base, scratch.fresh(spark, "graphs")).search(wanted, 10)


@query("SELECT unnest(['hnsw', 'ivf', 'lsh', 'pq']) AS index, 10 * count(*) AS wanted, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
def ann_recall(spark, sf_dir):
    """Whether each approximate index finds nine of ten exact neighbours of the stated queries."""
    exact = knn_l2(spark, sf_dir).select("query_id", "vec_id")
    out = None
    for name, search in (("hnsw", hnsw_search), ("ivf", ivf_search), ("lsh", lsh_search), ("pq", pq_search)):
        found = ann.recall(search(spark, sf_dir), exact).select(F.lit(name).alias("index"), "wanted", (F.col("recall") >= 0.9).alias("enough"))
        out = found if out is None else out.unionByName(found)
    return out


def routing_offers(spark, sf_dir):
    """For each query and shard what a router knows: from embeddings, and from events as requests."""
    base = _table(spark, sf_dir, "embeddings").withColumn("shard", hashing.shard(F.col("vec_id").cast("string"), 4))
    mean = base.select("shard", F.posexplode("embedding").alias("i", "x")).groupBy("shard", "i").agg(F.avg("x").alias("x"))
    centre = mean.groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))
    load = _table(spark, sf_dir, "events").groupBy(F.pmod("user_id", F.lit(4)).cast("int").alias("shard")).agg((F.count("*") / 60).alias("qps"), F.percentile_approx("value", 0.99).alias("p99"))
    held = base.groupBy("shard").agg((F.count("*") * 256 / 1e6).alias("memory_pressure"))
    wanted = base.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    pairs = wanted.join(F.broadcast(centre.join(load, "shard").join(held, "shard")))
    return pairs.select("query_id", "shard", vectors.l2(F.col("embedding"), F.col("centre")).alias("centre_distance"), "qps", "memory_pressure", "p99", F.lit(64.0 * 100).alias("effort"))


@query()
def route_shard(spark, sf_dir):
    offers = routing_offers(spark, sf_dir)
    latency = 2 * F.col("centre_distance") + 0.01 * F.col("qps") + F.col("memory_pressure") + 0.001 * F.col("p99") + F.col("effort") / 1e4
    model = routing.train(offers.withColumn("latency", latency))
    return routing.route(model, offers).select("query_id", "shard", F.round("predicted", 6).alias("predicted"))


#: Queries that the benchmark times.
HEADLINE = [
    "kv_latest", "kv_multi_get", "kv_scan_range", "kv_as_of_lsn", "wal_valid_prefix", "compact_bottom", "compaction_stats", "block_pack", "bloom_fpr", "fnv1a64_shard", "hlc_now", "raft_fold",
    "metric_histogram", "knn_l2", "knn_batched", "shard_topk_merge", "hnsw_search", "pq_search", "ivf_search", "hlc_update", "lru_trace", "wal_codec",
]
assert math.isclose(bloom.bits_for(1000, 10), 10000)
