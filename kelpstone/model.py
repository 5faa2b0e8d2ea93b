"""Schemas of the engine's tables."""

MUTATION = "lsn bigint, op tinyint, key string, value binary"
ENTRY = "key string, value binary, is_tombstone boolean, seq bigint"
RUN_META = "filepath string, level int, smallest_key string, largest_key string, file_size_bytes bigint, sequence_number bigint"
MERGE_STATS = (
    "source_level int, target_level int, files_read bigint, files_written bigint, bytes_read bigint, bytes_written bigint, "
    "keys_merged bigint, tombstones_dropped bigint, duplicate_keys_dropped bigint, duration_ms double"
)
HLC_EVENT = "node string, seq bigint, kind string, physical bigint, remote_phys bigint, remote_logical int"
RAFT_EVENT = "node string, seq bigint, kind string, term bigint, peer string"
CACHE_OP = "seq bigint, op string, key string, bytes bigint"
METRIC = "name string, labels map<string,string>, kind string, value double, ts bigint"

PUT, DELETE = 1, 2
