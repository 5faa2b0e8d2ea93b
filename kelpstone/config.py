"""Server configuration: one dataclass tree, with defaults, read from YAML."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import EngineError

ROLES = ("router", "shard", "metadata")


def parse_role(role: str | None) -> str:
    return role if role in ROLES else "standalone"


def role_column(role: Column) -> Column:
    return F.when(role.isin(*ROLES), role).otherwise("standalone")


@dataclass
class Node:
    node_id: str = "default-node"
    listen_address: str = "0.0.0.0:50051"
    role: str = "standalone"


@dataclass
class Storage:
    data_dir: str = "/tmp/kelpstone"
    memtable_size_mb: int = 64
    block_cache_mb: int = 256


@dataclass
class Raft:
    election_timeout_ms: int = 300
    heartbeat_interval_ms: int = 50
    snapshot_threshold: int = 10000


@dataclass
class Cluster:
    peers: list[str] = field(default_factory=list)


@dataclass
class Server:
    node: Node
    storage: Storage = field(default_factory=Storage)
    raft: Raft = field(default_factory=Raft)
    cluster: Cluster = field(default_factory=Cluster)


def load(path: str) -> Server:
    """Reads a YAML file. No file: NotFound; no ``node`` section, or not YAML: InvalidArgument."""
    import yaml

    if not Path(path).exists():
        raise EngineError("NotFound", path)
    try:
        found = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
        if not isinstance(found, dict) or "node" not in found:
            raise EngineError("InvalidArgument", "no node section")
        parts = {}
        for name, kind in (("node", Node), ("storage", Storage), ("raft", Raft), ("cluster", Cluster)):
            own = kind(**{k: v for k, v in (found.get(name) or {}).items() if k in kind.__dataclass_fields__})
            for key, spec in kind.__dataclass_fields__.items():
                if spec.type == "int":
                    setattr(own, key, int(getattr(own, key)))
            parts[name] = own
        parts["node"].role = parse_role(parts["node"].role)
        return Server(**parts)
    except (yaml.YAMLError, TypeError, ValueError) as wrong:
        raise EngineError("InvalidArgument", str(wrong)) from wrong
