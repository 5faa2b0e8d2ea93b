"""JSON lines to the console and to a rotating file."""

from __future__ import annotations

import json
import logging
from datetime import UTC, datetime
from logging.handlers import RotatingFileHandler


class JsonLines(logging.Formatter):
    def __init__(self, node_id: str):
        super().__init__()
        self.node_id = node_id

    def format(self, record: logging.LogRecord) -> str:
        data = record.msg if isinstance(record.msg, dict) else {"component": record.name, "msg": record.getMessage()}
        when = datetime.fromtimestamp(record.created, UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")
        return json.dumps({"time": when, "node_id": self.node_id, "level": record.levelname, "data": data})


def logger(node_id: str, path: str, max_bytes: int = 100 << 20, files: int = 10) -> logging.Logger:
    """A logger whose file rotates at ``max_bytes``; ``files`` of them are kept."""
    out = logging.getLogger(f"kelpstone.{node_id}")
    out.setLevel(logging.INFO)
    out.handlers.clear()
    for handler in (logging.StreamHandler(), RotatingFileHandler(path, maxBytes=max_bytes, backupCount=files - 1)):
        handler.setFormatter(JsonLines(node_id))
        out.addHandler(handler)
    return out
