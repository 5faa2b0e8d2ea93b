"""String functions and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[ \t\n\x0B\f\r]"


def split_on(text: Column, mark: str) -> Column:
    """Parts between marks; an empty part at the end is dropped, so that of an empty text there is none."""
    parts = F.split(text, rf"\Q{mark}\E", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def trim_blank(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def payload_size(op: Column, key: Column, value: Column) -> Column:
    """Bytes of a log record's payload: 13 and the key, and for a put 4 and the value."""
    put = F.when(op == 1, 4 + F.octet_length(value)).otherwise(0)
    return (13 + F.octet_length(key) + put).cast("long")


def encoded_size(key: Column, value: Column) -> Column:
    """Bytes of a block entry: 9, the key and the value."""
    return (9 + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def cache_key(path: Column, offset: Column) -> Column:
    return F.concat_ws(":", path, offset.cast("string"))


def short_id() -> Column:
    """Eight random lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.floor(F.rand() * (1 << 32)).cast("long")), 8, "0"))


def uuid4() -> Column:
    return F.uuid()


def role_name(role: Column) -> Column:
    return F.when(role == 0, "Follower").when(role == 1, "Candidate").when(role == 2, "Leader").otherwise("Unknown")
