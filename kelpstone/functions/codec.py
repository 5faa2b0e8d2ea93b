"""Byte layouts for import and export: little-endian numbers, length-prefixed strings and vectors, blocks, log records."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, StructField, StructType

from ..errors import EngineError

#: A log record whose length says more is corrupt.
MAX_PAYLOAD = 64 << 20
MIN_PAYLOAD = 13


class Writer:
    def __init__(self) -> None:
        self.out = bytearray()

    def put(self, form: str, value) -> Writer:
        self.out += struct.pack("<" + form, value)
        return self

    def u32(self, x: int) -> Writer:
        return self.put("I", x)

    def u64(self, x: int) -> Writer:
        return self.put("Q", x)

    def f32(self, x: float) -> Writer:
        return self.put("f", x)

    def raw(self, data: bytes) -> Writer:
        self.u32(len(data))
        self.out += data
        return self

    def string(self, text: str) -> Writer:
        return self.raw(text.encode())

    def floats(self, values: Iterable[float]) -> Writer:
        data = np.asarray(list(values), "<f4")
        self.u32(len(data))
        self.out += data.tobytes()
        return self


class Reader:
    """Reads what Writer writes; beyond the end it raises StorageCorruption."""

    def __init__(self, data: bytes):
        self.data, self.at = bytes(data), 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise EngineError("StorageCorruption", f"{n} bytes wanted at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def u32(self) -> int:
        return struct.unpack("<I", self.take(4))[0]

    def u64(self) -> int:
        return struct.unpack("<Q", self.take(8))[0]

    def f32(self) -> float:
        return struct.unpack("<f", self.take(4))[0]

    def raw(self) -> bytes:
        return self.take(self.u32())

    def string(self) -> str:
        return self.raw().decode()

    def floats(self) -> np.ndarray:
        return np.frombuffer(self.take(4 * self.u32()), "<f4")


def encode_block(entries: Iterable[tuple[str, bytes, bool]]) -> bytes:
    """A count, and key, value and tombstone flag of each entry."""
    entries = list(entries)
    out = Writer().u32(len(entries))
    for key, value, dead in entries:
        out.string(key).raw(value or b"").put("B", int(dead))
    return bytes(out.out)


def decode_block(data: bytes) -> list[tuple[str, bytes, bool]]:
    r = Reader(data)
    return [(r.string(), r.raw(), r.take(1) != b"\0") for _ in range(r.u32())]


def encode_record(lsn: int, op: int, key: str | bytes, value: bytes | None) -> bytes:
    """A log record: length and CRC of the payload, and the payload; a delete has no value."""
    payload = Writer().put("B", op).u64(lsn).raw(key.encode() if isinstance(key, str) else key)
    if op == 1:
        payload.raw(value or b"")
    data = bytes(payload.out)
    return bytes(Writer().u32(len(data)).u32(zlib.crc32(data)).out) + data


def decode_payload(data: bytes) -> tuple[int, int, bytes, bytes | None]:
    """(lsn, op, key, value); keys are bytes, of any kind."""
    r = Reader(data)
    op, lsn = r.take(1)[0], r.u64()
    if op not in (1, 2):
        raise EngineError("DataLoss", f"no such record type: {op}")
    return lsn, op, r.raw(), r.raw() if op == 1 else None


def decode_log(data: bytes) -> list[tuple[int, int, bytes, bytes | None]]:
    """The valid beginning of a log: up to the first record that is short, too long, or not what its CRC says.

    A whole record of an unknown type is no torn end but a log of another kind: StorageCorruption.
    """
    return list(decode_pieces([data]))


def decode_pieces(pieces: Iterable[bytes]) -> Iterator[tuple[int, int, bytes, bytes | None]]:
    """``decode_log`` of a log that comes in pieces, cut anywhere. What is held is a piece and the beginning of a record."""
    parts: list[bytes] = []
    passed = size = wanted = 0
    for piece in pieces:
        parts.append(piece)
        size += len(piece)
        if size < wanted:  # a record of many pieces is put together once
            continue
        held, at = b"".join(parts), 0
        while True:
            wanted = 8
            if at + wanted > size:
                break
            length, crc = struct.unpack_from("<II", held, at)
            if not MIN_PAYLOAD <= length <= MAX_PAYLOAD:
                return
            wanted += length
            if at + wanted > size:
                break
            payload = held[at + 8 : at + wanted]
            if zlib.crc32(payload) != crc:
                return
            try:
                yield decode_payload(payload)
            except EngineError as wrong:
                if wrong.name == "DataLoss":
                    raise EngineError("StorageCorruption", f"{wrong} at {passed + at}") from wrong
                return
            at += wanted
        passed += at
        parts, size = [held[at:]], size - at


def _bound(value: Column, body) -> Column:
    """``body`` of an expression that is computed once."""
    return F.transform(F.array(value), body)[0]


def _little(number: Column, size: int) -> Column:
    """A number as ``size`` bytes, the lowest first."""
    return _bound(F.unhex(F.lpad(F.hex(number.cast("long")), 2 * size, "0")), lambda big: F.concat(*[F.substring(big, size - i, 1) for i in range(size)]))


def _number(data: Column, at: int | Column, size: int) -> Column:
    """The number in the ``size`` bytes from ``at`` (from 0), the lowest first."""
    at = F.lit(at) if isinstance(at, int) else at
    digits = F.hex(F.concat(*[F.substring(data, at + size - i, F.lit(1)) for i in range(size)]))
    return F.conv(digits, 16, 10).cast("decimal(20,0)").cast("long")


def record_column(lsn: Column, op: Column, key: Column, value: Column) -> Column:
    """``encode_record`` as an expression."""
    key, value = key.cast("binary"), F.coalesce(value, F.lit(b""))
    tail = F.when(op == 1, F.concat(_little(F.octet_length(value), 4), value)).otherwise(F.lit(b""))
    payload = F.concat(_little(op, 1), _little(lsn, 8), _little(F.octet_length(key), 4), key, tail)
    return _bound(payload, lambda p: F.concat(_little(F.octet_length(p), 4), _little(F.crc32(p), 4), p))


def mutation_column(record: Column) -> Column:
    """struct(lsn, op, key, value) of a single record; anything but a whole record is an error."""

    def fields(p: Column) -> Column:
        op, size = _number(p, 0, 1), _number(p, 9, 4)
        value = F.when(op == 1, F.substring(p, size + 18, _number(p, size + 13, 4)))
        return F.struct(_number(p, 1, 8).alias("lsn"), op.cast("tinyint").alias("op"), F.substring(p, F.lit(14), size).cast("string").alias("key"), value.alias("value"))

    def whole(p: Column) -> Column:
        """Whether the lengths in a payload add up to its own."""
        op, size, n = _number(p, 0, 1), _number(p, 9, 4), F.octet_length(p)
        return ((op == 2) & (n == size + 13)) | ((op == 1) & (n >= size + 17) & (n == size + 17 + _number(p, size + 13, 4)))

    body = F.when(F.octet_length(record) >= 8 + MIN_PAYLOAD, F.substring(record, F.lit(9), F.octet_length(record)))
    sound = (_number(record, 0, 4) == F.octet_length(record) - 8) & (F.octet_length(record) <= 8 + MAX_PAYLOAD)
    return _bound(body, lambda p: F.when(p.isNotNull() & sound & (F.crc32(p) == _number(record, 4, 4)) & whole(p), fields(p)).otherwise(F.raise_error(F.lit("StorageCorruption: not a whole record"))))


def encode_vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """``rows`` with the vector column as length-prefixed little-endian floats (``encoded``). Floats have no bytes in SQL, so Arrow batches; one conversion for each."""

    def to_bytes(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = np.array([len(v) for v in batch[column]], np.int64)
            data = np.concatenate([*batch[column], np.zeros(0)]).astype("<f4").tobytes()
            ends = 4 * np.cumsum(sizes)
            yield batch.assign(encoded=[struct.pack("<I", n) + data[end - 4 * n : end] for n, end in zip(sizes.tolist(), ends.tolist(), strict=True)])

    return rows.mapInPandas(to_bytes, StructType([*rows.schema, StructField("encoded", BinaryType())]))


def decode_vectors(rows: DataFrame, column: str = "encoded") -> DataFrame:
    """``rows`` with ``decoded``, the vector of an encoded column."""

    def to_floats(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(decoded=[Reader(v).floats() for v in batch[column]])

    return rows.mapInPandas(to_floats, StructType([*rows.schema, StructField("decoded", ArrayType(FloatType()))]))
