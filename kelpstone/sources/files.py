"""Small files on any file system that Spark reaches, from the driver, and log files as a source."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.codec import MAX_PAYLOAD, decode_pieces, mutation_column, record_column
from ..model import MUTATION


def _at(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, where, _ = _at(spark, path)
    return fs.exists(where)


def read_text(spark: SparkSession, path: str) -> str:
    fs, where, jvm = _at(spark, path)
    stream = fs.open(where)
    try:
        return jvm.java.lang.String(stream.readAllBytes(), "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside, then puts it in place in one step: readers see nothing or all. An existing file is an error, also for the later of two writers.

    On a local disk the step is a hard link, which never replaces a file; elsewhere a rename, which doesn't on HDFS. A store without such a step needs a lock.
    """
    fs, where, jvm = _at(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.exists(where):
            raise FileExistsError(path)
        if fs.getScheme() == "file":
            local = lambda p: jvm.java.nio.file.Path.of(fs.makeQualified(p).toUri())
            try:
                jvm.java.nio.file.Files.createLink(local(where), local(beside))
            except Py4JJavaError as other:
                if "FileAlreadyExists" in str(other.java_exception):
                    raise FileExistsError(path) from other
                raise
        elif not fs.rename(beside, where):
            raise FileExistsError(path)
    finally:
        fs.delete(beside, False)


def list_names(spark: SparkSession, path: str) -> list[str]:
    fs, where, _ = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, where, _ = _at(spark, path)
    fs.delete(where, True)


def size(spark: SparkSession, path: str) -> int:
    fs, where, _ = _at(spark, path)
    return fs.getContentSummary(where).getLength()


def write_log_file(log: DataFrame, path: str, buffered: int = 1 << 20, part: int = 8 << 20) -> int:
    """One binary log of all mutations in order, for a reader of such logs; it is a single stream, so the driver passes it on. Returns its bytes.

    Tasks join records to pieces of ``buffered`` bytes or more; the driver gets ranges of the log, of about ``part`` bytes, one after the other.
    """
    total = log.agg(F.sum(F.octet_length("key").cast("long") + F.coalesce(F.octet_length("value"), F.lit(0)) + 25)).first()[0] or 0
    ordered = encode_log(log).select("lsn", "record").repartitionByRange(max(1, -(-total // part)), "lsn").sortWithinPartitions("lsn")

    def join(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = bytearray()
        for batch in batches:
            for record in batch["record"]:
                held += record
                if len(held) >= buffered:
                    yield pd.DataFrame({"piece": [bytes(held)]})
                    held = bytearray()
        yield pd.DataFrame({"piece": [bytes(held)]})

    fs, where, _ = _at(log.sparkSession, path)
    out, size = fs.create(where, False), 0
    try:
        for row in ordered.mapInPandas(join, "piece binary").toLocalIterator():
            out.write(row["piece"])
            size += len(row["piece"])
    finally:
        out.close()
    return size


#: Mutations that a task decodes before it passes them on.
DECODED = 10_000


def read_log_files(spark: SparkSession, path: str) -> DataFrame:
    """Binary logs as mutations: of each file, the valid beginning. Keys keep their bytes, whatever they are.

    A file is read in parts, cut at its 0x0A bytes as if it were text, and put in order by file; its records, which only follow from those before,
    are decoded in one task as they stream by. What a task holds is a batch of parts and a record, whatever the size of the file.
    """
    parts = spark.read.option("lineSep", "\n").text(path)
    of_file = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_size", "file_block_start")]
    parts = parts.select(*of_file, F.monotonically_increasing_id().alias("n"), F.col("value").cast("binary").alias("part"))
    dealt = parts.repartition("file_path").sortWithinPartitions("file_path", "file_block_start", "n")

    def decode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = (m for _, file in groupby(_rows(batches), itemgetter(0)) for m in _of_file(file))
        while rows := list(islice(found, DECODED)):
            yield pd.DataFrame(rows, columns=["lsn", "op", "key", "value"])

    found = dealt.select("file_path", "file_size", "part").mapInPandas(decode, MUTATION.replace("key string", "key binary"))
    return found.withColumn("key", F.col("key").cast("string"))


def _rows(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[str, int, bytes]]:
    for batch in batches:
        yield from zip(batch["file_path"], batch["file_size"].tolist(), batch["part"], strict=True)


def _of_file(parts: Iterable[tuple[str, int, bytes]]) -> Iterator[tuple]:
    """The mutations of one file. Readers of text leave out EF BB BF at its beginning: as a length, 12 MB and more, if the fourth byte is at most 3."""
    seen = {"bytes": 0}
    pieces = _bytes(parts, seen)
    yield from decode_pieces(pieces)
    for _ in pieces:  # what follows a torn record, to count it
        pass
    if seen["bytes"] < seen["size"] and seen["first"] <= MAX_PAYLOAD >> 24:
        raise EngineError("StorageCorruption", f"{seen['path']}: {seen['bytes']} of {seen['size']} bytes were read")


def _bytes(parts: Iterable[tuple[str, int, bytes]], seen: dict, gathered: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of one file, ``gathered`` or more at a time, from its parts: each ended with 0x0A, except perhaps the last."""
    held = bytearray()
    for path, size, part in parts:
        held += part
        held += b"\n"
        seen.setdefault("first", held[0])
        seen.update(path=path, size=size)
        if len(held) >= gathered:
            yield bytes(held[: size - seen["bytes"]])
            seen["bytes"], held = seen["bytes"] + len(held), bytearray()
    left = bytes(held[: max(0, seen["size"] - seen["bytes"])])
    seen["bytes"] += len(held)
    yield left


def encode_log(log: DataFrame) -> DataFrame:
    """Mutations with their binary records (``record``), for export."""
    rows = log.select("lsn", F.col("op").cast("tinyint").alias("op"), "key", "value")
    return rows.withColumn("record", record_column(F.col("lsn"), F.col("op"), F.col("key"), F.col("value")))


def decode_records(records: DataFrame, column: str = "record") -> DataFrame:
    """Mutations of single binary records; a damaged one is an error."""
    return records.select(mutation_column(F.col(column)).alias("__m")).select("__m.*")
