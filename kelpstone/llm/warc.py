"""WARC archives (operator 9): a chunked record table.

Writing: each page becomes a record, by DataFrame functions and Spark's text
writer, so any store that Spark can write to will do. A payload of at least
``min_revisit`` bytes that equals an earlier page's becomes a revisit record.
Payloads over ``segment_bytes`` are cut once and written as a record and
continuation records, as the format provides. Archives are gzip files, which
Spark reads whole and in order, one task each.

Reading: a task streams an archive's bytes through a small state machine and
emits rows (record_id, chunk_no, ...) of at most ``chunk_bytes`` bytes, each
with the running SHA-256 of the payload so far. Neither a record nor an
archive is ever held as a whole. ``read`` gets the bytes from Spark's text
reader, line by line, which works on any store; a line is at most a segment in
archives that this module wrote. ``read_files`` is for archives of others,
whose records may be one line: it opens the files in the tasks and reads them
``READ_BYTES`` at a time.

Style: the writer is DataFrame functions; the readers Arrow batches, since
carrying a digest along a stream has no SQL form.

Defined results
---------------
null html: an empty payload. Payloads under ``min_revisit`` bytes are always
responses. Equal payloads: the row with the smallest page_id is the response;
rows that share that page_id and payload are responses, too; a null page_id
comes after all others. Repeated rows give a record each. Null urls are
written as an empty target. Extra columns are dropped. An empty table gives
archives without records and an empty table. An archive that ends inside a
record gives that record's chunks up to there, not complete; header lines of
more than ``HEADER_BYTES`` are cut.

Scale
-----
Finding equal payloads shuffles digests only; of a group of any size only its
smallest page_id travels. The list of groups is broadcast while it has at most
``BROADCAST_GROUPS`` rows; beyond, rows are joined to it by digest, with one
row per digest on the right, so that the left can be split where one is frequent.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, let, materialize

MIN_REVISIT = 100
SEGMENT_BYTES = 1 << 20
CHUNK_BYTES = 1 << 18
#: Bytes that are read at a time, and bytes of a header line that are kept.
READ_BYTES, HEADER_BYTES = 1 << 18, 1 << 16
#: Bytes of chunks that a task hands over at a time.
BATCH_BYTES = 1 << 25
#: Fixed values of the format: its version line, and the profile of revisits by equal payload.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
CRLF = "\r\n"


#: Groups of equal payloads up to which their list (some 100 bytes each) is broadcast; more are joined by shuffling.
BROADCAST_GROUPS = 100_000


def classify(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``page_id, url, html`` with payload_bytes, payload_digest, refers_to (null for responses) and ``revisit``."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha2("html", 256)})
    large = F.col("payload_bytes") >= min_revisit
    groups = rows.where(large).groupBy("payload_digest").agg(F.min("page_id").alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    groups = materialize(groups.select("payload_digest", "__first"), "equal-payloads")
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    again = large & F.col("__first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__first"))
    return rows.join(groups, "payload_digest", "left").select(*rows.columns, F.when(again, F.col("__first")).alias("refers_to"), F.coalesce(again, F.lit(False)).alias("revisit"))


def _name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")))


def records(classified: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """One text row for each record or continuation record, without the line end that the writer adds.

    A payload is cut into pieces of bytes in one go; only pieces travel on. A piece may end inside a character: it is written as it is.
    """
    n = F.greatest(F.ceil(F.col("payload_bytes") / segment_bytes), F.lit(1)).cast("int")
    cut = let(F.col("html").cast("binary"), lambda data: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(data, i * segment_bytes + 1, F.lit(segment_bytes))))
    pieces = F.when(F.col("revisit"), F.array(F.lit(b""))).otherwise(cut)
    parts = classified.select("page_id", "url", "payload_bytes", "payload_digest", "refers_to", "revisit", F.when(F.col("revisit"), 1).otherwise(n).alias("__parts"), F.posexplode(pieces).alias("__at", "__piece"))
    first, last, many = F.col("__at") == 0, F.col("__at") + 1 == F.col("__parts"), F.col("__parts") > 1
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.when(first, F.concat(head.cast("binary"), F.col("__piece"))).otherwise(F.col("__piece")).cast("string")
    part = (F.col("__at") + 1).cast("string")
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit(CRLF))
    kind = F.when(F.col("revisit"), "revisit").when(first, "response").otherwise("continuation")
    header = F.concat(
        F.lit(VERSION + CRLF),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(_name(F.col("page_id")), F.when(first, "").otherwise(F.concat(F.lit(":"), part)), F.lit(">"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(F.col("revisit"), F.concat(line("WARC-Refers-To", F.concat(_name(F.col("refers_to")), F.lit(">"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        F.when(many, line("WARC-Segment-Number", part)).otherwise(""),
        F.when(~first, line("WARC-Segment-Origin-ID", F.concat(_name(F.col("page_id")), F.lit(">")))).otherwise(""),
        F.when(many & last, line("WARC-Segment-Total-Length", (F.octet_length(head) + F.col("payload_bytes")).cast("string"))).otherwise(""),
        F.when(first, line("Content-Type", F.lit("application/http; msgtype=response"))).otherwise(""),
        line("Content-Length", F.octet_length("__block").cast("string")),
    )
    return parts.withColumn("__block", block).select(F.concat(header, F.lit(CRLF), F.col("__block"), F.lit(CRLF)).alias("value"))


def write(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Writes the pages as gzip archives into the folder ``path``."""
    records(classify(pages, min_revisit), segment_bytes).write.option("lineSep", CRLF).option("compression", "gzip").text(path)


class RecordStream:
    """Turns an archive's bytes, fed in pieces of any size, into chunk rows. Holds at most a chunk and a header line."""

    def __init__(self, archive: str, chunk_bytes: int, with_data: bool):
        self.archive, self.chunk_bytes, self.with_data = archive, chunk_bytes, with_data
        self.state, self.fields, self.http, self.origin, self.line, self.need = "between", {}, {}, None, bytearray(), 0
        self.rows: list[tuple] = []

    def _emit(self, last: bool, complete: bool = True) -> None:
        f = self.origin
        revisit = f.get("warc-type") == "revisit"
        size, digest = self.offset + len(self.held), self.digest.hexdigest()
        if revisit:
            digest = f.get("warc-payload-digest", "").rpartition(":")[2].lower() or None
            size = int(self.http["content-length"]) if self.http.get("content-length", "").isdigit() else None
        self.rows.append((
            self.archive, f.get("warc-record-id"), f.get("warc-type"), f.get("warc-target-uri"), f.get("warc-refers-to"), self.chunk_no, self.offset, len(self.held),
            size, digest, last, complete, *([bytes(self.held)] if self.with_data else []),
        ))
        self.chunk_no, self.offset, self.held = self.chunk_no + 1, self.offset + len(self.held), bytearray()

    def _payload(self, data: bytes) -> None:
        for at in range(0, len(data), self.chunk_bytes):
            piece = data[at : at + self.chunk_bytes]
            room = self.chunk_bytes - len(self.held)
            for part in (piece[:room], piece[room:]):
                if part:
                    if len(self.held) == self.chunk_bytes:
                        self._emit(False)
                    self.digest.update(part)
                    self.held += part

    def _begin(self) -> None:
        f = self.fields
        self.need = int(f.get("content-length", 0))
        if f.get("warc-type") != "continuation" or self.origin is None:
            if self.origin is not None:
                self._emit(True, False)
            self.origin, self.http = f, {}
            self.digest, self.held, self.chunk_no, self.offset = hashlib.sha256(), bytearray(), 0, 0
        http = f.get("content-type", "").startswith("application/http") and f.get("warc-type") != "continuation"
        self.state = "http" if http else "body"
        if not self.need:
            self._finish()

    def _finish(self) -> None:
        f, self.state = self.fields, "between"
        if "warc-segment-number" not in f or "warc-segment-total-length" in f:
            self._emit(True)
            self.origin = None

    def _field(self, line: bytes) -> tuple[str, str]:
        key, _, value = line.decode("utf-8", "replace").partition(":")
        return key.strip().lower(), value.strip()

    def _end_of_line(self) -> None:
        line = bytes(self.line).rstrip(b"\r\n")
        self.line.clear()
        if self.state == "between":
            if line.startswith(b"WARC/"):
                self.state, self.fields = "head", {}
        elif self.state == "head" and not line:
            self._begin()
        elif self.state == "head":
            key, value = self._field(line)
            self.fields[key] = value
        elif line:
            key, value = self._field(line)
            self.http[key] = value
        else:
            self.state = "body"

    def feed(self, data: bytes) -> None:
        at = 0
        while at < len(data):
            counted = self.state in ("body", "http")  # bytes of the record's block
            end = min(len(data), at + self.need) if counted else len(data)
            if self.state == "body":
                self._payload(data[at:end])
            else:
                newline = data.find(b"\n", at, end)
                end = end if newline < 0 else newline + 1
                if len(self.line) < HEADER_BYTES:
                    self.line += data[at:end]
            if counted:
                self.need -= end - at
            if self.state != "body" and data[end - 1] == 10:
                self._end_of_line()
            if counted and not self.need:
                self.line.clear()
                self._finish()
            at = end

    def end(self) -> None:
        if self.origin is not None:
            self._emit(True, False)
            self.origin = None


_CHUNKS = (
    "archive string, record_id string, record_type string, target_uri string, refers_to string, chunk_no long, offset long, n_bytes long, "
    "payload_bytes long, payload_digest string, last boolean, complete boolean"
)


def _schema(with_data: bool) -> tuple[str, list[str]]:
    schema = _CHUNKS + ", data binary" * with_data
    return schema, [c.split()[0] for c in schema.split(", ")]


def read(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives in ``path``.

    payload_bytes and payload_digest are those of the payload up to and with this chunk; of a revisit record, which has no
    payload, those of the payload that it revisits. ``complete`` is false where an archive ends inside a record.
    """
    schema, names = _schema(with_data)

    def parse(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = None
        for batch in batches:
            rows: list[tuple] = []
            for archive, line in zip(batch["archive"], batch["line"], strict=True):
                if stream is None or stream.archive != archive:
                    if stream is not None:
                        stream.end()
                        rows += stream.rows
                    stream = RecordStream(archive, chunk_bytes, with_data)
                else:
                    stream.feed(b"\r\n")
                stream.feed(bytes(line))
            rows += stream.rows if stream else []
            if stream:
                stream.rows = []
            yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})
        if stream is not None:
            stream.end()
            yield pd.DataFrame(stream.rows, columns=names).astype({"payload_bytes": "Int64"})

    lines = spark.read.option("lineSep", CRLF).text(path).select(F.col("_metadata.file_name").alias("archive"), F.col("value").cast("binary").alias("line"))
    return lines.mapInPandas(parse, schema)


def chunks_of(archive: str, pieces: Iterable[bytes], chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> Iterator[tuple]:
    """Chunk rows of an archive that comes in pieces, as they are made."""
    stream = RecordStream(archive, chunk_bytes, with_data)
    for piece in pieces:
        stream.feed(piece)
        yield from stream.rows
        stream.rows = []
    stream.end()
    yield from stream.rows


def _pieces(path: str) -> Iterator[bytes]:
    from pyarrow import fs

    where, inner = (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if path.startswith("file:") else fs.FileSystem.from_uri(path)
    with where.open_input_stream(inner, compression=None) as raw:
        data = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw  # a member for each record, as archives often have, or one
        while piece := data.read(READ_BYTES):
            yield piece


def read_files(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The same table for archives by any writer, in stores that the tasks themselves can open. A task holds a batch of rows of at most some ``BATCH_BYTES``."""
    schema, names = _schema(with_data)

    def parse(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for archive in batch["path"]:
                for row in chunks_of(archive.rsplit("/", 1)[-1], _pieces(archive), chunk_bytes, with_data):
                    rows.append(row)
                    if len(rows) * chunk_bytes >= BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})
                        rows = []
        yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").load(path).select("path")  # names only: the contents aren't loaded
    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("path")).mapInPandas(parse, schema)


def round_trip(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Writes the pages, reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = fresh(spark, "warc")
    write(pages, path, min_revisit)
    number = lambda c: F.try_element_at(F.split(F.regexp_replace(c, "[<>]", ""), ":"), F.lit(3))
    done = read(spark, path, with_data=False).where(F.col("last"))
    return done.select(
        number(F.col("record_id")).try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).try_cast("long").alias("refers_to"), "target_uri", "complete"
    )
