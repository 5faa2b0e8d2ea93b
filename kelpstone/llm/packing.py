"""Packing tokenised documents into sequences (operator 4): shortest pack first over the length histogram.

Documents are tokenised, an end id is added, and what exceeds a sequence is cut
off as full pieces. The remaining pieces are counted by length. Lengths are
placed longest first: each goes into the packs that are filled least, as many
packs at a time as there are pieces; where none has room, new packs are opened
and filled with as many pieces of that length as they hold. The result is a
list of slots, each a run of ranks among the pieces of one length; the pieces
are ranked by a seeded hash and joined to the slots by rank.

Style: tokenising is Python over Arrow batches; everything after it is
DataFrame operations on piece rows, which carry no text.

Defined results
---------------
null or empty text: no ids but the end id, so one piece of length 1. Repeated
ids and rows: each row is a document and gets its own pieces. Null ``doc_id``
is kept. Texts of any length: a document's ids are held as one byte string, its
pieces are written as they are cut. Extra columns are dropped. An empty table
gives an empty result.

Scale
-----
The histogram has at most ``seq_len`` rows on the driver, whatever the
input. Pieces of one length are dealt into ``SALTS`` parts by hash for
ranking, so a length that a third of all pieces share is ranked in many
tasks. The slots are at most a few for each length and are broadcast if under
``BROADCAST_SLOTS``; else they are joined by shuffling.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize, released
from .wordbpe import encoder_of, unreachable

SEQ_LEN = 2048
END_ID = 1
SALTS = 128
SEED = 40_009
BROADCAST_SLOTS = 200_000


def pieces(docs: DataFrame, tokenizer_file: str, seq_len: int = SEQ_LEN, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): the document's ids, cut into full sequences and a rest."""
    spark = docs.sparkSession
    # The definition is a fixed file of a few MB; sent once, so that workers need no such file.
    definition = Path(tokenizer_file).read_text(encoding="utf-8")
    sent = spark.sparkContext.broadcast((definition, unreachable(definition)))
    end = int(end_id).to_bytes(4, "little")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(*sent.value)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encoder.encode(text or "") + end
                for at in range(0, len(ids), 4 * seq_len):
                    piece = ids[at : at + 4 * seq_len]
                    row = (None if pd.isna(doc_id) else int(doc_id), at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4)
                    out.append((*row, piece) if with_ids else row)
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(released(cut), schema)


def slots(histogram: dict[int, int], seq_len: int = SEQ_LEN) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first_rank, end_rank, each, first_sequence, offset).

    The pieces of that length with ranks from first_rank on lie ``each`` to a sequence, one after the other from ``offset`` on,
    in the sequences from first_sequence on.
    """
    out: list[tuple[int, int, int, int, int, int]] = []
    packs: list[tuple[int, int, int]] = []  # (-room, first sequence, how many): the shortest packs first
    sequences = 0

    def place(length: int, rank: int, each: int, first: int, n: int, room: int) -> None:
        out.append((length, rank, rank + n * each, each, first, seq_len - room))
        if room > each * length:
            heapq.heappush(packs, (each * length - room, first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left and packs and -packs[0][0] >= length:
            room, first, n = heapq.heappop(packs)
            if n > left:
                heapq.heappush(packs, (room, first + left, n - left))
                n = left
            place(length, rank, 1, first, n, -room)
            left, rank = left - n, rank + n
        each = seq_len // length
        for lot, n in ((each, left // each), (left % each, 1)):
            if lot and n:
                place(length, rank, lot, sequences, n, seq_len)
                sequences, rank = sequences + n, rank + n * lot
    return out


def pack(found: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """``found`` (rows of ``pieces``, in a written table) with sequence_id and offset."""
    spark = found.sparkSession
    rank_by = F.xxhash64(F.lit(SEED), "doc_id", "start", "ids_crc32")
    rows = found.withColumn("__by", rank_by).withColumn("__salt", F.pmod("__by", F.lit(SALTS)).cast("int"))
    parts = rows.groupBy("length", "__salt").agg(F.count("*").alias("n"))
    counted = materialize(parts, "piece-lengths")  # at most seq_len times SALTS rows
    histogram = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed = spark.createDataFrame(slots(histogram, seq_len), "__length long, __first long, __end long, __each long, __sequence long, __offset long")
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("length", "__salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    ranked = rows.withColumn("__row", F.row_number().over(Window.partitionBy("length", "__salt").orderBy("__by", "doc_id", "start")))
    ranked = ranked.join(offsets, ["length", "__salt"]).withColumn("__rank", F.col("__before") + F.col("__row") - 1)
    if len(histogram) and placed.count() <= BROADCAST_SLOTS:
        placed = F.broadcast(placed)
    k = F.col("__rank") - F.col("__first")
    joined = ranked.join(placed, (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__end")))
    return joined.select(
        *found.columns,
        (F.col("__sequence") + F.floor(k / F.col("__each"))).cast("long").alias("sequence_id"),
        (F.col("__offset") + F.pmod(k, F.col("__each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_file: str, seq_len: int = SEQ_LEN, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return pack(materialize(pieces(docs, tokenizer_file, seq_len, end_id, with_ids), "pieces"), seq_len)
