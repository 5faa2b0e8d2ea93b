"""Document fingerprints (operator 2): a quartile bucket digest.

Triplets of bytes at fixed spacings are hashed into 256 buckets and counted.
The digest holds a length code and, for each bucket, the quartile (0 to 3) in
which its count lies. Two digests are compared by the distance of their
quartiles over the largest distance that they could have, and by their length
codes; the score is bounded to 0..1.

Style: Arrow batches and numpy, since counting bytes has no SQL form. The
texts are shuffled once, by ranges of ``doc_id`` whose bounds are quantiles of
that column; a task streams its sorted rows and holds two texts at a time.

Defined results
---------------
null text: as the empty text, whose digest has all buckets at 0; two empty
texts are alike to 1, an empty and another one to 0.
Repeated ``doc_id``: ordered by text, and among equal texts in any order,
which gives the same values. Null ``doc_id``: after all others. A table of one
row: the row is its own next document. Empty tables: an empty result.
Extra columns do not pass through ``compare_with_next``; ``fingerprint`` keeps
them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import released

BUCKETS = 256
#: Places of a triplet's bytes from a position on. Spacings of more than a syllable tell texts of one language apart.
TRIPLETS = ((0, 4, 9), (0, 7, 15), (0, 11, 13), (0, 5, 17), (0, 13, 23), (0, 6, 19))
SPAN = 1 + max(t[2] for t in TRIPLETS)
#: Length codes grow by one for each so many times longer text.
LENGTH_STEP = 1.1
#: Codes by which lengths may differ freely, and the score that each further one costs.
FREE_STEPS, STEP_COST = 4, 0.02
_M = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
_SALTS = [np.uint32(s * 0x27D4EB2F & 0xFFFFFFFF) for s in range(len(TRIPLETS))]


def bucket_counts(data: bytes, block: int = 1 << 18) -> np.ndarray:
    """How often each bucket is hit; a triplet that reaches over the end sees zero bytes there. Works in blocks, so memory is bounded."""
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(data), block):
        piece = data[at : at + block + SPAN - 1]
        n = min(block, len(data) - at)
        b = np.zeros(n + SPAN - 1, np.uint32)
        b[: len(piece)] = np.frombuffer(piece, np.uint8)
        first = b[:n] * _M[0]
        for (_, j, k), salt in zip(TRIPLETS, _SALTS, strict=True):
            h = first + b[j : j + n] * _M[1]
            h += b[k : k + n] * _M[2]
            h += salt
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            counts += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return counts


def quartiles(counts: np.ndarray) -> np.ndarray:
    edges = BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1
    q = np.partition(counts, edges)
    return (counts > q[edges[0]]).astype(np.uint8) + (counts > q[edges[1]]) + (counts > q[edges[2]])


def digest(data: bytes) -> tuple[int, np.ndarray]:
    """The length code and the quartile of each bucket."""
    return (1 + round(math.log(len(data), LENGTH_STEP)) if data else 0), quartiles(bucket_counts(data))


def to_text(length: int, codes: np.ndarray) -> str:
    """Four hex digits of the length code, then two bits for each bucket."""
    packed = codes[0::4] << 6 | codes[1::4] << 4 | codes[2::4] << 2 | codes[3::4]
    return f"{length:04x}" + packed.astype(np.uint8).tobytes().hex()


def from_text(fingerprint: str) -> tuple[int, np.ndarray]:
    packed = np.frombuffer(bytes.fromhex(fingerprint[4:]), np.uint8)
    return int(fingerprint[:4], 16), np.stack([packed >> s & 3 for s in (6, 4, 2, 0)], axis=1).reshape(-1)


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """1 for equal digests, down to 0."""
    x, y = a[1].astype(np.int64), b[1].astype(np.int64)
    most = int(np.maximum(x, y).sum())
    apart = int(np.abs(x - y).sum()) / most if most else float(a[0] != b[0])
    return max(0.0, 1.0 - apart - STEP_COST * max(0, abs(a[0] - b[0]) - FREE_STEPS))


def fingerprint(docs: DataFrame, text: str = "text", to: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of a text column."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: to_text(*digest((t or "").encode())))

    return docs.withColumn(to, of(F.coalesce(F.col(text), F.lit(""))))


def _range_number(bounds: list[int], value: str) -> Column:
    """How many bounds an expression reaches, by halving; a null reaches all. The bounds are one literal: a tree of conditions would be compiled anew by each executor, and it grows with them."""
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    found = f"aggregate(array({', '.join(map(str, steps))}), 0, (at, step) -> IF(get({_literal(bounds)}, at + step - 1) <= {value}, at + step, at))"
    return F.expr(f"IF({value} IS NULL, {len(bounds)}, {found})")


def _literal(bounds: list[int]) -> str:
    return f"array({', '.join(f'{x}L' for x in bounds)})"


def _edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _row(doc_id, text: str, own, following: str, other) -> tuple:
    changed = _edited(text, following)
    data = changed.encode()
    theirs = digest(data)
    return doc_id, len(text), hashlib.sha256(data).hexdigest(), to_text(*own), to_text(*theirs), likeness(own, theirs), likeness(own, other)


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")], dtype=object)
    return out.astype({"doc_id": "Int64", "n_chars": "int64", "near_edited": "float64", "near_next": "float64"})


def _stream(wraps: bool):
    """The function for a partition: rows come by range, the ones lent from the next range last."""

    def walk(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = None  # (range, lent, doc_id, text, digest)
        for batch in batches:
            out = []
            for number, lent, null, doc_id, text in zip(batch["__range"], batch["__lent"], batch["__null"], batch["doc_id"], batch["text"], strict=True):
                text = text or ""
                if last and last[1] and last[0] == number:
                    continue  # one lent row is enough
                now = (number, lent, None if null else int(doc_id), text, digest(text.encode()))
                if last and not last[1] and last[0] == number:
                    out.append(_row(last[2], last[3], last[4], text, now[4]))
                first, last = first or now, now
            if out:
                yield _frame(out)
        if wraps and last:
            yield _frame([_row(last[2], last[3], last[4], first[3], first[4])])

    return walk


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, compared with each other and with the next document's, by ascending ``doc_id``.

    Ranges of ``doc_id`` begin at ids that exist, so the first row of a range is known by its id and is lent to the range before it.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    probs = [i / parts for i in range(parts)]
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("doc_id").alias("low"), F.percentile_approx("doc_id", probs, 10 * parts).alias("at")).first()
    low, bounds = found["low"], sorted({x for x in found["at"] or [] if x > found["low"]})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    if any(abs(x) >= 1 << 53 for x in bounds):
        # Quantiles are found as doubles: of such ids they are rounded, so each range is moved to the smallest id in it.
        ids = rows.where("doc_id IS NOT NULL").groupBy(_range_number(bounds, "doc_id").alias("n")).agg(F.min("doc_id").alias("first"))
        bounds = sorted(r.first for r in ids.select("first").collect() if r.first > low)
    if not bounds:
        dealt = rows.select(F.lit(0).alias("__range"), F.lit(False).alias("__lent"), "doc_id", "text").coalesce(1)
    else:
        number = F.col("__range")
        # A row begins a range if its id is that range's bound. (The smallest id is none.)
        begins = F.expr(f"get({_literal(bounds)}, __range - 1)") == F.col("doc_id")
        lent = F.when(F.col("doc_id") == low, F.lit(len(bounds))).when(begins, number - 1)
        places = F.array_compact(F.array(F.struct(number.alias("__range"), F.lit(False).alias("__lent")), F.when(lent.isNotNull(), F.struct(lent.alias("__range"), F.lit(True).alias("__lent")))))
        numbered = rows.withColumn("__range", _range_number(bounds, "doc_id"))
        # At most as many ranges as partitions: each gets one of its own, where hashes would put several into some and none into others.
        dealt = numbered.select(F.explode(places).alias("__place"), "doc_id", "text").select("__place.*", "doc_id", "text").repartitionById(parts, F.col("__range"))
    dealt = dealt.sortWithinPartitions("__range", "__lent", F.col("doc_id").asc_nulls_last(), "text")
    # Ids beside nulls would come as doubles.
    dealt = dealt.select("__range", "__lent", F.col("doc_id").isNull().alias("__null"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text")
    return dealt.mapInPandas(released(_stream(not bounds)), _OUT)
