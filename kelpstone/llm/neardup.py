"""Near duplicates (operator 8): improved consistent weighted sampling, banded, verified.

A text is a weighted set: its distinct five-word shingles, by term frequency
and inverse document frequency. Consistent weighted sampling draws a signature
in which two texts agree at each place with the probability of their weighted
Jaccard similarity. Places are banded; texts that agree in a band are
candidates; candidates of similarity ``threshold`` or more by their whole sets
are linked; linked texts form classes.

Style: Arrow batches and numpy for shingles and signatures, DataFrame
operations for everything that meets across texts.

Weights. Document frequencies are counted for all documents in 2**20 hash
buckets: an error of at most (shingles per document) / 2**20 of the documents,
at any size of the corpus. The idf factor runs from 1 to 1.2 only: copies made
in thousands make their shingles frequent, and with an unbounded factor the few
words in which they differ would outweigh the text they share.

Verification. In each bucket all texts are compared with its most central one,
blocks of them at a time. What that doesn't join to that one's class is
compared with every other text of the bucket, again in blocks, so that no
candidate pair of different classes is left out; texts of one class need no
further comparison. Neither step emits pairs: each emits links that span what
it found. Blocks are bounded by number and by bytes of texts, and long texts
are compared pair by pair, so that a task holds about 12 bytes for each word of
``LOT_BYTES`` of text, or of the longest text if that is more.

Defined results
---------------
Texts without a word (null and empty ones, too) are duplicates of nothing, each
its own class. Texts of one to four words are a single shingle. Equal texts are
one class. Null or repeated ``doc_id``: each row gets the class of its text; a
class without any id has a null class_id. ``keep`` marks one row per class: the
smallest id, and of rows equal in it the one of the first text by hash; rows
equal in id and text are all marked by ``classes`` and reduced to one by
``deduplicate``. Extra columns are kept by ``deduplicate``. Empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .components import components
from .shared import materialize, released, settled

BANDS, ROWS = 12, 4
THRESHOLD = 0.8
#: Texts that are compared at a time: with a bucket's central text, and later few by many.
STAR, FEW, MANY = 128, 256, 512
#: Bytes of text in such a block; a longer text is one by itself, or nearly.
LOT_BYTES = 1 << 25
#: Texts, and bytes of text, whose shingles are made before they are dealt to their groups.
SLICE, SLICE_BYTES = 512, 1 << 24
#: Shingles that are compared by one table; beyond, texts are compared pair by pair. Also those of one long text that are drawn from at a time.
HELD = 1 << 21
CHUNK = 4096
#: Texts with candidates up to which their list (some 50 bytes each) is broadcast to find them.
BROADCAST_NODES = 200_000

_rng = np.random.default_rng(8)
# The variates of the method by 16 bits of a hash: r and c from Gamma(2, 1), b uniform.
_R = _rng.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
_LOG_C = np.log(_rng.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
_B = ((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)
_ODD = [np.uint64(int(x) | 1) for x in _rng.integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.int64)]
_LOW = np.uint64(0xFFFF)


def _draw(odd: np.uint64, shingle: np.ndarray, log_weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For one place of the signature, each shingle's variate (the smallest is drawn) and its level."""
    h = shingle * odd
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    r, b = _R[h & _LOW], _B[(h >> np.uint64(16)) & _LOW]
    t = np.floor(log_weight / r + b)
    return _LOG_C[(h >> np.uint64(32)) & _LOW] - r * (t - b + np.float32(1)), t


def signatures(of: np.ndarray, shingle: np.ndarray, log_weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of a block that have words, and the band hashes of each (texts x BANDS)."""
    starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if of[0] != of[-1] else np.zeros(1, np.int64)
    out = np.zeros((len(starts), BANDS), np.uint64)
    owner = None if len(starts) == 1 else np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(of))))
    chosen = np.zeros(len(starts), np.int64)
    for k, odd in enumerate(_ODD):
        if owner is None:  # one text, of any length
            best, level = np.inf, np.zeros(1, np.float32)
            for at in range(0, len(of), HELD):
                log_a, t = _draw(odd, shingle[at : at + HELD], log_weight[at : at + HELD])
                first = int(log_a.argmin())
                if log_a[first] < best:
                    best, level, chosen[0] = log_a[first], t[first : first + 1], at + first
        else:
            log_a, t = _draw(odd, shingle, log_weight)
            least = np.minimum.reduceat(log_a, starts)
            found = np.flatnonzero(log_a == least[owner])[::-1]
            chosen[owner[found]] = found  # of equal ones, the first
            level = t[chosen]
        value = S.mixed(shingle[chosen] * np.uint64(3) + level.astype(np.int64).astype(np.uint64) + np.uint64(k))
        out[:, k // ROWS] = S.mixed(out[:, k // ROWS] * np.uint64(0x9E3779B97F4A7C15) + value)
    return of[starts], out


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents by hash bucket of their shingles (2**20 counts, whatever the input), and documents with words."""

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, n = np.zeros(1 << S.DF_BITS, np.int32), 0
        for batch in batches:
            for _, of, hashes in S.blocks(batch["text"].tolist()):
                owner, shingle, _ = S.elements(of, hashes)
                counts += np.bincount(S.bucket(shingle), minlength=len(counts)).astype(np.int32)
                n += len(np.unique(owner))
        if n:
            parts = [counts[at : at + CHUNK].astype("<i4").tobytes() for at in range(0, len(counts), CHUNK)]
            yield pd.DataFrame({"chunk": [*range(len(parts)), -1], "counts": [*parts, np.array([n], "<i4").tobytes()]})

    def total(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch["chunk"], batch["counts"], strict=True):
                part = np.frombuffer(data, "<i4").astype(np.int64)
                sums[chunk] = sums[chunk] + part if chunk in sums else part
        yield pd.DataFrame({"chunk": list(sums), "counts": [x.tobytes() for x in sums.values()]})

    schema = "chunk int, counts binary"
    rows = docs.select("text").mapInPandas(released(count), schema).repartition("chunk").mapInPandas(released(total), schema).collect()
    counts, n = np.zeros(1 << S.DF_BITS, np.int64), 0
    for r in rows:
        part = np.frombuffer(bytes(r.counts), "<i8")
        if r.chunk < 0:
            n = int(part[0])
        else:
            counts[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = part
    return counts, n


def sketched(docs: DataFrame, idf) -> DataFrame:
    """(doc_id, node, size, bands): node is the hash of the text, size its bytes; bands is null for texts without words. ``idf``: a broadcast table."""

    def sign(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bands: list = [None] * len(batch)
            for first, of, hashes in S.blocks(batch["text"].tolist()):
                owner, shingle, times = S.elements(of, hashes)
                if len(owner):
                    log_weight = np.log(S.weights(shingle, times, idf.value))
                    texts, found = signatures(owner, shingle, log_weight)
                    for t, row in zip(texts, found.view(np.int64), strict=True):
                        bands[first + t] = row
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "node": batch["node"], "size": batch["size"], "bands": bands})

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("node"), size, "text")
    return rows.mapInPandas(released(sign), "doc_id long, node binary, size long, bands array<long>")


def _shared(a: tuple, b: tuple) -> float:
    """The weight that two sets (.., shingles in order, weights, ..) share; the smaller is looked up in the larger."""
    if len(a[2]) > len(b[2]):
        a, b = b, a
    total = 0.0
    for at in range(0, len(a[2]), HELD):
        mine = a[2][at : at + HELD]
        place = np.minimum(np.searchsorted(b[2], mine), len(b[2]) - 1)
        found = np.flatnonzero(b[2][place] == mine)
        total += float(np.minimum(a[3][at : at + HELD][found], b[3][place[found]]).sum(dtype=np.float64))
    return total


def _lots(number, size, most: int):
    """Into how many lots texts are dealt, by their number and their bytes."""
    return F.ceil(number / most + 2 * size / LOT_BYTES).cast("int")


def _compare(idf, threshold: float):
    """The function for partitions of rows (group, side, node, text), sorted by group: compares each text of side 0 with all of side 1."""

    def common(few: list[tuple], many: list[tuple]) -> Iterator[np.ndarray]:
        """For each of ``few``, the weight that it shares with each of ``many``."""
        if sum(len(s[2]) for s in (*few, *many)) > HELD:  # long texts, so few of them: one pair at a time
            for a in few:
                yield np.array([_shared(a, b) for b in many])
            return
        _, where = np.unique(np.concatenate([s[2] for s in few] + [s[2] for s in many]), return_inverse=True)
        cut = sum(len(s[2]) for s in few)
        columns, starts = where[cut:], np.cumsum([0, *(len(s[2]) for s in many[:-1])])
        heavy = np.concatenate([s[3] for s in many])
        dense = np.zeros(where.max() + 1, np.float32)
        at = 0
        for a in few:
            mine = where[at : at + len(a[2])]
            at += len(mine)
            dense[mine] = a[3]
            yield np.add.reduceat(np.minimum(dense[columns], heavy).astype(np.float64), starts)
            dense[mine] = 0

    def links(sets: list[tuple], out: list[tuple]) -> None:
        few, many = [s for s in sets if s[0] == 0], [s for s in sets if s[0] == 1]
        if not few or not many:
            return
        sums = np.array([s[4] for s in many])
        up = {}

        def top(x):
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        for (_, node, _, _, size), both in zip(few, common(few, many), strict=True):
            for j in np.flatnonzero(both >= threshold * (size + sums - both) - 1e-6):
                a, b = top(node), top(many[j][1])
                if a != b:  # a link that joins what the group's links so far don't
                    up[max(a, b)] = min(a, b)
                    out.append((node, many[j][1], float(both[j] / (size + sums[j] - both[j]))))

    def slices(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lot = np.cumsum([len(t) for t in batch["text"]]) // SLICE_BYTES if len(batch) else np.zeros(0, np.int64)
            for _, part in batch.groupby(lot, sort=True):
                for at in range(0, len(part), SLICE):
                    yield part.iloc[at : at + SLICE].reset_index(drop=True)

    def walk(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, sets = None, []
        for batch in slices(batches):
            out: list[tuple] = []
            parts: dict[int, tuple] = {}
            for first, of, hashes in S.blocks(batch["text"].tolist()):
                owner, shingle, times = S.elements(of, hashes)
                weight = S.weights(shingle, times, idf.value)
                begins = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else []
                for low, high in zip(begins, [*begins[1:], len(owner)], strict=True):
                    parts[first + int(owner[low])] = (shingle[low:high], weight[low:high], float(weight[low:high].sum(dtype=np.float64)))
            for i, (key, side, node) in enumerate(zip(batch["group"], batch["side"], batch["node"], strict=True)):
                if key != group:
                    links(sets, out)
                    group, sets = key, []
                if i in parts:
                    sets.append((side, bytes(node), *parts[i]))
            yield pd.DataFrame(out, columns=["a", "b", "similarity"])
        out = []
        links(sets, out)
        yield pd.DataFrame(out, columns=["a", "b", "similarity"])

    return walk


def _verified(rows: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """Links among rows (group, side, node): groups are bounded, texts are joined to them by node."""
    with_text = rows.join(texts, "node").select("group", "side", "node", "text")
    dealt = with_text.repartition("group").sortWithinPartitions("group", "side")
    return dealt.mapInPandas(released(_compare(idf, threshold)), "a binary, b binary, similarity double")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, node, class_id, keep) for each row of ``docs``. The tables on the way there are deleted when it is written."""
    return settled(docs.sparkSession, "classes", lambda: _classes(docs, threshold))


def _classes(docs: DataFrame, threshold: float) -> DataFrame:
    spark = docs.sparkSession
    counts, n_docs = frequencies(docs)
    idf = spark.sparkContext.broadcast(S.idf_table(counts, n_docs))  # 4 MB at any size
    rows = materialize(sketched(docs, idf), "sketches")
    signed = rows.where(F.col("bands").isNotNull())
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    placed = materialize(nodes.select("node", "rep", "size", F.posexplode("bands").alias("band", "hash")).select("node", "rep", "size", F.xxhash64("band", "hash").alias("bucket")), "bands")
    # A bucket's first text is the one that shares most buckets with most others: of copies of one original, that is the original or near it.
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(placed.join(sizes, "bucket"), "shared-bands")
    central = shared.groupBy("node").agg(F.sum("n").alias("score"))
    scored = materialize(shared.join(central, "node"), "scored-bands")
    leaders = scored.groupBy("bucket").agg(F.max(F.struct("score", "node"))["node"].alias("leader"))
    members = materialize(scored.join(leaders, "bucket").select("node", "rep", "size", "bucket", "n", "leader"), "candidates")

    # One text for each node that has candidates. Its row is found by id and hash.
    wanted = materialize(members.select(F.col("node").alias("__node"), F.col("rep").alias("__rep")).distinct(), "wanted-texts")
    if wanted.count() <= BROADCAST_NODES:  # the texts stay where they are; beyond, both sides are shuffled by node
        wanted = F.broadcast(wanted)
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("node"), "text")
    found = hashed.join(wanted, (F.col("node") == F.col("__node")) & F.col("doc_id").eqNullSafe(F.col("__rep")))
    texts = materialize(found.select("node", "text").dropDuplicates(["node"]), "candidate-texts")

    # Every text with the first one of each of its buckets.
    pairs = members.where(F.col("node") != F.col("leader")).select("leader", "node", "size").distinct()
    degree = pairs.groupBy("leader").agg(_lots(F.count("*"), F.sum("size"), STAR).alias("lots"))
    degree = materialize(degree, "leaders")
    star = F.xxhash64("leader", "lot").alias("group")
    others = pairs.join(degree, "leader").select("leader", "node", F.pmod(F.xxhash64("node"), F.col("lots")).cast("int").alias("lot")).select(star, F.lit(1).alias("side"), "node")
    leaders = degree.select("leader", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot")).select(star, F.lit(0).alias("side"), F.col("leader").alias("node"))
    links = materialize(_verified(others.unionByName(leaders), texts, idf, threshold), "star-links")
    labels = components(links)

    # What a bucket's first class doesn't hold, with everything in the bucket.
    named = labels.select(F.col("node").alias("__n"), "label")
    label = F.coalesce("label", "node")
    mine = members.where("n > 2").join(named, F.col("node") == F.col("__n"), "left").select("bucket", "node", "size", "leader", label.alias("label"))
    first = labels.select(F.col("node").alias("__l"), F.col("label").alias("__first"))
    mine = mine.join(first, F.col("leader") == F.col("__l"), "left").select("bucket", "node", "size", "leader", (F.col("label") != F.coalesce("__first", "leader")).alias("apart"))
    mine = materialize(mine.where(F.col("node") != F.col("leader")), "bucket-classes")
    apart = F.coalesce(F.sum(F.when(F.col("apart"), F.col("size"))), F.lit(0))
    sizes = mine.groupBy("bucket").agg(F.count_if("apart").alias("few"), apart.alias("few_bytes"), F.count("*").alias("many"), F.sum("size").alias("many_bytes")).where((F.col("few") > 0) & (F.col("many") > 1))
    sizes = sizes.select("bucket", _lots(F.col("few"), F.col("few_bytes"), FEW).alias("few"), _lots(F.col("many"), F.col("many_bytes"), MANY).alias("many"))
    cut = mine.join(sizes, "bucket")
    at = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    by_few = cut.where("apart").select("bucket", F.lit(0).alias("side"), "node", at("few").alias("i"), F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("j"))
    by_many = cut.select("bucket", F.lit(1).alias("side"), "node", F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("i"), at("many").alias("j"))
    rest = by_few.unionByName(by_many).select(F.xxhash64("bucket", "i", "j").alias("group"), "side", "node")
    more = materialize(_verified(rest, texts, idf, threshold), "rest-links")
    if not more.isEmpty():
        labels = components(links.select("a", "b").unionByName(more.select("a", "b")))

    named = labels.select(F.col("node").alias("__n"), "label")
    by_node = nodes.select("node", "rep").join(named, F.col("node") == F.col("__n"), "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    by_node = materialize(by_node, "node-classes")
    # The class's id, and the text that stands for it, by (id, hash).
    best = by_node.groupBy("label").agg(F.min("rep").alias("class_id"))
    chosen = by_node.join(best, "label").select("node", "label", "class_id", F.col("rep").eqNullSafe(F.col("class_id")).alias("may"))
    stands = chosen.where("may").groupBy("label").agg(F.min("node").alias("stands"))
    told = chosen.join(stands, "label").select(F.col("node").alias("__n"), "class_id", (F.col("node") == F.col("stands")).alias("stands"))
    joined = rows.select("doc_id", "node", F.col("bands").isNull().alias("empty")).join(told, F.col("node") == F.col("__n"), "left")
    alone = F.col("empty") | F.col("__n").isNull()
    return joined.select(
        "doc_id",
        "node",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        (alone | (F.col("stands") & F.col("doc_id").eqNullSafe(F.col("class_id")))).alias("keep"),
    )


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, columns as in ``docs``."""
    kept = classes(docs, threshold).where("keep").select(F.col("doc_id").alias("__id"), F.col("node").alias("__node")).distinct()
    hashed = docs.withColumn("__of", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    found = hashed.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__of") == F.col("__node")), "left_semi")
    # Rows equal in id and text are copies of one another; those without a word stay as they are.
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    one = found.where(worded).dropDuplicates(["doc_id", "__of"])
    return one.unionByName(found.where(~worded)).select(*[F.col(f"`{c}`") for c in docs.columns])
