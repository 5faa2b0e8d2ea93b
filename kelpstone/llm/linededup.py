"""Cross-site line removal by distinct-site spread (operator 5): DataFrame functions only.

Each line is hashed. HyperLogLog sketches of the sites that carry it are built
per line hash, map side first, and merged by the aggregation. Lines whose
estimate lies near the threshold get an exact count of distinct sites. Lines on
at least ``min_sites`` sites are boilerplate and are removed everywhere, but
from documents that consist of such lines wholly: those are copies of one
another, which is the near-duplicate operator's matter, not page furniture. A
document with a line of its own keeps that line and loses the others, whatever
their share; this holds for a copy with an altered line, too.

Defined results
---------------
null text: stays null; empty text: stays empty. Lines without a word are
neither counted nor removed. Lines count whatever their length, and without
the white space around them, so that a line with a carriage return or a tab is
the same line. A null site counts as a site of its own. Null or repeated ``doc_id``
and repeated rows: each row is treated by its text. Extra columns pass
through. An empty table gives an empty table.

Scale
-----
Of the corpus, only hashes are shuffled for counting: one row for each
line hash and task (``hll_sketch_agg`` combines map side, so a line in a third
of all rows is one row per task), and one for each line hash and site. The
texts are shuffled once, by document and text hash, to meet their removals. Joins by line hash have
few rows per key on one side, and none is followed by work that needs all rows
of a key together, so skewed line hashes can be split at run time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, NOT_SPACE, let, materialize


@dataclass(frozen=True)
class SpreadRules:
    #: Distinct sites from which on a line is boilerplate.
    min_sites: int = 5
    #: log2 of the sketch's registers: a standard error of about 1.6 % at 12.
    lg_k: int = 12
    #: Estimates within this share of the threshold (and within 2) are counted exactly.
    near: float = 0.1


#: The default rules, by the name under which the pipeline knows them.
ANY_LENGTH = SpreadRules()


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hashes(text: Column) -> Column:
    """The distinct hashes of a text's lines that have a word."""
    return F.array_distinct(F.transform(F.filter(_lines(F.coalesce(text, F.lit(""))), _worded), _hash))


def _worded(line: Column) -> Column:
    return line.rlike(NOT_SPACE)


def _hash(line: Column) -> Column:
    """Of a line without the white space around it; only hashes travel, so a line's length costs nothing."""
    return F.xxhash64(F.btrim(line, F.lit(BLANKS)))


def line_sites(docs: DataFrame, site: str = "source") -> DataFrame:
    """A row (line, site) for each distinct countable line of each document; ``line`` is the line's 64-bit hash."""
    # A null site is told from every site by its prefix.
    return docs.select(F.when(F.col(site).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(site).cast("string"))).alias("site"), F.explode(_hashes(F.col("text"))).alias("line"))


def spread(docs: DataFrame, rules: SpreadRules = SpreadRules(), site: str = "source") -> DataFrame:
    """(line, n_docs, sites_estimate, sites): ``sites`` is exact near the threshold and the rounded estimate elsewhere.

    Only lines in at least ``min_sites`` documents appear; others can't be on that many sites.
    """
    pairs = line_sites(docs, site)
    sketched = pairs.groupBy("line").agg(F.count("*").alias("n_docs"), F.hll_sketch_agg("site", F.lit(rules.lg_k)).alias("sketch"))
    estimated = sketched.where(F.col("n_docs") >= rules.min_sites).select("line", "n_docs", F.hll_sketch_estimate("sketch").alias("sites_estimate"))
    estimated = materialize(estimated, "line-sketches")
    margin = max(2.0, rules.near * rules.min_sites)
    near = F.abs(F.col("sites_estimate") - rules.min_sites) <= margin
    exact = pairs.distinct().join(estimated.where(near).select("line"), "line", "left_semi").groupBy("line").agg(F.count("*").alias("exact"))
    return estimated.join(exact, "line", "left").select("line", "n_docs", "sites_estimate", F.coalesce("exact", F.round("sites_estimate").cast("long")).alias("sites"))


def boilerplate(docs: DataFrame, rules: SpreadRules = SpreadRules(), site: str = "source") -> DataFrame:
    return spread(docs, rules, site).where(F.col("sites") >= rules.min_sites)


def remove(docs: DataFrame, rules: SpreadRules = SpreadRules(), site: str = "source") -> DataFrame:
    """``docs`` with ``clean_text``, ``n_removed`` (lines) and ``copied`` (left alone, as it has no other lines with a word)."""
    bad = materialize(boilerplate(docs, rules, site).select("line"), "boilerplate-lines")
    own = docs.columns
    key = F.xxhash64("text")
    # The removals of a document depend on its text only; its id keeps equal texts apart, so that no group of copies meets in one place.
    seen = docs.select(F.col("doc_id").alias("__id"), key.alias("__key"), F.explode(_hashes(F.col("text"))).alias("line"))
    found = seen.join(bad, "line").groupBy("__id", "__key").agg(F.collect_set("line").alias("__bad"))
    joined = docs.withColumn("__key", key).join(found.withColumnRenamed("__key", "__of"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__of")), "left")

    def cut(lines: Column) -> Column:
        good = F.filter(lines, lambda x: ~(_worded(x) & F.array_contains(F.col("__bad"), _hash(x))))
        return let(good, lambda kept: F.struct(F.array_join(kept, "\n").alias("text"), (F.size(lines) - F.size(kept)).alias("n"), (~F.exists(kept, _worded)).alias("copied")))

    cutting = F.when(F.col("__bad").isNotNull() & F.col("text").isNotNull(), let(_lines(F.col("text")), cut))
    out = joined.select(*[F.col(f"`{c}`") for c in own if c not in ("clean_text", "n_removed", "copied")], cutting.alias("__cut"))
    copied = F.coalesce(F.col("__cut.copied"), F.lit(False))
    return out.select(
        *[F.col(f"`{c}`") for c in out.columns if c != "__cut"],
        F.when(F.col("__cut").isNull() | copied, F.col("text")).otherwise(F.col("__cut.text")).alias("clean_text"),
        F.when(F.col("__cut").isNull() | copied, 0).otherwise(F.col("__cut.n")).cast("long").alias("n_removed"),
        copied.alias("copied"),
    )


def clean(docs: DataFrame, rules: SpreadRules = SpreadRules(), site: str = "source") -> DataFrame:
    """``docs`` with cleaned texts; columns as in ``docs``."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__row"), "doc_id", "text", site)
    done = remove(packed, rules, site)
    own = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")}
    return done.select(*[own.get(c, F.col("__row").getField(c)).alias(c) for c in docs.columns])
