"""Counters, gauges and histograms over observations, and their text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counters(observed: DataFrame, by: list[str | Column], value: str = "value") -> DataFrame:
    return observed.groupBy(*by).agg(F.sum(value).alias("value"))


def gauges(observed: DataFrame, by: list[str | Column], value: str = "value", at: str = "ts") -> DataFrame:
    return observed.groupBy(*by).agg(F.max_by(value, at).alias("value"))


def histogram(observed: DataFrame, by: list[str | Column], bounds: list[float], value: str = "value") -> DataFrame:
    """Cumulative counts by upper bound (``le``), the last being infinite, with sum and count."""
    per = observed.groupBy(*by).agg(
        F.array(*[F.count_if(F.col(value) <= b) for b in bounds], F.count(value)).alias("__counts"), F.sum(value).alias("sum"), F.count(value).alias("count")
    )
    names = F.array(*[F.lit(f"{b:g}") for b in bounds], F.lit("+Inf"))
    keys = [c for c in per.columns if c not in ("__counts", "sum", "count")]
    rows = F.explode(F.arrays_zip(names.alias("le"), F.col("__counts").alias("bucket"))).alias("x")
    return per.select(*keys, "sum", "count", rows).select(*keys, F.col("x.le").alias("le"), F.col("x.bucket").alias("bucket"), "sum", "count")


def exposition(name: str, kind: str, help_text: str, rows: list[dict]) -> str:
    """The text form of a metric family; ``rows`` hold labels (a dict) and value, and for histograms also ``le``."""
    out = [f"# HELP {name} {help_text}", f"# TYPE {name} {kind}"]
    for row in rows:
        labels = dict(row.get("labels") or {})
        suffix = row.get("suffix", "")
        if "le" in row:
            labels["le"] = row["le"]
        text = ",".join(f'{k}="{v}"' for k, v in labels.items())
        out.append(f"{name}{suffix}{{{text}}} {row['value']:g}" if text else f"{name}{suffix} {row['value']:g}")
    return "\n".join(out) + "\n"
