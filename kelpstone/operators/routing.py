"""Choosing shards by predicted latency, and cluster tables."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What a prediction looks at: distance to the shard's centre, requests in the last minute, memory pressure, past P99, search effort.
FEATURES = ["centre_distance", "qps", "memory_pressure", "p99", "effort"]


def train(observed: DataFrame, label: str = "latency", trees: int = 10, depth: int = 3):
    """A gradient-boosted model over observed requests (FEATURES and the label)."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(observed)
    return GBTRegressor(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth, seed=1).fit(rows)


def route(model, offers: DataFrame, query: str = "query_id", shard: str = "shard") -> DataFrame:
    """For each query the shard of least predicted latency; ``offers`` has a row per query and shard."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(offers)
    scored = model.transform(rows).withColumnRenamed("prediction", "predicted")
    rank = F.row_number().over(Window.partitionBy(query).orderBy("predicted", shard))
    return scored.withColumn("__r", rank).where("__r = 1").select(query, shard, "predicted")


def commit_index(matches: DataFrame, term: str = "term", index: str = "match_index") -> DataFrame:
    """What a majority holds: per term, the median (upper) of the nodes' match indexes."""
    return matches.groupBy(term).agg(F.sort_array(F.collect_list(index), asc=False).alias("__all")).select(term, F.get("__all", F.floor(F.size("__all") / 2).cast("int")).alias("commit_index"))


def double_leaders(history: DataFrame) -> DataFrame:
    """Terms with more than one leader; of a sound history, none."""
    led = history.where("role = 'Leader'").select("term", "node").distinct()
    return led.groupBy("term").agg(F.count("*").alias("leaders")).where("leaders > 1")


def topology(shards: DataFrame, health: DataFrame) -> DataFrame:
    """The cluster by shard: its node, and the newest health report of that node."""
    newest = health.groupBy("node").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("reported"))
    return shards.join(newest, "node", "left")
