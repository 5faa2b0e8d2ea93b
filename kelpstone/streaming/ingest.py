"""Continuous ingestion: mutations arrive as a stream and give what the batch path gives."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import folds
from ..sources.store import KvTable


def into_table(stream: DataFrame, table: KvTable, checkpoint: str, name: str = "ingest", compact: bool = False, every: str | None = None) -> StreamingQuery:
    """Appends each micro-batch (op, key, value[, seq]) to the table once: the manifest remembers the last batch.

    ``every``: an interval such as "10 seconds", at which a query that goes on starts batches; without it, it takes what is there and ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            table.append(batch, (name, number))
            if compact:
                table.compact_while_due()

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def latest_of_stream(stream: DataFrame, order: str = "lsn") -> DataFrame:
    """Newest version per key as a streaming aggregation; a late mutation with an older number changes nothing."""
    return stream.groupBy("key").agg(F.max_by("value", order).alias("value"), F.max_by("is_tombstone", order).alias("is_tombstone"))


def run_to_memory(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a bounded stream to its end and returns its result table."""
    spark = df.sparkSession
    writer = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    if shared := spark.conf.get("spark.checkpoint.dir", None):  # state goes where all executors see it
        writer = writer.option("checkpointLocation", f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}")
    writer.start().awaitTermination()
    return spark.table(name)


def raft_stream(events: DataFrame) -> DataFrame:
    """The state after each event, kept by node between micro-batches."""

    def fold(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        node = folds.RaftNode(key[0], *(state.get if state.exists else ()))
        rows = pd.concat(list(batches)).sort_values("seq")
        out = folds.raft_rows(node, rows)
        state.update(node.state())
        yield pd.DataFrame(out, columns=[c.split()[0] for c in folds.RAFT_OUT.split(", ")])

    return events.groupBy("node").applyInPandasWithState(fold, folds.RAFT_OUT, "role string, term long, vote string, leader string", "append", GroupStateTimeout.NoTimeout)


def hlc_stream(events: DataFrame) -> DataFrame:
    """Clock values of events, the clock kept by node between micro-batches."""

    def fold(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clock, out = tuple(state.get) if state.exists else (0, 0), []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            clock = folds.hlc_step(clock, r.kind, int(r.physical), None if pd.isna(r.remote_phys) else (int(r.remote_phys), int(r.remote_logical)))
            out.append((key[0], r.seq, *clock))
        state.update(clock)
        yield pd.DataFrame(out, columns=["node", "seq", "phys", "logical"])

    return events.groupBy("node").applyInPandasWithState(fold, "node string, seq long, phys long, logical int", "phys long, logical int", "append", GroupStateTimeout.NoTimeout)


def read_files(spark: SparkSession, path: str, schema, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet folder as a stream; ``files_per_batch`` holds the rate down."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
