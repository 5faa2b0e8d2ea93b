"""Tables that cut lineage: written to the folder that all machines share, read back, and deleted when a scope ends."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from ..errors import EngineError
from . import files

#: Paths that the innermost open scope deletes.
_open: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary folder; a cluster has none, which is an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise EngineError("InvalidArgument", "spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="kelpstone-"))
        found = context.getCheckpointDir()
    return found


def fresh(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    if (held := _open.get()) is not None:
        held.append(path)
    return path


def materialize(df: DataFrame, what: str = "cut") -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: later readers start there, also after losing executors."""
    spark = df.sparkSession
    path = fresh(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, when it ends, what was written to the shared folder inside. Results must have been written elsewhere by then, or before it began."""
    held: list[str] = []
    token = _open.set(held)
    try:
        yield
    finally:
        _open.reset(token)
        for path in held:
            files.delete(spark, path)


def settled(spark: SparkSession, what: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, written and read back; the tables that it wrote on its way are deleted."""
    path = fresh(spark, what)
    with scope(spark):
        made = make()
        made.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(made.schema).parquet(path)
