"""The shared folder for tables that cut lineage."""

import pytest

from kelpstone.errors import EngineError
from kelpstone.sources import files, scratch


def test_a_scope_deletes_what_was_written_in_it(spark):
    kept = scratch.fresh(spark, "kept")
    with scratch.scope(spark):
        inner = scratch.materialize(spark.range(5))
        paths = {f.rsplit("/", 1)[0] for f in inner.inputFiles()}
        inner.write.parquet(kept)
        with scratch.scope(spark):
            deeper = scratch.fresh(spark, "deeper")
            spark.range(1).write.parquet(deeper)
        assert not files.exists(spark, deeper) and all(files.exists(spark, p) for p in paths)
    assert not any(files.exists(spark, p) for p in paths)
    assert spark.read.parquet(kept).count() == 5


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(EngineError):
        scratch.shared_dir(Session())
