"""Where stored tables lie, and that they can be deleted."""

import os
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from stratafold.operators import storage
from stratafold.plans import catalogue, registry


def test_a_cluster_needs_a_shared_folder():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(session)


def test_stored_tables_are_deleted(spark):
    df = storage.stored(spark.range(5), "numbers")
    path = df.inputFiles()[0].removeprefix("file:").lstrip("/").rsplit("/", 1)[0]
    assert df.count() == 5 and os.path.isdir(f"/{path}")
    assert storage.clear_stored(spark) >= 1 and not os.path.isdir(f"/{path}")


def test_stored_tables_leave_no_shuffle_files(spark):
    files = lambda: {x.rsplit("/", 1)[-1] for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    counts = spark.range(100_000).groupBy((F.col("id") % 7000).alias("k")).count()
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, conf = files(), spark.conf.get(cleanup, None)
    rows = storage.stored(counts, "counts")
    for _ in range(50):  # they are deleted in the background
        left = files() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and rows.count() == 7000 and spark.conf.get(cleanup, None) == conf
    storage.dropped(rows)
    assert not os.path.isdir(rows.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])


def test_query_names_are_unique():
    name = next(iter(catalogue.queries()))
    with pytest.raises(ValueError, match=name):
        registry.demo()(SimpleNamespace(__name__=name))
