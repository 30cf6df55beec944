"""Tables that cut the lineage of iterative operators, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession

_STORED: set[str] = set()
#: Where each stored table that is still held lies.
_PLACE: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: While this holds, Spark deletes the shuffle files of a query once it is done; else they stay until the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.

    Where it is unset and Spark runs in one local process, as in tests, a folder of our own becomes it.
    On a cluster an unset folder is an error, for executors do not see each other's disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="stratafold-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _written(parts: Iterable[DataFrame], name: str, spark: SparkSession) -> DataFrame:
    path, schema = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", None
    _STORED.add(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        for df in parts:
            df.write.mode("append").parquet(path)
            schema = schema or df.schema
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    rows = spark.read.schema(schema).parquet(path)
    _PLACE[rows] = path
    return rows


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read back: later reads depend on no executor, and on no shuffle file."""
    return _written([df], name, df.sparkSession)


def cut_in_rounds(make: Callable[[int], DataFrame], rounds: int, spark: SparkSession) -> DataFrame:
    """``make(k)`` of each round, stored as one table; the shuffle files of a round are deleted once it is written."""
    return _written(map(make, range(rounds)), "cut", spark)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` returned and that nothing reads any more: neither a later step nor the result."""
    for rows in tables:
        path = _PLACE.pop(rows)
        _STORED.discard(path)
        _delete(rows.sparkSession, path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` stored under a name of no meaning."""
    return stored(df, "cut")


def cut_and_count(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """``df`` stored, and the number of its stored rows for which ``condition`` holds."""
    rows = cut(df)
    return rows, rows.filter(condition).count()


def clear_stored(spark: SparkSession) -> int:
    """Deletes all tables that this process has stored so far, and returns their number.

    Results that are still to be computed may read them, so call it once results are written or collected.
    """
    number = len(_STORED)
    for path in sorted(_STORED):
        _delete(spark, path)
    _STORED.clear()
    return number
