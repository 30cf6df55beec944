"""A table of rows with stable ids, kept by a stream of new rows."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.operators.incremental import upsert
from stratafold.operators.storage import cut


class Deltas:
    """A table of rows with ids as what each batch changed, in a folder that all executors share.

    A batch writes its own rows alone, with its number; of an id's rows the latest counts. Every ``fan`` folders of
    one level are merged into one of the next, without rows that were replaced, so a row is written again once
    a level, and a table of n batches has ``fan`` times log n folders at most. Which folders count after a batch follows from its
    number, so a batch that is run again after a failure reads what it read before and gives the same rows;
    folders that a merge has replaced are deleted with the next batch.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, row_id: str, fan: int = 8) -> None:
        self.spark, self.folder, self.row_id, self.fan = spark, folder, row_id, fan
        self.schema = f"{schema}, `__batch` long"

    def _parts(self, batches: int) -> list[tuple[int, int]]:
        """(level, last batch) of the folders that hold the first ``batches`` batches: the digits of their number."""
        parts, done, level = [], 0, 0
        while self.fan ** (level + 1) <= batches:
            level += 1
        for k in range(level, -1, -1):
            while done + self.fan**k <= batches:
                done += self.fan**k
                parts.append((k, done - 1))
        return parts

    def _path(self, part: tuple[int, int]) -> str:
        return f"{self.folder}/level={part[0]}/batch={part[1]}"

    def _rows(self, parts: list[tuple[int, int]]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*map(self._path, parts))

    def _latest(self, rows: DataFrame) -> DataFrame:
        columns = [c for c in rows.columns if c not in (self.row_id, "__batch")]
        return rows.groupBy(self.row_id).agg(F.max_by(F.struct(*columns, "__batch"), "__batch").alias("r")).select(self.row_id, "r.*")

    def read(self, batch: int) -> DataFrame:
        """The table after ``batch``; empty before the first."""
        return self._latest(self._rows(self._parts(batch + 1))).drop("__batch")

    def touched(self, batch: int, keys: dict[str, DataFrame]) -> DataFrame:
        """Those rows after ``batch`` that hold one of the values of a column, of which ``keys`` has a table each."""
        rows = self._rows(self._parts(batch + 1))
        ids = reduce(DataFrame.union, [rows.join(values, column, "left_semi").select(self.row_id) for column, values in keys.items()]).distinct()
        return self._latest(rows.join(ids, self.row_id, "left_semi")).drop("__batch")

    def top(self, batch: int) -> int:
        return self._rows(self._parts(batch + 1)).agg(F.coalesce(F.max(self.row_id), F.lit(0))).first()[0]

    def write(self, df: DataFrame, batch: int) -> None:
        """Writes what ``batch`` changed, and merges the folders that it makes full."""
        before, now = set(self._parts(batch - 1)) if batch else set(), set(self._parts(batch))
        # A merge into one level went through folders of all levels below.
        for part in (before - now) | {(k, last) for level, last in now - before for k in range(level)}:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(part))
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        df.withColumn("__batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(self._path((0, batch)))
        level = 0
        while (batch + 1) % self.fan ** (level + 1) == 0:
            step = self.fan**level
            own = [(level, batch - k * step) for k in range(self.fan)]
            self._latest(self._rows(own)).write.mode("overwrite").parquet(self._path((level + 1, batch)))
            level += 1


def stream_upsert(stream: DataFrame, folder: str, row_id: str, path: str, guid: str, fan: int = 8) -> DataFrame:
    """The table of all rows (row_id, path, guid, ...) that ``stream`` has brought, after what is there now is read.

    Rows keep their id by path, else by guid; a path that comes again is replaced, rows that do not come
    again stay. Rows with a null path are left out; of rows that share a path in a batch the one with the
    largest guid stays. Starting again with the same folder goes on where the last run ended. A batch
    writes what it brings; see ``Deltas``.
    """
    spark = stream.sparkSession
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    table = Deltas(spark, f"{folder}/table", f"{fields}, `{row_id}` long", row_id, fan)
    seen = {"last": -1}

    def merge(batch: DataFrame, number: int) -> None:
        merge_batch(table, batch, number, path, guid)
        seen["last"] = number

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).queryName(f"q{uuid.uuid4().hex}").start()
    query.awaitTermination()
    if seen["last"] < 0:
        # Nothing new came: the last version is that of the last batch in the checkpoint.
        done = spark.read.format("text").load(f"{folder}/checkpoint/commits").select(F.regexp_extract("_metadata.file_path", r"(\d+)$", 1).cast("int").alias("n"))
        seen["last"] = done.agg(F.coalesce(F.max("n"), F.lit(-1))).first()[0]
    return table.read(seen["last"])


def merge_batch(table: Deltas, batch: DataFrame, number: int, path: str, guid: str) -> None:
    """Writes the rows of ``batch`` with their ids to ``table``; only rows that share a path or a guid with it are looked up."""
    columns = [c for c in batch.columns if c != path]
    new = cut(batch.filter(F.col(path).isNotNull()).groupBy(path).agg(F.max_by(F.struct(*columns), F.struct(F.coalesce(guid, F.lit("")), F.xxhash64(*columns))).alias("r")).select(path, "r.*"))
    old = cut(table.touched(number - 1, {path: new.select(path), guid: new.select(guid).na.drop().distinct()}))
    table.write(upsert(old.select(table.row_id, path, guid), new, table.row_id, path, guid, top=table.top(number - 1)), number)
