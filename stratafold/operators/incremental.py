"""Upserts with stable ids, pruning, unions of builds and schema evolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.operators.aggs import numbered_rows


def upsert(old: DataFrame, new: DataFrame, row_id: str, path: str, guid: str, top: int | None = None) -> DataFrame:
    """``new`` with row ids: the same path keeps its id, else the same guid keeps its id, else a new one.

    ``top`` is the highest id given so far; by default that of ``old``.
    """
    by_path = old.select(path, F.col(row_id).alias("__by_path"))
    first = new.join(by_path, path, "left")
    taken = first.filter(F.col("__by_path").isNotNull()).select(F.col("__by_path").alias(row_id))
    free = old.join(taken, row_id, "left_anti").groupBy(guid).agg(F.min(row_id).alias("__by_guid"))
    named = first.filter(F.col("__by_path").isNotNull()).withColumn("__by_guid", F.lit(None).cast("long"))
    rest = first.filter(F.col("__by_path").isNull()).join(free, guid, "left")
    known = named.unionByName(rest).withColumn(row_id, F.coalesce("__by_path", "__by_guid")).drop("__by_path", "__by_guid")
    top = old.agg(F.coalesce(F.max(row_id), F.lit(0))).first()[0] if top is None else top
    fresh = numbered_rows(known.filter(F.col(row_id).isNull()).drop(row_id), [path], "__k")
    fresh = fresh.withColumn(row_id, (F.col("__k") + top).cast("long")).drop("__k")
    return known.filter(F.col(row_id).isNotNull()).unionByName(fresh)


def prune(children: dict[str, DataFrame], parent: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each child table without the rows whose parent has gone."""
    live = parent.select(key).distinct()
    return {name: df.join(live, key, "left_semi") for name, df in children.items()}


def prune_regions(assets: DataFrame, path: str, source: DataFrame, seam: str = "#") -> DataFrame:
    """``assets`` whose file is still in ``source`` (path); a row ``file#region`` stays while its file stays."""
    live = source.select(F.col(path).alias("__file")).distinct()
    return assets.withColumn("__file", F.substring_index(path, seam, 1)).join(live, "__file", "left_semi").drop("__file")


def release_holders(children: DataFrame, holder: str, parent: DataFrame, key: str) -> DataFrame:
    """``children`` with the links to holders that are gone set to null."""
    live = parent.select(F.col(key).alias("__held")).distinct()
    kind = children.schema[holder].dataType
    joined = children.join(live, children[holder] == F.col("__held"), "left")
    return joined.select(*[F.col("__held").cast(kind).alias(holder) if c == holder else F.col(c) for c in children.columns])


def union_builds(builds: dict[str, DataFrame]) -> DataFrame:
    """All builds in one table with a build_id; columns that a build lacks are null."""
    rows = [df.withColumn("build_id", F.lit(b)) for b, df in builds.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def schema_evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both with the columns of both; a column that one lacks is null in its rows. Columns of other types than before take those of ``new``."""
    kinds = {f.name: f.dataType for f in new.schema.fields}
    moved = old.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in old.columns])
    return new.unionByName(moved, allowMissingColumns=True)


def same_content(df: DataFrame, path: str, content: list[str], order: str) -> DataFrame:
    """(path, n, kept, conflict): one row stays for each path; a conflict is a path with several contents."""
    g = df.groupBy(path).agg(F.count("*").alias("n"), F.min(order).alias("kept"), F.count_distinct(F.struct(*content)).alias("contents"))
    return g.select(path, "n", "kept", (F.col("contents") > 1).alias("conflict"))
