"""Ordered operators over entities of any size: ranges of an entity's rows as partitions, and what crosses their borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from stratafold.operators.storage import cut


def in_ranges(df: DataFrame, entity: str, order: list[str]) -> DataFrame:
    """Stored rows with ``__range``: stretches of all rows by entity and ``order``. A hot entity has many, a small one mostly one.

    Rows that are equal in entity and ``order`` share a range.
    """
    return cut(df.repartitionByRange(entity, *order).withColumn("__range", F.spark_partition_id()))


def within(entity: str, *order: Column | str) -> WindowSpec:
    """The rows of an entity in a range, in order."""
    return Window.partitionBy(entity, "__range").orderBy(*order)


def from_other_ranges(rows: DataFrame, entity: str, carried: dict[str, tuple[Column, str]]) -> DataFrame:
    """Adds what an entity's other ranges hand over to each of its rows; null where there is none.

    ``carried`` names columns, each with an aggregate of one range and how those are put together: ``last``
    (of the nearest earlier range that has one), ``next`` (of the nearest later one) or ``sum`` (of all
    earlier ones). Only entities that cross a border have rows here, two for each border at most.
    """
    parts = rows.groupBy(entity, "__range").agg(*[a.alias(f"__s_{c}") for c, (a, _) in carried.items()])
    crossing = parts.withColumn("__n", F.count("*").over(Window.partitionBy(entity))).filter("__n > 1")
    order = Window.partitionBy(entity).orderBy("__range")
    early, late = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    fold = {"last": lambda c: F.last(c, True).over(early), "next": lambda c: F.first(c, True).over(late), "sum": lambda c: F.sum(c).over(early)}
    borders = cut(crossing.select(F.col(entity).alias("__entity"), F.col("__range").alias("__own"), *[fold[how](f"__s_{c}").alias(c) for c, (_, how) in carried.items()]))
    return rows.join(borders, F.col(entity).eqNullSafe(F.col("__entity")) & (F.col("__range") == F.col("__own")), "left").drop("__entity", "__own")


def keys_around(keys: DataFrame, times: DataFrame, entity: str, t: str, values: list[str]) -> DataFrame:
    """(entity, t, __low, __high) of each wanted time: the last key at or before it and the first at or after it, as structs of ``t`` and ``values``."""
    kinds = dict(keys.dtypes)
    wanted = times.select(entity, t, *[F.lit(None).cast(kinds[v]).alias(v) for v in values], F.lit(1).alias("__wanted"))
    rows = in_ranges(keys.select(entity, t, *values, F.lit(0).alias("__wanted")).unionByName(wanted), entity, [t])
    key = F.when(F.col("__wanted") == 0, F.struct(F.col(t).alias("t"), *[F.col(v) for v in values]))
    back = within(entity, t, "__wanted").rowsBetween(Window.unboundedPreceding, 0)
    ahead = within(entity, F.desc(t), "__wanted").rowsBetween(Window.unboundedPreceding, 0)
    rows = from_other_ranges(rows, entity, {"__before": (F.max_by(key, F.when(key.isNotNull(), F.col(t))), "last"), "__after": (F.min_by(key, F.when(key.isNotNull(), F.col(t))), "next")})
    rows = rows.withColumn("__low", F.coalesce(F.last(key, True).over(back), "__before")).withColumn("__high", F.coalesce(F.last(key, True).over(ahead), "__after"))
    return rows.filter("__wanted = 1").select(entity, t, "__low", "__high")
