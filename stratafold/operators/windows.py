"""Ordered operators: best per group, interleaving, angles, samples, budgets, carried values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.operators import ranges
from stratafold.operators.storage import cut


def gated_best(df: DataFrame, group: str, gate: str, order: list, share: float = 0.5) -> DataFrame:
    """The best row of each group by ``order`` among those with ``share`` of the group's highest gate value."""
    top = F.max(gate).over(Window.partitionBy(group))
    kept = df.withColumn("__top", top).filter(F.col(gate) >= share * F.col("__top"))
    return kept.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter("__r = 1").drop("__top", "__r")


def round_robin(df: DataFrame, group: str, order: list, turn: str = "turn") -> DataFrame:
    """Adds each row's turn: its rank in its group; sorted by turn and group, groups interleave."""
    return df.withColumn(turn, F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def unwrap_angle(df: DataFrame, group: str, order: str, angle: str) -> DataFrame:
    """Adds ``unwrapped``: the angle moved by whole turns so that no step exceeds half a turn.

    A group's rows are dealt into ranges; the last angle and the turns so far cross their borders.
    """
    rows = ranges.in_ranges(df, group, [order])
    rows = ranges.from_other_ranges(rows, group, {"__before": (F.max_by(F.struct(angle), order), "last")})
    w = ranges.within(group, order)
    before = F.coalesce(F.lag(F.struct(angle)).over(w), "__before")[angle]
    rows = cut(rows.withColumn("__s", F.coalesce(-360 * F.round((F.col(angle) - before) / 360), F.lit(0.0))).drop("__before"))
    rows = ranges.from_other_ranges(rows, group, {"__turned": (F.sum("__s"), "sum")})
    turned = F.sum("__s").over(w) + F.coalesce("__turned", F.lit(0.0))
    return rows.withColumn("unwrapped", F.col(angle) + turned).drop("__s", "__turned", "__range")


def even_sample(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """Every (rows / n)-th row of each group in order, the first n of them."""
    w = Window.partitionBy(group)
    rows = df.withColumn("__n", F.count("*").over(w)).withColumn("__r", F.row_number().over(w.orderBy(*order)) - 1)
    step = F.greatest(F.floor(F.col("__n") / n), F.lit(1))
    return rows.filter((F.col("__r") % step == 0) & (F.floor(F.col("__r") / step) < n)).drop("__n", "__r")


def budget_prefix(df: DataFrame, group: str, size: str, order: list, budget: float) -> DataFrame:
    """The smallest rows of each group that fit the budget together."""
    w = Window.partitionBy(group).orderBy(size, *order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(size).over(w)).filter(F.col("used") <= budget)


def excerpt_rows(df: DataFrame, group: str, size: str, order: list, budget: float) -> DataFrame:
    """The rows of each group, in order, before which budget is left; the last of them may exceed it."""
    before = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("used", F.coalesce(F.sum(size).over(before), F.lit(0))).filter(F.col("used") < budget)


def hold_time(df: DataFrame, group: str, t: str, end: Column, least: float = 0.03) -> DataFrame:
    """Adds ``hold``: the time to the group's next row, and from the last row to ``end``; ``least`` at least."""
    return df.withColumn("hold", F.greatest(F.coalesce(F.lead(t).over(Window.partitionBy(group).orderBy(t)), end) - F.col(t), F.lit(least)))


def dense_labels(df: DataFrame, root: str, prefix: str, label: str = "label") -> DataFrame:
    """Adds a label such as dup_0001 for each distinct root, numbered by order of roots; longer numbers stay whole."""
    from stratafold.operators.aggs import numbered_rows

    roots = numbered_rows(df.select(root).distinct(), [root], "__k")
    number = F.col("__k").cast("string")
    return df.join(roots, root).withColumn(label, F.concat(F.lit(prefix), F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0")))).drop("__k")


def draw_order(df: DataFrame, group: str, keys: list, name: str = "place") -> DataFrame:
    """Adds each row's place in its group by several keys."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*keys)))


def median_row(df: DataFrame, group: str, value: str, tie: str) -> DataFrame:
    """The row of each group with the lower median value."""
    w = Window.partitionBy(group)
    rows = df.withColumn("__n", F.count("*").over(w)).withColumn("__r", F.row_number().over(w.orderBy(value, tie)))
    return rows.filter(F.col("__r") == F.floor((F.col("__n") + 1) / 2)).drop("__n", "__r")


def median_instant(keys: DataFrame, entity: str, t: str, axes: list[str], sizes: tuple[str, str], samples: int = 13) -> DataFrame:
    """(entity, t, area, follow): of evenly spaced times over an entity's keys, the one where it has its median area.

    keys: one row for each entity and time, with places ``axes`` and extents ``sizes``, straight between
    times. follow tells whether a place travels farther than the extent at that time.
    """
    from stratafold.operators.joins import asof_interpolate

    ends = keys.groupBy(entity).agg(F.min(t).cast("double").alias("__a"), F.max(t).cast("double").alias("__b"))
    step = F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))
    times = ends.select(entity, "__a", "__b", step.alias("__k")).select(entity, (F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__k") / (samples - 1)).alias(t), "__k")
    rows = times.select(entity, t).distinct()
    columns = [*axes, *sizes]
    own = keys.select(entity, F.col(t).cast("double").alias(t), *[F.col(c).cast("double").alias(c) for c in columns])
    rows = asof_interpolate(own, rows, entity, t, columns)
    rows = times.join(rows, [entity, t]).withColumn("area", F.col(sizes[0]) * F.col(sizes[1]))
    w = Window.partitionBy(entity)
    travel = [F.max(c).over(w) - F.min(c).over(w) > F.col(s) for c, s in zip(axes, sizes, strict=True)]
    ranked = rows.withColumn("follow", travel[0] | travel[-1]).withColumn("__r", F.row_number().over(w.orderBy("area", "__k")))
    return ranked.filter(F.col("__r") == (samples + 1) // 2).select(entity, t, "area", "follow")


def carry_down(df: DataFrame, group: str, order: str, value: Column, name: str) -> DataFrame:
    """Adds the last non-null value so far in each group; a range of a group's rows takes over the last value of those before it."""
    rows = ranges.in_ranges(df.withColumn(name, value), group, [order])
    last = F.max_by(name, F.when(F.col(name).isNotNull(), F.col(order)))
    rows = ranges.from_other_ranges(rows, group, {"__before": (last, "last")})
    so_far = F.last(name, True).over(ranges.within(group, order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, F.coalesce(so_far, "__before")).drop("__before", "__range")


def page_of(df: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """One page of rows in order, pages from 0."""
    return df.orderBy(*order).offset(page * size).limit(size)
