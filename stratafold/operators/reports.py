"""Reports over groups: features, packages, units, pages, reach and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.operators import aggs


def populated_features(fields: list[str]) -> Column:
    """The names of the fields of a row that are neither null nor zero, joined by commas."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & (F.col(c) != 0), F.lit(c)) for c in fields])), ",")


def expand_prefixed(code: str | Column, prefixes: list[str]) -> Column:
    """``<n>#rest`` as the n-th prefix, from 0, and the rest; anything else as it is."""
    code = F.col(code) if isinstance(code, str) else code
    place = F.regexp_extract(code, "^([0-9]{1,9})#", 1).try_cast("int")
    prefix = F.get(F.array(*[F.lit(p) for p in prefixes]), place)
    return F.coalesce(F.concat(prefix, F.regexp_replace(code, "^[0-9]{1,9}#", "")), code)


def harvest_members(df: DataFrame, id_col: str, text: str, title: str, member: str, stop: list[str]) -> DataFrame:
    """(id, title, member): the first match of ``title`` and each match of ``member`` that is no stop word."""
    rows = df.select(id_col, F.regexp_extract(text, title, 1).alias("title"), F.explode(F.regexp_extract_all(text, F.lit(member), 1)).alias("member"))
    return rows.filter(~F.col("member").isin(stop))


def peer_report(df: DataFrame, build: str, metrics: list[str]) -> DataFrame:
    """(build, metric, value, peer, ratio): each metric of each build beside the median over the others."""
    one = lambda m: aggs.peer_median(df, build, m).select(build, F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), "peer", "ratio")
    return reduce(DataFrame.unionByName, map(one, metrics))


def sample_quality(df: DataFrame, group: str, order: list, checks: dict[str, Column], n: int = 60) -> DataFrame:
    """(group, sampled, a count for each check) over the first n rows of each group."""
    first = df.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("__r") <= n)
    return first.groupBy(group).agg(F.count("*").alias("sampled"), *[F.count_if(c).alias(name) for name, c in checks.items()])


def package_decision(df: DataFrame, package: str, member: str, loose: Column, least: int, most_loose: float) -> DataFrame:
    """(package, members, decision, reason): packages with too few members or too large a share of loose rows stay out."""
    g = df.groupBy(package).agg(F.count_distinct(member).alias("members"), (F.count_if(loose) / F.count("*")).alias("share"))
    reason = F.when(F.col("members") < least, "too few members").when(F.col("share") > most_loose, "mostly loose")
    return g.select(package, "members", F.when(reason.isNull(), "include").otherwise("exclude").alias("decision"), reason.alias("reason"))


def unit_flags(df: DataFrame, unit: str, size: str, fill: Column, many: int = 50, least_main: float = 0.6, least_fill: float = 0.2) -> DataFrame:
    """(unit, parts, main, scene) of units of two parts at least; a scene has many parts, no main one or little fill."""
    g = df.groupBy(unit).agg(F.count("*").alias("parts"), F.try_divide(F.max(size), F.sum(size)).alias("main"), fill.alias("__fill")).filter("parts >= 2")
    scene = (F.col("parts") >= many) | (F.col("main") < least_main) | (F.col("__fill") < least_fill)
    return g.select(unit, "parts", "main", scene.alias("scene"))


def page_layout(df: DataFrame, owner: str, page: str, fits: Column, n: int = 4) -> DataFrame:
    """(owner, page, cuts, fits, tail): an owner's n pages with most cuts, two at least, and the cuts on its other pages."""
    pages = df.groupBy(owner, page).agg(F.count("*").alias("cuts"), F.bool_and(fits).alias("fits"))
    w = Window.partitionBy(owner)
    ranked = pages.withColumn("__r", F.row_number().over(w.orderBy(F.desc("cuts"), page)))
    shown = (F.col("__r") <= n) & (F.col("cuts") > 1)
    ranked = ranked.withColumn("tail", F.sum(F.when(shown, 0).otherwise(F.col("cuts"))).over(w))
    return ranked.filter(shown).select(owner, page, "cuts", "fits", "tail")
