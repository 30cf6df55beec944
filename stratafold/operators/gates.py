"""Data-quality gates: checks as rows, verdicts, ratios above a base, coverage and peers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio_gate(df: DataFrame, group: str, num: Column, den: Column, floor: float, least: int) -> DataFrame:
    """(group, num, den, status): ok, warn below the floor, or skip where the base is too small."""
    g = df.groupBy(group).agg(num.alias("num"), den.alias("den"))
    ratio = F.try_divide(F.col("num"), F.col("den"))
    return g.withColumn("status", F.when(F.col("den") < least, "skip").when(ratio < floor, "warn").otherwise("ok"))


def verdict(checks: DataFrame, group: str) -> DataFrame:
    """(group, verdict): BLOCKED by a blocking failure, PARTIAL by any failure or warning, else READY."""
    bad = F.bool_or((F.col("status") == "fail") & F.col("blocking"))
    partial = F.bool_or(F.col("status").isin("fail", "warn"))
    return checks.groupBy(group).agg(F.when(bad, "BLOCKED").when(partial, "PARTIAL").otherwise("READY").alias("verdict"))


def orphan_report(children: dict[str, tuple[DataFrame, str]], parent: DataFrame, key: str) -> DataFrame:
    """(child, n, gone): rows of each child table and those whose parent is gone."""
    live = parent.select(F.col(key).alias("__k")).distinct().withColumn("__live", F.lit(True))
    parts = [
        df.join(live, df[c] == F.col("__k"), "left").agg(F.count("*").alias("n"), F.count_if(F.col("__live").isNull()).alias("gone")).select(F.lit(name).alias("child"), "n", "gone")
        for name, (df, c) in children.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def coverage_state(df: DataFrame, group: str, candidate: Column, parsed: Column) -> DataFrame:
    """(group, state): SUPPORTED if any row is parsed, DETECTED BUT UNSUPPORTED if any is a candidate, else NOT DETECTED."""
    return df.groupBy(group).agg(
        F.when(F.bool_or(F.coalesce(parsed, F.lit(False))), "SUPPORTED").when(F.bool_or(F.coalesce(candidate, F.lit(False))), "DETECTED BUT UNSUPPORTED").otherwise("NOT DETECTED").alias("state")
    )


def capabilities(checks: DataFrame, group: str, name: str, needs: Column, helps: Column) -> DataFrame:
    """(group, capability, state): unavailable without its needs, degraded without its helps, else available."""
    g = checks.groupBy(group).agg(F.bool_and(needs).alias("__n"), F.bool_and(helps).alias("__h"))
    return g.select(group, F.lit(name).alias("capability"), F.when(~F.col("__n"), "unavailable").when(~F.col("__h"), "degraded").otherwise("available").alias("state"))


def check_rows(df: DataFrame, subject: str, tests: list[tuple[str, Column, Column, str, str, bool]]) -> DataFrame:
    """(subject, check, status, message, remedy, blocking): a row for each subject and test.

    A test is its name, a fail and a warn condition (null counts as false), a message in which ``{column}``
    stands for that column's value, a remedy and whether a failure blocks. The remedy is null where all is well.
    """

    def filled(message: str) -> Column:
        parts = message.replace("}", "{").split("{")
        return F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("nothing")) if k % 2 else F.lit(p) for k, p in enumerate(parts)])

    rows = []
    for name, fail, warn, message, remedy, blocking in tests:
        status = F.when(fail, "fail").when(warn, "warn").otherwise("ok")
        rows.append(F.struct(F.lit(name).alias("check"), status.alias("status"), filled(message).alias("message"), F.when(status != "ok", remedy).alias("remedy"), F.lit(blocking).alias("blocking")))
    return df.select(F.col(subject), F.explode(F.array(*rows)).alias("__c")).select(subject, "__c.*")


def per_total(df: DataFrame, group: str, total: Column, counts: dict[str, Column]) -> DataFrame:
    """(group, total, a column for each count, and one of its share of the total; null shares of nothing)."""
    g = df.groupBy(group).agg(total.alias("total"), *[c.alias(k) for k, c in counts.items()])
    return g.select("*", *[F.try_divide(F.col(k), F.col("total")).alias(f"{k}_share") for k in counts])
