"""Tables and reports as files, and where their inputs came from."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_catalogue(tables: dict[str, DataFrame], folder: str, build: str = "build_id") -> None:
    """Each table as Parquet below ``folder``, by build; only the builds that a table holds are replaced."""
    for name, df in tables.items():
        # Rows of a build meet before the write; adaptive execution splits large builds and joins small ones by their bytes.
        dealt = df.sparkSession.sql(f"SELECT /*+ REBALANCE(`{build}`) */ * FROM {{df}}", df=df)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(build).parquet(f"{folder}/{name}")


def write_report(df: DataFrame, folder: str) -> None:
    """A report as JSON lines; nulls are written too."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def provenance(inputs: dict[str, tuple[DataFrame, str]], code: str | None = None) -> DataFrame:
    """(input, n, digest, low, high, code): rows of each input, one digest of all its contents, the smallest and largest of a row's, and the version that read it.

    The digest is that of the sums of the rows' digests, taken as eight numbers of 32 bits, so it tells any change, and
    neither the order of the rows nor how they are split matters; a repeated row counts each time.
    """

    def one(name: str, df: DataFrame, c: str) -> DataFrame:
        rows = df.select(F.sha2(c, 256).alias("d"))
        sums = [F.sum(F.conv(F.substring("d", 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")).alias(f"s{k}") for k in range(8)]
        whole = rows.agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"), *sums)
        digest = F.sha2(F.concat_ws(",", "n", *[f"s{k}" for k in range(8)]), 256)
        return whole.select(F.lit(name).alias("input"), "n", digest.alias("digest"), "low", "high", F.lit(code).cast("string").alias("code"))

    return reduce(DataFrame.unionByName, [one(name, df, c) for name, (df, c) in inputs.items()])


def run_stages(spark: SparkSession, stages: list[tuple[str, Callable[[], object]]], code: str, log: str | None = None) -> DataFrame:
    """(stage, place, status, seconds, error, code) of stages run one after another; ``code`` names the version that ran.

    A stage that raises has failed, and those after it are skipped. With ``log`` the rows are added to the
    Parquet table there.
    """
    rows, failed = [], False
    for place, (name, stage) in enumerate(stages):
        began, status, error = time.time(), "skipped", None
        if not failed:
            try:
                stage()
                status = "done"
            except Exception as e:  # noqa: BLE001 - whatever a stage raises is its result
                failed, status, error = True, "failed", f"{type(e).__name__}: {e}"[:500]
        rows.append((name, place, status, round(time.time() - began, 3), error, code))
    out = spark.createDataFrame(rows, "stage string, place int, status string, seconds double, error string, code string")
    if log:
        out.write.mode("append").parquet(log)
    return out
