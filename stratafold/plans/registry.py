"""Queries with their SQL, collected by decorator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The supplied tables of one folder, and SQL over them."""

    NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self.NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """SQL in which a supplied table's or a frame's name stands in braces."""
        used = {n: getattr(self, n) for n in self.NAMES if f"{{{n}}}" in text}
        return self.spark.sql(text, **used, **frames)


def demo(sql: str | None = None) -> Callable:
    """Registers ``f(tables)`` as a query under its name, which must be new, with DuckDB SQL for the same rows."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def both(text: str) -> tuple[str, str]:
    """A derivation for Spark, with names in braces, and the same text for DuckDB."""
    return text, text.replace("{", "").replace("}", "")
