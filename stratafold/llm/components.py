"""Connected components of undirected links, and groups without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.operators.graph import connected_components


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of ``links`` (a, b): the smallest id it can reach.

    Self links, repeated links and nulls do no harm; no links give no rows.
    """
    return connected_components(links, "a", "b").withColumnRenamed("node", "id")


def without_repeats(groups: DataFrame, name: str) -> DataFrame:
    """``groups`` (``name``, id, ...) with one group of those that hold the same ids, told by 128 bits of hash and their number."""
    both = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"h{k}") for k in (0, 1)]
    held = groups.groupBy(name).agg(F.count("*").alias("n"), *both)
    return groups.join(held.groupBy("n", "h0", "h1").agg(F.min(name).alias(name)).select(name), name, "left_semi")
