"""Removal of lines that many sites share, found by sketches of their distinct sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.storage import stored

#: Relative width, around the threshold, in which sketches leave the decision to exact counts. It is
#: six standard errors of a sketch of 2 ** 12 registers.
BAND = 0.1
REGISTERS_LOG2 = 12
#: Rows of a table of line hashes up to which it is broadcast, at most 60 bytes each; larger ones are joined by shuffles.
BROADCAST_ROWS = 400_000


def _small(table: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it is small; else a join shuffles, and splits hot lines at run time."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def _lines(df: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    rows = df.select(
        F.col(id_col).alias("id"), F.col(site_col).cast("string").alias("site"), F.xxhash64(text_col).alias("content"),
        F.posexplode(F.split(text_col, "\n")).alias("pos", "line"),
    )
    return rows.filter(F.trim("line") != "").select("id", "site", "content", "pos", F.xxhash64(F.trim("line")).alias("hash"))


def shared_lines(df: DataFrame, id_col: str, text_col: str, site_col: str, min_sites: int) -> DataFrame:
    """(hash, first) of the lines on ``min_sites`` distinct sites or more; first: the place of the line that stays.

    Sketches decide where their estimate is clear of the threshold; the other lines' sites are counted
    exactly. Rows without a site count for no site.
    """
    lines = _lines(df, id_col, text_col, site_col)
    spread = lines.groupBy("hash").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg(F.coalesce("site", F.lit("")), REGISTERS_LOG2)).alias("sites"),
        F.max(F.col("site").isNull()).cast("int").alias("unknown"),
        F.max(F.col("site") == "").cast("int").alias("blank"),
        F.min(F.struct("id", "content", "pos")).alias("first"),
    )
    # Missing and blank site names share one entry of the sketch; a missing name alone is no site.
    only_unknown = (F.col("unknown") == 1) & (F.coalesce("blank", F.lit(0)) == 0)
    spread = spread.select("hash", "first", (F.col("sites") - only_unknown.cast("int")).alias("sites")).filter(F.col("sites") >= min_sites * (1 - BAND))
    spread = stored(spread, "spread")
    near = _small(spread.filter(F.col("sites") <= min_sites * (1 + BAND)).select("hash"))
    pairs = lines.filter("site is not null").select("hash", "site").join(near, "hash", "left_semi").distinct()
    exact = pairs.groupBy("hash").agg(F.count("*").alias("exact"))
    return spread.join(exact, "hash", "left").filter(F.coalesce("exact", "sites") >= min_sites).select("hash", "first")


def dedup_lines(df: DataFrame, id_col: str, text_col: str, site_col: str, min_sites: int = 10) -> DataFrame:
    """``df`` with its text column freed of shared lines, and n_lines and n_removed as further columns.

    A line is compared without the blanks around it; empty lines stay. Of each line on ``min_sites``
    sites or more the first stays: that of the smallest (id, content hash, position), nulls first. All
    its other places go, within texts as well. A null text stays null with 0 lines. Repeated rows lose
    the same lines. Columns named n_lines or n_removed are replaced. An empty table stays empty.
    """
    shared = _small(stored(shared_lines(df, id_col, text_col, site_col, min_sites), "shared"))
    places = _lines(df, id_col, text_col, site_col).join(shared, "hash")
    here = F.struct("id", "content", "pos")
    drops = places.filter(~here.eqNullSafe(F.col("first"))).groupBy("id", "content").agg(F.collect_set("pos").alias("__drop"))
    drops = drops.select(F.col("id").alias("__id"), F.col("content").alias("__content"), "__drop")
    kept = df.drop("n_lines", "n_removed").withColumn("__hash", F.xxhash64(text_col))
    joined = kept.join(drops, kept[id_col].eqNullSafe(drops["__id"]) & (F.col("__hash") == F.col("__content")), "left")
    split, drop = F.split(text_col, "\n"), F.coalesce("__drop", F.array().cast("array<int>"))
    rest = F.filter(split, lambda line, i: ~F.array_contains(F.col("__drop"), i))
    text = F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(F.array_join(rest, "\n"))
    columns = [text.alias(c) if c == text_col else F.col(c) for c in kept.columns if c != "__hash"]
    return joined.select(*columns, F.coalesce(F.size(split), F.lit(0)).alias("n_lines"), F.size(drop).alias("n_removed")).withColumn(
        "n_lines", F.when(F.col("n_lines") < 0, 0).otherwise(F.col("n_lines"))
    )
