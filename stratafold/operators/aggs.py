"""Grouped summaries: votes, shares, facets, corpora, parts and wholes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.operators.scalar import numbering_pattern
from stratafold.operators.storage import cut


def top_counts(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The n largest groups; ties by key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys).limit(n)


def share_where(condition: Column, base: Column | None = None) -> Column:
    """The share of rows of ``base`` for which the condition holds; null if there are none."""
    base = F.lit(True) if base is None else base
    return F.try_divide(F.count_if(base & condition), F.count_if(base))


def weighted_score(
    signals: DataFrame, group: str, score: str, weight: str, low: float = 0.30, high: float = 0.55, names: tuple = ("2d", "mixed", "3d"), signal: str | None = None
) -> DataFrame:
    """(group, total, verdict): the weighted mean of a group's scores; up to ``low`` the first name, from ``high`` the last.

    With ``signal``, the column that names a group's few signals, also signals: (signal, score, weight) by name.
    """
    total = F.try_divide(F.sum(F.col(score) * F.col(weight)), F.sum(F.when(F.col(score).isNotNull(), F.col(weight))))
    kept = [F.array_sort(F.collect_list(F.struct(F.col(signal).alias("signal"), F.col(score).alias("score"), F.col(weight).alias("weight")))).alias("signals")] if signal else []
    out = signals.groupBy(group).agg(total.alias("total"), *kept)
    return out.withColumn("verdict", F.when(F.col("total") >= high, names[2]).when(F.col("total") <= low, names[0]).when(F.col("total").isNotNull(), names[1]))


def peer_median(df: DataFrame, build: str, metric: str, least_peers: int = 3) -> DataFrame:
    """(build, metric, peer, ratio): the median over the other builds and the own value's ratio to it.

    Rows are numbered in order; leaving one out moves the middle by a place at most, so the four rows
    around the middle tell every row's median.
    """
    known = numbered_rows(df.filter(F.col(metric).isNotNull()).select(build, metric), [metric, build], "__place")
    m = known.count() - 1
    if m < max(1, least_peers):
        return known.limit(0).select(build, metric, F.col(metric).cast("double").alias("peer"), F.lit(None).cast("double").alias("ratio"))
    low, high = (m + 1) // 2, (m + 2) // 2
    middle = {r["__place"]: float(r[metric]) for r in known.filter(F.col("__place").between(low, high + 1)).collect()}
    at = lambda k: F.when(F.col("__place") <= k, middle[k + 1]).otherwise(middle[k])
    out = known.withColumn("peer", (at(low) + at(high)) / 2)
    return out.select(build, metric, "peer", F.try_divide(F.col(metric), F.col("peer")).alias("ratio"))


def majority(df: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    """(group, value, share): the value with most rows, then most weight, then the smaller; and its share of rows."""
    votes = df.groupBy(group, value).agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    best = Window.partitionBy(group).orderBy(F.desc("n"), F.desc("w"), value)
    share = F.col("n") / F.sum("n").over(Window.partitionBy(group))
    return votes.withColumn("share", share).withColumn("__r", F.row_number().over(best)).filter("__r = 1").select(group, value, "share")


def vote(df: DataFrame, group: str, value: str, weight: str, most: int = 5) -> DataFrame:
    """(group, value, share, others): the value of ``majority`` and up to ``most`` of the others, in the same order, joined by commas."""
    votes = df.groupBy(group, value).agg(F.count("*").alias("n"), F.sum(weight).alias("w"))
    best = Window.partitionBy(group).orderBy(F.desc("n"), F.desc("w"), value)
    ranked = votes.withColumn("__s", F.col("n") / F.sum("n").over(Window.partitionBy(group))).withColumn("__r", F.row_number().over(best)).filter(F.col("__r") <= most + 1)
    listed = F.array_sort(F.collect_list(F.when(F.col("__r") > 1, F.struct("__r", F.col(value).cast("string").alias("v")))))
    first = lambda c: F.max(F.when(F.col("__r") == 1, F.col(c)))
    return ranked.groupBy(group).agg(first(value).alias(value), first("__s").alias("share"), F.array_join(F.transform(listed, lambda x: x["v"]), ",").alias("others"))


def unanimous(df: DataFrame, group: str, value: str, least: int = 2) -> DataFrame:
    """(group, value) of groups of ``least`` rows at least that agree on one value."""
    out = df.groupBy(group).agg(F.min(value).alias(value), F.max(value).alias("__max"), F.count("*").alias("__n"))
    return out.filter((F.col(value) == F.col("__max")) & (F.col("__n") >= least)).select(group, value)


def first_wins(sources: DataFrame, key: str, display: str, rank: str) -> DataFrame:
    """(key, display) of the source with the smallest rank; the smaller display of equals."""
    return sources.groupBy(key).agg(F.min_by(display, F.struct(rank, display)).alias(display))


def facet_counts(df: DataFrame, facets: list[str], filters: dict[str, object]) -> DataFrame:
    """(facet, value, n): counts of each facet's values under every other facet's filter, in one scan.

    A filtered facet's selected value is listed even with a count of 0.
    """
    passes = {f: F.coalesce(F.col(f) == filters[f], F.lit(False)) if f in filters else F.lit(True) for f in facets}
    rows = df.select(
        F.explode(F.array(*[
            F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value"), reduce(lambda a, b: a & b, [passes[g] for g in facets if g != f], F.lit(True)).alias("ok")) for f in facets
        ])).alias("x")
    ).select("x.*")
    counts = rows.groupBy("facet", "value").agg(F.count_if("ok").alias("n"))
    selected = reduce(lambda a, b: a | b, [(F.col("facet") == f) & (F.col("value") == str(v)) for f, v in filters.items()], F.lit(False))
    return counts.filter((F.col("n") > 0) | selected)


def capped_list(df: DataFrame, group: str, value: str, order: list, n: int) -> DataFrame:
    """(group, values): the first n values of each group, in order, joined by commas."""
    w = Window.partitionBy(group).orderBy(*order)
    top = df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n)
    return top.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", F.col(value).alias("v")))), lambda s: s["v"].cast("string")), ",").alias("values"))


def role_set(df: DataFrame, group: str, role: str, priority: list[str]) -> DataFrame:
    """(group, roles): a group's roles in order of priority, joined by +."""
    held = df.groupBy(group).agg(F.collect_set(role).alias("s"))
    return held.select(group, F.array_join(F.filter(F.array(*[F.lit(p) for p in priority]), lambda p: F.array_contains("s", p)), "+").alias("roles"))


def numbered_corpora(df: DataFrame, folder: str, name: str, least: int) -> DataFrame:
    """(folder, pattern, n, example) of numbered names that share a pattern."""
    rows = df.withColumn("pattern", numbering_pattern(name)).filter(F.col("pattern").contains("#"))
    return rows.groupBy(folder, "pattern").agg(F.count("*").alias("n"), F.min(name).alias("example")).filter(F.col("n") >= least)


def corpora(df: DataFrame, folder: str, name: str, least_group: int = 4, least_corpus: int = 12, sample: Column | None = None, heads: int = 3, most: int = 6) -> DataFrame:
    """(folder, extension, pattern, n, files, example, corpus): numbered names of one folder and extension that share a pattern.

    A group has ``least_group`` names at least, and is a corpus from ``least_corpus``; files counts all of
    its folder and extension. Groups of a folder and extension of which one of the first ``heads`` files, by
    name, fails ``sample`` are left out. The ``most`` largest, ties by folder and pattern.
    """
    passes = F.lit(True) if sample is None else F.coalesce(sample, F.lit(False))
    extension = F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))
    stem = F.regexp_replace(name, r"\.[^./]*$", "")
    rows = df.select(F.col(folder), extension.alias("extension"), F.concat(numbering_pattern(stem), extension).alias("pattern"), F.col(name).alias("__n"), passes.alias("__ok"))
    first = Window.partitionBy(folder, "extension").orderBy("__n")
    heads_of = rows.withColumn("__r", F.row_number().over(first)).filter(F.col("__r") <= heads).groupBy(folder, "extension").agg(F.bool_and("__ok").alias("__ok"))
    groups = rows.groupBy(folder, "extension", "pattern").agg(F.count("*").alias("n"), F.min("__n").alias("example"))
    files = groups.groupBy(folder, "extension").agg(F.sum("n").alias("files"))
    sides = files.join(heads_of, [folder, "extension"]).filter("__ok").drop("__ok").withColumnsRenamed({folder: "__f", "extension": "__e"})
    good = groups.filter((F.col("n") >= least_group) & F.contains("pattern", F.lit("#")))
    met = good.join(sides, F.col(folder).eqNullSafe(F.col("__f")) & (F.col("extension") == F.col("__e")))
    return met.select(folder, "extension", "pattern", "n", "files", "example", (F.col("n") >= least_corpus).alias("corpus")).orderBy(F.desc("n"), folder, "pattern").limit(most)


def key_frequency(df: DataFrame, config: str | Column) -> DataFrame:
    """(key, n): how often each key of a map column occurs."""
    return df.select(F.explode(F.map_keys(config)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def list_item_frequency(df: DataFrame, col: str, separator: str, least: int = 2) -> DataFrame:
    """(item, n): items of separated lists, with a trailing index folded, that occur ``least`` times."""
    items = df.select(F.explode(F.split(col, separator)).alias("i")).select(F.regexp_replace(F.trim("i"), "[0-9]+$", "").alias("item"))
    return items.filter("item <> ''").groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def numbered_rows(df: DataFrame, order: list[str], number: str) -> DataFrame:
    """Adds each row's place, from 1, in a total order: ranked within ranges, which are then added up.

    Rows are dealt into ranges once and stored with their range, so that counting and ranking see the
    same ranges. No range is ranked in one task with another; rows that are equal in ``order`` get
    neighbouring numbers in any order.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    sizes = {r["__p"]: r["n"] for r in ranged.groupBy("__p").agg(F.count("*").alias("n")).collect()}  # one number for each range
    before, starts = 0, []
    for p in range(max(sizes, default=0) + 1):
        starts.append(before)
        before += sizes.get(p, 0)
    # A literal, not a table of unknown size, so that joins with few numbered rows are planned as broadcasts.
    offset = F.get(F.array(*[F.lit(o).cast("long") for o in starts]), F.col("__p"))
    ranked = ranged.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    return ranked.withColumn(number, offset + F.col("__r")).drop("__p", "__r")


def progress_curve(df: DataFrame, order: list[str], metric: str, least_block: int = 20, parts: int = 20) -> DataFrame:
    """(block, n, mean) over blocks of max(least_block, rows / parts) rows in order."""
    size = max(least_block, df.count() // parts)
    blocks = numbered_rows(df, order, "__n").withColumn("block", F.floor((F.col("__n") - 1) / size))
    return blocks.groupBy("block").agg(F.count("*").alias("n"), F.avg(metric).alias("mean"))


def decomposition_filter(parts: DataFrame, whole: str, kind: str, part_size: str, whole_size: str) -> DataFrame:
    """Wholes with two kinds of parts, at most three of a kind on average, none larger and one smaller than the whole."""
    g = parts.groupBy(whole).agg(F.countDistinct(kind).alias("kinds"), F.count("*").alias("members"), F.max(F.col(part_size) - F.col(whole_size)).alias("over"), F.min(F.col(part_size) - F.col(whole_size)).alias("under"))
    return g.filter("kinds >= 2 and members <= 3 * kinds and over <= 0 and under < 0").select(whole, "kinds", "members")


def quorum_prefix(df: DataFrame, group: str, tokens: str | Column, quorum: float = 0.6) -> DataFrame:
    """(group, prefix): the longest word prefix that a quorum (two at least) of the group's names shares."""
    names = df.select(group, tokens.alias("t") if isinstance(tokens, Column) else F.col(tokens).alias("t")).filter("size(t) > 0").distinct()
    total = names.groupBy(group).agg(F.count("*").alias("total"))
    each = names.select(group, F.explode(F.transform(F.sequence(F.lit(1), F.size("t")), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("t", F.lit(1), k), " ").alias("prefix")))).alias("p")).select(group, "p.*")
    n = each.groupBy(group, "k", "prefix").agg(F.count("*").alias("n")).join(total, group)
    good = n.filter((F.col("n") >= 2) & (F.col("n") >= quorum * F.col("total")))
    return good.groupBy(group).agg(F.max_by("prefix", F.struct("k", "n", "prefix")).alias("prefix"))


def piece_sets(df: DataFrame, keys: list[str], position: str, stem: str, least_stem: int = 4) -> DataFrame:
    """(keys, n, positions) of stems with two members and two positions at least."""
    g = df.filter(F.length(stem) >= least_stem).groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(position).alias("positions"))
    return g.filter("n >= 2 and positions >= 2")


def majority_page(df: DataFrame, owner: str, page: str) -> DataFrame:
    """(owner, page): the page with most of the owner's rows, the smaller of equals."""
    n = df.groupBy(owner, page).agg(F.count("*").alias("n"))
    return n.groupBy(owner).agg(F.max_by(page, F.struct("n", -F.col(page))).alias(page))


def role_rollup(df: DataFrame, group: str, role: str, roles: list[str]) -> DataFrame:
    """(group, one count for each role)."""
    return df.groupBy(group).agg(*[F.count_if(F.col(role) == r).alias(f"n_{r}") for r in roles])


def content_roots(df: DataFrame, path: str | Column, size: str | Column, depth: int = 2) -> DataFrame:
    """(root, n, bytes): rows by the first parts of their path."""
    root = F.array_join(F.slice(F.split(path, "/"), 1, depth), "/")
    return df.groupBy(root.alias("root")).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))


def described_roots(df: DataFrame, path: str, size: str, package: str, depth: int = 2, examples: int = 3) -> DataFrame:
    """(root, n, bytes, packages, examples): rows by the first parts of their path, distinct packages, and the smallest paths joined by commas."""
    root = F.array_join(F.slice(F.split(path, "/"), 1, depth), "/")
    rows = df.select(root.alias("root"), F.col(path).alias("__p"), F.col(size).alias("__s"), F.col(package).alias("__k"))
    first = rows.select("root", "__p").distinct().withColumn("__r", F.row_number().over(Window.partitionBy("root").orderBy("__p"))).filter(F.col("__r") <= examples)
    shown = first.groupBy("root").agg(F.array_join(F.array_sort(F.collect_list("__p")), ",").alias("examples"))
    return rows.groupBy("root").agg(F.count("*").alias("n"), F.sum("__s").alias("bytes"), F.count_distinct("__k").alias("packages")).join(shown, "root")


def intern_values(df: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(values with ref, rows with ref): distinct values numbered from 1 by their order."""
    values = numbered_rows(df.select(*cols).distinct(), cols, "ref")
    same = reduce(lambda a, b: a & b, [df[c].eqNullSafe(values[c]) for c in cols])
    return values, df.join(values, same).drop(*[values[c] for c in cols])


def stage_stats(df: DataFrame, counters: dict[str, Column]) -> DataFrame:
    """One row with a count for each counter."""
    return df.agg(*[F.count_if(c).alias(k) for k, c in counters.items()])


def cluster_share(nodes: DataFrame, group: str, cluster: str, least: int = 2, share: float = 0.25) -> DataFrame:
    """(group, clusters, figures, main): a group's clusters, those of max(``least``, ``share`` of its nodes) at least, and the largest one's share."""
    sizes = nodes.groupBy(group, cluster).agg(F.count("*").alias("__n"))
    total = sizes.groupBy(group).agg(F.sum("__n").alias("__t"))
    counted = F.count_if(F.col("__n") >= F.greatest(F.lit(least), share * F.col("__t")))
    return sizes.join(total, group).groupBy(group).agg(F.count("*").alias("clusters"), counted.alias("figures"), (F.max("__n") / F.max("__t")).alias("main"))


def largest_member(df: DataFrame, group: str, member: str, area: str | Column, whole: Column) -> DataFrame:
    """(group, member): the whole, if the group has one, else its largest member; the smaller id of equals."""
    best = F.max_by(member, F.struct(whole.cast("int"), F.col(area) if isinstance(area, str) else area, -F.col(member)))
    return df.groupBy(group).agg(best.alias(member))
