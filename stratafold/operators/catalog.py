"""Composite jobs over a catalogue: labels from evidence, origins, duplicates, families, clips, models and corpora."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.operators import aggs, graph, joins, windows
from stratafold.operators.storage import cut


def label_by_evidence(items: DataFrame, id_col: str, sources: list[tuple[str, str, Column | DataFrame]]) -> DataFrame:
    """(id, value, source, confidence, evidence): the value of the strongest source that has one; null without any.

    sources, strongest first: a name, a confidence, and a column of ``items`` or a table (id, value), of
    which the smallest value of an id counts. evidence lists all sources that have a value, in order.
    """
    rows = items
    for k, (_, _, source) in enumerate(sources):
        if isinstance(source, DataFrame):
            rows = rows.join(source.groupBy(id_col).agg(F.min("value").alias(f"__v{k}")), id_col, "left")
        else:
            rows = rows.withColumn(f"__v{k}", source)
    pick = lambda values: reduce(lambda rest, k: F.when(F.col(f"__v{k}").isNotNull(), values[k]).otherwise(rest), reversed(range(len(sources))), F.lit(None).cast("string"))
    listed = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"__v{k}").isNotNull(), F.concat(F.lit(f"{name}="), F.col(f"__v{k}"))) for k, (name, _, _) in enumerate(sources)])), ",")
    names, sure = [F.lit(n) for n, _, _ in sources], [F.lit(c) for _, c, _ in sources]
    return rows.select(id_col, F.coalesce(*[F.col(f"__v{k}") for k in range(len(sources))]).alias("value"), pick(names).alias("source"), pick(sure).alias("confidence"), listed.alias("evidence"))


def mark_origin(assets: DataFrame, asset: str, name: str, holds: DataFrame, holder: str, held_by: str, own: str) -> DataFrame:
    """(asset, origin, hold_count): engine if it has holders whose names all match ``held_by``, or if its own name matches ``own``; else game.

    holds has (asset, holder), a row for each link; a holder counts once.
    """
    links = holds.select(asset, holder).distinct()
    g = links.groupBy(asset).agg(F.count("*").alias("__n"), F.bool_and(F.coalesce(F.rlike(holder, F.lit(held_by)), F.lit(False))).alias("__all"))
    engine = F.coalesce("__all", F.lit(False)) | F.coalesce(F.rlike(name, F.lit(own)), F.lit(False))
    return assets.join(g, asset, "left").select(asset, F.when(engine, "engine").otherwise("game").alias("origin"), F.coalesce("__n", F.lit(0)).alias("hold_count"))


def duplicate_links(df: DataFrame, id_col: str, digest: str, hash_col: str, bucket: list[str], most: int = 4, bits: int = 64) -> DataFrame:
    """(a, b, kind) of links that join duplicates: exact between equal digests, near between hashes of one bucket.

    Near links span their groups and need not be all pairs; see ``joins.hamming_links``.

    Rows with equal digests, and with equal bucket and hash, are linked with the smallest id of them; only
    one row of each distinct hash is compared with other hashes, so copies do not meet in pairs. Rows
    without a digest, or without a hash or a part of the bucket, take no part in that side.
    """
    known = df.filter(F.col(digest).isNotNull())
    first = known.groupBy(digest).agg(F.min(id_col).alias("a"))
    exact = known.join(first, digest).filter(F.col("a") < F.col(id_col)).select("a", F.col(id_col).alias("b"), F.lit("exact").alias("kind"))
    hashed = df.select(F.col(id_col).alias("id"), F.col(hash_col).alias("h"), *bucket).na.drop()
    reps = cut(hashed.groupBy("h", *bucket).agg(F.min("id").alias("a")).withColumn("__bucket", F.struct(*bucket)))
    same = hashed.join(reps, ["h", *bucket]).filter("a < id").select("a", F.col("id").alias("b"), F.lit("near").alias("kind"))
    near = joins.hamming_links(reps, "a", "h", "__bucket", most, bits).select("a", "b", F.lit("near").alias("kind"))
    return exact.unionByName(same).unionByName(near)


def duplicate_groups(links: DataFrame) -> DataFrame:
    """(node, component, label) of all rows that links (a, b) join: the smallest id reachable, and a dense label."""
    return windows.dense_labels(graph.connected_components(links, "a", "b"), "component", "dup_")


def duplicate_stats(groups: DataFrame, links: DataFrame) -> DataFrame:
    """One row: groups, members, exact and near links."""
    rows = groups.select("component", F.lit("member").alias("kind")).unionByName(links.select("kind"), allowMissingColumns=True)
    counts = [F.count_if(F.col("kind") == k).alias(name) for k, name in (("member", "members"), ("exact", "exact_links"), ("near", "near_links"))]
    return rows.agg(F.count_distinct("component").alias("groups"), *counts)


#: Boxes of a group from which it is cut into tiles, and boxes of many groups that one task sweeps together.
HUGE_GROUP, SWEPT = 50_000, 100_000


def touching_clusters(group: np.ndarray, boxes: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """A label for each box (x0, y0, x1, y1): equal for boxes of a group that overlap or lie within its gap, directly or over others.

    One sweep along x in all groups at once: each box is held against the next ones by x0 until they begin
    beyond it. The links' ends take the smaller label until none changes.
    """
    order = np.lexsort((boxes[:, 0], group))
    g, (x0, y0, x1, y1), gap = group[order], boxes[order].T, gap[order]
    at, step, links = np.arange(len(g)), 1, []
    while len(at := at[at + step < len(g)]):
        to = at + step
        near = (g[at] == g[to]) & (x0[to] - gap[at] <= x1[at])
        at, to = at[near], to[near]
        met = (x0[at] - gap[at] <= x1[to]) & (y0[at] - gap[at] <= y1[to]) & (y0[to] - gap[at] <= y1[at])
        links.append((at[met], to[met]))
        step += 1
    a, b = (np.concatenate(x) for x in zip(*links, strict=True)) if links else (np.empty(0, int),) * 2
    label = np.arange(len(g))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.empty(len(g), np.int64)
    out[order] = order[label]
    return out


def figure_stats(boxes: DataFrame, group: str, box: str, touch: float = 0.02, least: int = 2, share: float = 0.25) -> DataFrame:
    """(group, clusters, figures, main): clusters of a group's boxes that overlap or lie within ``touch`` of the group's longer span.

    figures are clusters of max(``least``, ``share`` of the boxes) at least, main is the largest one's share.
    Boxes without a width or a height do not count; a group of such alone has no cluster and a share of 0. A null
    group is left out.

    Groups are swept in memory, many in a task, after one shuffle. Only groups of more than ``HUGE_GROUP`` boxes
    meet on tiles and are joined by components; equal in result but for the last digit of a gap.
    """
    good = F.coalesce((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")), F.lit(False))
    rows = boxes.select(F.col(group).alias("g"), F.col(box).alias("box"), *[F.when(good, F.col(c).cast("double")).alias(c) for c in ("x0", "y0", "x1", "y1")])
    span = F.greatest(F.max("x1") - F.min("x0"), F.max("y1") - F.min("y0"))
    sized = cut(rows.filter("g is not null").groupBy("g").agg(F.count("x0").alias("n"), (touch * span).alias("gap")))
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = rows.filter("x0 is not null")
    met = known.join(sized.filter(F.col("n").between(1, HUGE_GROUP)), "g")

    def sweep(part: pd.DataFrame) -> pd.DataFrame:
        code, names = pd.factorize(part["g"])
        label = touching_clusters(code, part[["x0", "y0", "x1", "y1"]].to_numpy(), part["gap"].to_numpy())
        sizes = pd.DataFrame({"g": code, "label": label}).groupby(["g", "label"]).size().reset_index(name="n")
        whole = sizes.groupby("g")["n"].transform("sum")
        sizes["figure"] = sizes["n"] >= np.maximum(least, share * whole)
        got = sizes.groupby("g").agg(clusters=("n", "size"), figures=("figure", "sum"), most=("n", "max"), n=("n", "sum"))
        return pd.DataFrame({"g": names[got.index], "clusters": got["clusters"], "figures": got["figures"], "main": got["most"] / got["n"]})

    kind = dict(rows.dtypes)["g"]
    dealt = met.withColumn("part", F.pmod(F.xxhash64("g"), F.lit(max(1, -(-total // SWEPT)))))
    swept = dealt.groupBy("part").applyInPandas(lambda part: sweep(part), f"g {kind}, clusters long, figures long, main double")
    huge = known.join(sized.filter(F.col("n") > HUGE_GROUP), "g")
    half = F.col("gap") / 2
    tiled = _tiled_figures(huge.select("g", "box", *[(F.col(c) + (half if c[1] == "1" else -half)).alias(c) for c in ("x0", "y0", "x1", "y1")]), least, share)
    none = sized.filter("n = 0").select("g", F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0.0))
    return swept.union(tiled).union(none).withColumnRenamed("g", group)


def _tiled_figures(boxes: DataFrame, least: int, share: float) -> DataFrame:
    """``figure_stats`` of huge groups: boxes are known by a 64-bit hash of group and box while they are joined."""
    key = lambda c: F.xxhash64("g", c)
    boxes = cut(boxes)
    joined = graph.connected_components(joins.box_overlap_join(boxes, "g", "box").select(key("a").alias("a"), key("b").alias("b")), "a", "b")
    nodes = boxes.select("g", key("box").alias("node")).join(joined, "node", "left").select("g", F.coalesce("component", "node").alias("cluster"))
    return aggs.cluster_share(nodes, "g", "cluster", least, share).select("g", "clusters", "figures", "main")


def families(items: DataFrame, family: Column, obj: str, size: Column) -> DataFrame:
    """(family, n, objects, loose, largest): items of each family, the objects they belong to and those that belong to none.

    Items without a family are ``unlabelled``.
    """
    rows = items.withColumn("family", F.coalesce(family, F.lit("unlabelled"))).withColumn("__size", size)
    return rows.groupBy("family").agg(F.count("*").alias("n"), F.count_distinct(obj).alias("objects"), F.count_if(F.col(obj).isNull()).alias("loose"), F.max("__size").alias("largest"))


def animation_summary(keys: DataFrame, clip: str, track: str, t: str, value: str, kind: str) -> DataFrame:
    """(clip, track, frames, images, duration, kinds, moves, changes) of clips given as keys.

    The best track is that with most distinct values, then most keys, then the smaller; frames are its
    keys, images its distinct values. kinds lists the distinct kinds of all keys; a clip moves if it has a
    kind other than ``image``, and changes if its best track has two images at least.
    """
    whole = keys.groupBy(clip).agg((F.max(t) - F.min(t)).alias("duration"), F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"), F.coalesce(F.bool_or(F.col(kind) != "image"), F.lit(False)).alias("moves"))
    tracks = keys.groupBy(clip, track).agg(F.count_distinct(value).alias("images"), F.count("*").alias("frames"))
    best = tracks.withColumn("__r", F.row_number().over(Window.partitionBy(clip).orderBy(F.desc("images"), F.desc("frames"), track))).filter("__r = 1").drop("__r")
    return whole.join(best, clip).select(clip, track, "frames", "images", "duration", "kinds", "moves", (F.col("images") >= 2).alias("changes"))


def model_table(draws: DataFrame, obj: str, mesh: str, slot: str, material: str, materials: DataFrame, texture: str) -> DataFrame:
    """(obj, mesh, placements, materials, textured): one row for each object's mesh with its materials in order of slots.

    draws holds a row for each placement's slot; a mesh with other materials is a row of its own. materials
    names the texture that a material binds, if any; textured tells whether one of the mesh's does.
    """
    bound = materials.groupBy(material).agg(F.max(texture).alias("__t"))
    # Dealt into all partitions before lists are made, so that a task sorts few rows for its lists.
    parts = int(draws.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = draws.join(bound, material, "left").repartition(parts, obj, mesh)
    sets = rows.groupBy(obj, mesh, "placement").agg(F.array_sort(F.collect_list(F.struct(slot, material))).alias("__m"), F.bool_or(F.col("__t").isNotNull()).alias("textured"))
    named = sets.withColumn("materials", F.array_join(F.transform("__m", lambda x: x[material].cast("string")), ","))
    return named.groupBy(obj, mesh, "materials", "textured").agg(F.count("*").alias("placements"))


def model_counts(models: DataFrame, obj: str) -> DataFrame:
    """(obj, meshes, placements, textured, flat) over the rows of ``model_table``."""
    return models.groupBy(obj).agg(F.count("*").alias("meshes"), F.sum("placements").alias("placements"), F.count_if("textured").alias("textured"), F.count_if(~F.col("textured")).alias("flat"))


def corpus_report(levels: DataFrame, corpus: str, order: list[str], metric: str, listed: str, config: Column, blocks: int = 20, least_block: int = 20) -> DataFrame:
    """(section, corpus, item, n, value): a corpus's sets, the curve of the largest one, families and keys, as rows.

    sets: rows and mean of the metric of each corpus. curve: the same for blocks of neighbouring rows of the
    corpus with most rows, ties to the smaller name. families: items of comma lists, an index folded, on two
    rows at least. keys: how often each key of a map occurs.
    """
    out = lambda df, section, name, item, n, value: df.select(F.lit(section).alias("section"), name.cast("string").alias("corpus"), item.cast("string").alias("item"), n.cast("long").alias("n"), value.cast("double").alias("value"))
    sets = levels.groupBy(corpus).agg(F.count("*").alias("n"), F.avg(metric).alias("value"))
    none, null = F.lit(None).cast("string"), F.lit(None).cast("double")
    first = sets.orderBy(F.desc("n"), corpus).first()
    curve = aggs.progress_curve(levels.filter(F.col(corpus) == (first[corpus] if first else None)), order, metric, least_block, blocks)
    parts = [
        out(sets, "sets", F.col(corpus), none, F.col("n"), F.col("value")),
        out(curve, "curve", F.lit(first[corpus] if first else None), F.col("block"), F.col("n"), F.col("mean")),
        out(aggs.list_item_frequency(levels, listed, ","), "families", none, F.col("item"), F.col("n"), null),
        out(aggs.key_frequency(levels, config), "keys", none, F.col("key"), F.col("n"), null),
    ]
    return reduce(DataFrame.unionByName, parts)


def reach_report(states: DataFrame, bundle: str, needs: DataFrame, entry: str) -> DataFrame:
    """One row: local, remote and missing bundles, entries, and those that need a missing one.

    A needed bundle that is not declared at all counts as unread, and makes no entry unreachable.
    """
    linked = needs.select(entry, bundle).distinct().join(states, bundle, "left")
    e = linked.groupBy(entry).agg(F.when(F.bool_or(F.coalesce(F.col("state") == "missing", F.lit(False))), "unreachable").otherwise("reachable").alias("what"))
    unread = linked.filter("state is null").select(bundle).distinct().select(F.lit("unread").alias("what"))
    rows = states.select(F.col("state").alias("what")).unionByName(e.select("what")).unionByName(unread)
    counts = [F.count_if(F.col("what") == k).alias(k) for k in ("local", "remote", "missing", "unread", "unreachable")]
    return rows.agg(*counts, F.count_if(F.col("what").isin("reachable", "unreachable")).alias("entries"))


def visibility_at(items: DataFrame, item: str, unit: str, flag: str, alpha: str, toggles: DataFrame, toggle_keys: DataFrame, times: DataFrame, t: str, least: float = 0.4) -> DataFrame:
    """(unit, t, items, shown, could, alpha, woken) of units at the wanted times.

    items: (item, unit, flag, alpha); toggles: (item, toggle), each toggle on an item's chain; toggle_keys:
    (toggle, t, v), straight between times and clamped outside; times: (unit, t). An item is lit unless one
    of its toggles is below 0.5, and shown if lit and flagged; its alpha is its tint times its toggles'
    smallest value, within 0..1. could ignores the flag; a unit is woken if it shows less than ``least`` of what it could.
    """
    at = times.select(unit, t).distinct()
    wanted = items.select(item, unit).join(at, unit).join(toggles, item)
    value = joins.asof_interpolate(toggle_keys, wanted.select("toggle", t).distinct(), "toggle", t, "v")
    low = wanted.join(value, ["toggle", t]).groupBy(item, t).agg(F.min("v").alias("__low"))
    rows = items.join(at, unit).join(low, [item, t], "left").withColumn("__low", F.coalesce("__low", F.lit(1.0)))
    rows = rows.withColumn("__lit", F.col("__low") >= 0.5).withColumn("__alpha", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(alpha) * F.least(F.lit(1.0), F.col("__low")))))
    u = rows.groupBy(unit, t).agg(F.count("*").alias("items"), F.count_if(F.col("__lit") & F.col(flag)).alias("shown"), F.count_if("__lit").alias("could"), F.avg("__alpha").alias("alpha"))
    return u.withColumn("woken", F.col("shown") < least * F.col("could"))


def interned_sets(rows: DataFrame, owner: str, place: str, item: str) -> tuple[DataFrame, DataFrame]:
    """((owner, set), (set, place, item)): each distinct list of items once, under a dense number, and which list an owner has.

    Lists are told apart by 128 bits of hashes of their items and places, added up, so no list is gathered.
    """
    hashes = [F.sum(F.pmod(F.xxhash64(place, item, F.lit(k)), F.lit(1 << 40))).alias(f"__h{k}") for k in range(3)]
    own = cut(rows.groupBy(owner).agg(F.count("*").alias("__n"), *hashes))
    keys = ["__n", "__h0", "__h1", "__h2"]
    speakers = aggs.numbered_rows(own.groupBy(*keys).agg(F.min(owner).alias("__speaker")), ["__speaker"], "set")
    lists = rows.join(speakers.select(F.col("__speaker").alias(owner), "set"), owner).select("set", place, item)
    return own.join(speakers.drop("__speaker"), keys).select(owner, "set"), lists


def browse_table(
    assets: DataFrame, asset: str, name: str, kind: str, image: str, usage: DataFrame, holder: str, duplicates: DataFrame, sets: DataFrame | None = None, details: dict[str, DataFrame] | None = None, most: int = 25
) -> DataFrame:
    """One row for each asset as a browser shows it, those with an image first, then by kind and name.

    Beside the asset's own columns: used (how many distinct holders), used_by (the first ``most`` of them by name), copies (rows
    of its duplicate group, itself included; 1 without one) and duplicate, set (from ``interned_sets``), and a
    struct for each of ``details``, tables of one row an asset at most, such as its clip or its place on a page; null without one.
    usage: (asset, holder); duplicates: (asset, component). Sorted by ranges, so that a file holds few kinds.
    """
    links = usage.select(asset, holder).na.drop().distinct()
    first = links.withColumn("__r", F.row_number().over(Window.partitionBy(asset).orderBy(holder))).filter(F.col("__r") <= most)
    listed = first.groupBy(asset).agg(F.array_sort(F.collect_list(holder)).alias("used_by"))
    counts = links.groupBy(asset).agg(F.count("*").alias("used"))
    sizes = duplicates.groupBy("component").agg(F.count("*").alias("copies"))
    rows = assets.join(counts, asset, "left").join(listed, asset, "left").join(duplicates.select(asset, "component").join(sizes, "component").select(asset, "copies"), asset, "left")
    rows = rows.withColumns({"used": F.coalesce("used", F.lit(0)), "used_by": F.coalesce("used_by", F.array().cast("array<string>")), "copies": F.coalesce("copies", F.lit(1))}).withColumn("duplicate", F.col("copies") > 1)
    rows = rows.join(sets, asset, "left") if sets is not None else rows
    for title, table in (details or {}).items():
        rows = rows.join(table.select(asset, F.struct(*[c for c in table.columns if c != asset]).alias(title)), asset, "left")
    return rows.orderBy(F.col(image).isNull(), kind, name, asset)
