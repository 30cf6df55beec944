"""Reference graphs and hierarchies, as loops of joins over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.operators import trees
from stratafold.operators.storage import cut


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def build_edges(links: DataFrame, src: str, dst: str, known: DataFrame, key: str) -> DataFrame:
    """(src, dst): distinct links to known targets, none to itself."""
    rows = links.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src is not null and dst is not null and src <> dst").distinct()
    return rows.join(known.select(F.col(key).alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def bounded_reach(edges: DataFrame, sources: DataFrame, key: str, depth: int) -> DataFrame:
    """(source, node, hops): every node within ``depth`` hops of a source but itself, with the fewest hops."""
    step = edges.select(F.col("src").alias("node"), "dst")
    fronts = [cut(sources.select(F.col(key).alias("source"), F.col(key).alias("node"), F.lit(0).alias("hops")).distinct())]
    for hop in range(1, depth + 1):
        new = fronts[-1].join(step, "node").select("source", F.col("dst").alias("node")).distinct()
        front = cut(new.join(_all(fronts).select("source", "node"), ["source", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            break
        fronts.append(front)
    return _all(fronts).filter("hops > 0")


def inherited_roles(reach: DataFrame, holders: DataFrame, key: str, role: str, priority: list[str]) -> DataFrame:
    """(node, holders, roles) of every node that ``reach`` (source, node) names: its holders, and their roles in order of priority.

    holders holds (``key``, ``role``), one row for each role of a holder; a holder without a role counts as one.
    """
    held = holders.select(F.col(key).alias("source"), F.col(role).alias("__role")).distinct()
    g = reach.join(held, "source", "left").groupBy("node").agg(F.count_distinct("source").alias("holders"), *[F.bool_or(F.col("__role") == p).alias(f"__{k}") for k, p in enumerate(priority)])
    roles = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"__{k}"), F.lit(p)) for k, p in enumerate(priority)])), "+")
    return g.select("node", "holders", roles.alias("roles"))


def nearest_label(edges: DataFrame, roots: DataFrame, key: str, label: str, depth: int) -> DataFrame:
    """(node, label, hops): labels flow along edges; the nearest root wins, then the smaller label."""
    step = edges.select(F.col("src").alias("node"), "dst")
    fronts = [cut(roots.groupBy(F.col(key).alias("node")).agg(F.min(label).alias("label")).withColumn("hops", F.lit(0)))]
    for hop in range(1, depth + 1):
        new = fronts[-1].join(step, "node").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("label"))
        front = cut(new.join(_all(fronts).select("node"), "node", "left_anti").withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            break
        fronts.append(front)
    return _all(fronts)


def connected_components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node of the pairs: the smallest node it can reach.

    Nodes point at their smallest neighbour, pointers are followed twice, and pairs are contracted to
    what they point at, until none are left.
    """
    live = cut(pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a is not null and b is not null").distinct())
    label = cut(live.select(F.col("a").alias("node")).union(live.select("b")).distinct().withColumn("component", F.col("node")))
    while True:
        live = live.filter("a <> b")
        if live.isEmpty():
            return label
        both = live.select(F.col("b").alias("node"), F.col("a").alias("to")).union(live.select(F.col("a").alias("node"), F.col("b").alias("to")))
        point = cut(both.groupBy("node").agg(F.least("node", F.min("to")).alias("to")))
        point = cut(point.join(point.select(F.col("node").alias("to"), F.col("to").alias("up")), "to").select("node", F.least("to", "up").alias("to")))
        label = cut(label.join(point.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        moved = live.join(point.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(point.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        live = cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct())


def flatten_to_root(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, root, depth) by doubling pointers; a parent that is not a node itself is the root above it.

    Nodes of a cycle and those below one have no root and are left out: after as many doublings as the
    number of nodes has binary digits, whatever still moves hangs on a cycle.
    """
    base = nodes.select(F.col(node).alias("node"), F.col(parent).alias("up"))
    state = cut(base.select("node", F.coalesce("up", "node").alias("up"), F.col("up").isNotNull().cast("long").alias("hops")))
    for _ in range(state.count().bit_length()):
        above = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("hops2"))
        moved = F.coalesce(F.col("up2") != F.col("up"), F.lit(False))
        state = cut(state.join(above, "up", "left").select("node", F.coalesce("up2", "up").alias("up"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"), moved.alias("moved")))
        if state.filter("moved").isEmpty():
            break
    inner = base.filter("up is not null").select(F.col("node").alias("root"))
    return state.withColumnRenamed("up", "root").join(inner, "root", "left_anti").select("node", "root", F.col("hops").cast("int").alias("depth"))


def path_of(nodes: DataFrame, node: str, parent: str, name: str, separator: str = "/") -> DataFrame:
    """(node, path): the names from below the root down to the node itself, by doubling pointers; a root's path is empty.

    A parent that is not a node itself ends the walk, and its children's paths start with their own name.
    A null name counts as an empty one. Nodes of a cycle and below one are left out.
    """
    base = nodes.select(F.col(node).alias("node"), F.col(parent).alias("up"), F.coalesce(F.col(name), F.lit("")).alias("name"))
    state = cut(base.select("node", "up", F.when(F.col("up").isNull(), F.array().cast("array<string>")).otherwise(F.array("name")).alias("path")))
    for _ in range(state.count().bit_length() + 1):
        above = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"), F.lit(True).alias("met"))
        # A row whose pointer is null, or points at no node, has its whole path.
        state = cut(state.join(above, "up", "left").select("node", F.col("up2").alias("up"), F.when(F.col("met"), F.concat("path2", "path")).otherwise(F.col("path")).alias("path")))
        if state.filter("up is not null").isEmpty():
            break
    return state.filter("up is null").select("node", F.array_join("path", separator).alias("path"))


def walk_down(nodes: DataFrame, node: str, parent: str, name: str, inherit: dict[str, str] | None = None) -> DataFrame:
    """(node, path, level, inherited columns): names joined from the root, and values that nodes have from their ancestors.

    See ``trees.handed_down`` for ``inherit`` and for nodes without a root above them.
    """
    rows = nodes.withColumn("__path", F.col(name))
    return trees.handed_down(rows, node, parent, {"__path": "path", **(inherit or {})}).select("node", F.col("__path").alias("path"), "level", *(inherit or {}))


def one_hop_closure(edges: DataFrame, bases: DataFrame) -> DataFrame:
    """Edges, and for each (src, base) of ``bases`` the base's edges as the source's own."""
    lent = bases.join(edges.select(F.col("src").alias("base"), "dst"), "base").select("src", "dst")
    return edges.select("src", "dst").unionByName(lent).distinct()


def multiset_signature(items: DataFrame, owner: str, item: str) -> DataFrame:
    """(owner, n, signature): the number of items, and a digest of which they are and how often each occurs.

    Items are counted first and added up as hashes, so neither their number nor their order matters to memory.
    """
    counted = items.groupBy(owner, item).agg(F.count("*").alias("__n"))
    # Values below 2^40 add up without overflow over 2^23 distinct items of one owner.
    sums = [F.sum(F.pmod(F.xxhash64(item, "__n", F.lit(k)), F.lit(1 << 40))).alias(f"__h{k}") for k in range(3)]
    whole = counted.groupBy(owner).agg(F.sum("__n").alias("n"), *sums)
    return whole.select(owner, "n", F.md5(F.concat_ws(",", "n", *[f"__h{k}" for k in range(3)])).alias("signature"))


def listed_digest(items: DataFrame, owner: str, item: str, owners: DataFrame) -> DataFrame:
    """(owner, signature): md5 of the sorted items, joined by commas, of each of ``owners``; distinct items are gathered, with their numbers."""
    counted = items.join(owners.select(owner).distinct(), owner, "left_semi").filter(F.col(item).isNotNull()).groupBy(owner, item).agg(F.count("*").cast("int").alias("__n"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(item).alias("i"), F.col("__n").alias("n"))))
    return counted.groupBy(owner).agg(F.md5(F.array_join(F.flatten(F.transform(pairs, lambda p: F.array_repeat(p["i"], p["n"]))), ",")).alias("signature"))


def repeated_units(signatures: DataFrame, owner: str, least: int = 2) -> DataFrame:
    """(signature, placements, speaker): signatures that repeat; the smallest owner speaks for them."""
    g = signatures.groupBy("signature").agg(F.count("*").alias("placements"), F.min(owner).alias("speaker"))
    return g.filter(F.col("placements") >= least)


def subtree_signature(nodes: DataFrame, node: str, parent: str, item: str) -> DataFrame:
    """(node, size, signature): the number of nodes of a subtree, and a digest of its items and their nesting, whatever the order of children."""
    got = trees.subtree_totals(nodes, node, parent, item, {"size": F.lit(1).cast("long")})
    return got.select("node", "size", F.col("shape").alias("signature"))


def subtree_shapes(nodes: DataFrame, node: str, parent: str, item: str) -> DataFrame:
    """(node, parent, drawn, shape): items in a node's subtree, and a hash of what these are and how they nest.

    A null item draws nothing. Nodes of a cycle are left out. See ``trees.subtree_totals``.
    """
    return trees.subtree_totals(nodes, node, parent, item, {"drawn": F.col(item).isNotNull().cast("long")}).select("node", "parent", "drawn", "shape")


def repeated_subtrees(nodes: DataFrame, node: str, parent: str, item: str, name: str, most: int = 16) -> DataFrame:
    """(shape, name, speaker, drawn, placements) of the subtrees that a forest is cut into.

    From the roots down, a subtree is one object if its shape occurs again, or if it draws ``most`` items
    at most and no shape below it occurs again; else its children are looked at. Subtrees without items
    are left out. Of each shape the node with the shortest name, then the smaller one, then the smaller
    id speaks for the others; placements counts them. The number of jobs does not grow with the depth.
    """
    label = F.coalesce(F.col(name), F.lit(""))
    # A name that is the node's own id is not kept twice.
    other = F.when(label != F.col(node).cast("string"), label)
    shapes = trees.subtree_totals(nodes, node, parent, item, {"drawn": F.col(item).isNotNull().cast("long")}, {"other": other}).filter("drawn > 0")
    leaves, inner = shapes.filter("leaves is null"), shapes.filter("leaves is not null")
    counts = cut(shapes.groupBy("shape").agg(F.count("*").alias("__n")))
    again = cut(counts.filter("__n > 1").select("shape"))
    lone = cut(counts.filter("__n = 1").select("shape"))
    # All below a shape that occurs again occurs again, so only small shapes that occur once are looked through.
    once = cut((shapes.join(lone, "shape", "left_semi") if lone.count() < again.count() else shapes.join(again, "shape", "left_anti")).select("node", "parent", "drawn", "leaves"))

    def below_any(owners: DataFrame) -> DataFrame:
        # Most nodes are leaves, and most owners have none, so leaves are looked up among the others alone.
        own = owners.filter("leaves is not null").select(F.col("node").alias("parent"), "leaves")
        bare = cut(own.filter("leaves > 0").select("parent"))
        return inner.join(own.select("parent"), "parent", "left_semi").unionByName(leaves.join(bare, "parent", "left_semi"))

    small = cut(once.filter(F.col("drawn") <= most).select("node", "parent", "leaves"))
    held = below_any(small).join(again, "shape", "left_semi").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("again"))
    counted = small.join(held, "node", "left").withColumn("again", F.coalesce("again", F.lit(0).cast("long"))).withColumn("item", F.lit(None).cast("string"))
    below = trees.subtree_totals(counted, "node", "parent", "item", {"below": F.col("again")}).filter("below = 0").select("node")
    # Likewise all below a whole subtree is whole, so a subtree is cut off where it is whole and what it hangs on is not.
    open_ = cut(once.join(below, "node", "left_anti").select("node", "leaves"))
    found = shapes.filter("parent is null").join(open_, "node", "left_anti").unionByName(below_any(open_).join(open_, "node", "left_anti"))
    named = found.withColumn("name", F.coalesce("other", F.col("node").cast("string")))
    g = named.groupBy("shape").agg(F.min(F.struct(F.length("name").alias("n"), "name", "node")).alias("s"), F.max("drawn").alias("drawn"), F.count("*").alias("placements"))
    return g.select("shape", F.col("s.name").alias("name"), F.col("s.node").alias("speaker"), "drawn", "placements")


def merge_units(units: DataFrame, file: str, signature: str = "signature", placements: str = "placements", speaker: str | None = None) -> DataFrame:
    """(signature, placements, files, first): units of several files that share a signature add up; the smallest file keeps them.

    With ``speaker`` the smallest of these is added.
    """
    more = [F.min(speaker).alias(speaker)] if speaker else []
    return units.groupBy(signature).agg(F.sum(placements).alias("placements"), F.count_distinct(file).alias("files"), F.min(file).alias("first"), *more)
