"""Objects out of names, files, clips and toggles."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.operators import graph, joins, trees
from stratafold.operators.storage import cut


def resolve_candidate(wanted: DataFrame, want: str, files: DataFrame, file: str, slack: float = 0.01) -> DataFrame:
    """(want, file, exact, beside): of the files with the wanted base name, one of equal size, else one of equal aspect.

    Both tables have base, dir, w, h. Of several, one in the same folder wins, then the smallest file id.
    Wants that no file fits are left out.
    """
    # Equal shapes meet once: those of one folder there, and sizes of a name without their folders.
    shape, size = ["base", "a_dir", "a_w", "a_h"], ["base", "a_w", "a_h"]
    a = wanted.select(want, "base", *[F.col(c).alias(f"a_{c}") for c in ("dir", "w", "h")])
    b = files.select("base", file, *[F.col(c).alias(f"b_{c}") for c in ("dir", "w", "h")])
    b = b.groupBy("base", "b_dir", "b_w", "b_h").agg(F.min(file).alias("file"))
    exact = (F.col("a_w") == F.col("b_w")) & (F.col("a_h") == F.col("b_h"))
    aspect = F.abs(F.col("a_w") * F.col("b_h") - F.col("a_h") * F.col("b_w")) <= slack * F.col("a_w") * F.col("b_h")
    shapes, least = a.select(shape).distinct(), F.min(F.struct((~exact).alias("inexact"), "file")).alias("f")
    inside = shapes.join(b.withColumnRenamed("base", "b_base"), (F.col("base") == F.col("b_base")) & F.equal_null("a_dir", "b_dir")).filter(exact | aspect).groupBy(shape).agg(least)
    anywhere = shapes.select(size).distinct().join(b.groupBy("base", "b_w", "b_h").agg(F.min("file").alias("file")), "base").filter(exact | aspect).groupBy(size).agg(least)
    # Where the best file of all folders lies in the wanted one, that folder's own best file wins over it.
    found = inside.select(*shape, "f", F.lit(False).alias("apart")).unionByName(shapes.join(anywhere, size).select(*shape, "f", F.lit(True).alias("apart")))
    best = found.groupBy(shape).agg(F.min(F.struct("f.inexact", "apart", "f.file")).alias("r"))
    same = [F.equal_null(F.col(f"x.{c}"), F.col(f"y.{c}")) for c in shape]
    joined = a.alias("x").join(best.alias("y"), same)
    return joined.select(F.col(f"x.{want}"), F.col("y.r.file").alias(file), (~F.col("y.r.inexact")).alias("exact"), (~F.col("y.r.apart")).alias("beside"))


def nearest_ancestor(nodes: DataFrame, node: str, parent: str, flag: str) -> DataFrame:
    """(node, holder) of every node below a root: its nearest flagged ancestor, else the nearest flagged sibling of an ancestor.

    Of several flagged siblings the smallest counts. Trees may have any depth; nodes of a cycle are left out.
    """
    base = nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent"), F.coalesce(F.col(flag), F.lit(False)).alias("flag"))
    # The two smallest flagged children of each parent are enough to name a flagged sibling other than oneself.
    pair = base.filter("flag and parent is not null").groupBy("parent").agg(F.min("node").alias("one"), F.count("*").alias("__n"))
    rest = base.filter("flag").join(pair.filter("__n > 1").select("parent", "one"), "parent").filter("node <> one").groupBy("parent").agg(F.min("node").alias("two"))
    side = F.when(F.col("one") != F.col("node"), F.col("one")).when(F.col("two") != F.col("node"), F.col("two"))
    base = cut(base.join(pair.select("parent", "one"), "parent", "left").join(rest, "parent", "left").select("node", "parent", F.when(F.col("flag"), F.col("node")).alias("mask"), side.alias("side")))
    above = trees.handed_down(base, "node", "parent", {"mask": "nearest", "side": "nearest"}).select(F.col("node").alias("parent"), F.coalesce("mask", "side").alias("holder"))
    none = F.lit(None).cast(base.schema["node"].dataType).alias("holder")
    return base.filter("parent is null").select("node", none).unionByName(base.join(above, "parent").select("node", "holder"))


def bind_clips(candidates: DataFrame, clip: str, holder: str, most: int = 8) -> DataFrame:
    """(clip, holder, bound, matched, place): a clip's holders, bound ones first, then by matched names, ``most`` at most."""
    g = candidates.groupBy(clip, holder).agg(F.bool_or("bound").alias("bound"), F.max("matched").alias("matched"))
    order = Window.partitionBy(clip).orderBy(F.desc("bound"), F.desc("matched"), holder)
    return g.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def bind_clip_paths(clips: DataFrame, holders: DataFrame, rigs: DataFrame, animators: DataFrame, most: int = 8) -> DataFrame:
    """(clip, holder, prefix, bound, matched): the one holder that explains most of a clip's paths, and where in it these begin.

    clips: (clip, path); holders: (clip, holder, place), of which the first ``most`` by place and name count; rigs: (holder,
    path) of all nodes of a holder; animators: (clip, holder, root) where a holder plays the clip itself.

    A holder with such a root beats all without, and explains the paths that exist below it. Others explain
    the paths that they have from their own root. Then the number of paths counts, the place and the root.
    Where no root is given, paths are ends of the holder's paths: the prefix that makes most of them whole is taken,
    the shortest of equals, then the smaller; it is empty if none does. Nulls take no part.
    """
    paths, rigs = cut(clips.select("clip", "path").na.drop().distinct()), cut(rigs.select("holder", "path").na.drop().distinct())
    order = Window.partitionBy("clip").orderBy("place", "holder")
    first = holders.groupBy("clip", "holder").agg(F.min("place").alias("place")).na.drop(subset=["clip", "holder"]).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    first = cut(first.join(animators.select("clip", "holder", "root").na.drop().distinct(), ["clip", "holder"], "left"))
    # An empty path is the root itself, and an empty root puts nothing before.
    whole = F.when(F.coalesce("root", F.lit("")) == "", F.col("path")).when(F.col("path") == "", F.col("root")).otherwise(F.concat_ws("/", "root", "path"))
    hit = first.join(paths, "clip").withColumn("path", whole).join(rigs, ["holder", "path"], "left_semi")
    matched = hit.groupBy("clip", "holder", F.coalesce("root", F.lit("")).alias("r"), F.col("root").isNotNull().alias("b")).agg(F.count("*").alias("matched"))
    scored = first.withColumn("r", F.coalesce("root", F.lit(""))).withColumn("b", F.col("root").isNotNull()).join(matched, ["clip", "holder", "r", "b"], "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    best = Window.partitionBy("clip").orderBy(F.desc("b"), F.desc("matched"), "place", "r")
    chosen = cut(scored.withColumn("k", F.row_number().over(best)).filter("k = 1").select("clip", "holder", "r", F.col("b").alias("bound"), "matched"))
    # All ways to cut a path of a chosen holder in two.
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    cuts = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), k), "/").alias("prefix"), F.array_join(F.slice(parts, k + 1, F.size(parts)), "/").alias("path")))
    loose = chosen.filter("not bound").select("clip", "holder")
    ends = rigs.join(loose.select("holder").distinct(), "holder", "left_semi").select("holder", F.explode(cuts).alias("e")).select("holder", "e.*").distinct()
    met = loose.join(paths, "clip").join(ends, ["holder", "path"]).groupBy("clip", "prefix").agg(F.count("*").alias("n"), F.bool_or((F.col("path") != "") | (F.col("prefix") == "")).alias("real")).filter("real")
    prefix = met.groupBy("clip").agg(F.min(F.struct((-F.col("n")).alias("n"), F.length("prefix").alias("l"), "prefix")).alias("p")).select("clip", "p.prefix", (-F.col("p.n")).alias("explained"))
    out = chosen.join(prefix, "clip", "left")
    return out.select("clip", "holder", F.when(F.col("bound"), F.col("r")).otherwise(F.coalesce("prefix", F.lit(""))).alias("prefix"), "bound", F.when(F.col("bound"), F.col("matched")).otherwise(F.coalesce("explained", F.lit(0))).alias("matched"))


def visibility(toggles: DataFrame, unit: str, item: str, toggle: str, flag: str, least: float = 0.4) -> DataFrame:
    """(unit, items, shown, could, woken): items that all their toggles (on from 0.5) and any flag show.

    could ignores the flag; a unit is woken if it shows less than ``least`` of what it could.
    """
    g = toggles.groupBy(unit, item).agg(F.bool_and(F.col(toggle) >= 0.5).alias("lit"), F.bool_or(flag).alias("flag"))
    u = g.groupBy(unit).agg(F.count("*").alias("items"), F.count_if(F.col("lit") & F.col("flag")).alias("shown"), F.count_if("lit").alias("could"))
    return u.withColumn("woken", F.col("shown") < least * F.col("could"))


def group_objects(names: DataFrame, id_col: str, name: str, area: Column) -> DataFrame:
    """(object, members, largest, alone): names under the shortest name that their parents lead to.

    A name's parent is the longest proper prefix of its words that is itself a name. The member of the
    largest area is shown, on ties the smallest id; an object without other members is alone.
    """
    parents = joins.longest_prefix_parent(names, id_col, name)
    up = names.select(F.col(id_col).alias("node")).join(parents.select(F.col(id_col).alias("node"), F.col("parent").alias("up")), "node", "left")
    roots = graph.flatten_to_root(up, "node", "up")
    sized = names.select(F.col(id_col).alias("node"), area.alias("area")).join(roots, "node")
    g = sized.groupBy(F.col("root").alias("object")).agg(F.count("*").alias("members"), F.max_by("node", F.struct("area", -F.col("node"))).alias("largest"))
    return g.withColumn("alone", F.col("members") == 1)


def vocabulary(words: DataFrame, owner: str, token: str, evidence: DataFrame, least: int) -> DataFrame:
    """(token, n, confirmed): tokens of ``least`` owners or more; confirmed ones occur in ``evidence`` (token)."""
    known = words.groupBy(token).agg(F.count_distinct(owner).alias("n")).filter(F.col("n") >= least)
    seen = evidence.select(token).distinct().withColumn("__seen", F.lit(True))
    return known.join(seen, token, "left").select(token, "n", F.coalesce("__seen", F.lit(False)).alias("confirmed"))


def confirmed_enums(members: DataFrame, enum: str, assembly: str, stem: str, names: DataFrame, least: int = 6) -> DataFrame:
    """(enum, stem) of the enums of which ``least`` distinct members name something, all members of such an enum.

    members: (enum, assembly, stem). Only those of the assembly with most enums count, ties to the smaller
    name: it is the project's own. names: (stem) of what exists.
    """
    rows = members.select(enum, assembly, stem).distinct()
    own = rows.groupBy(assembly).agg(F.count_distinct(enum).alias("__n")).orderBy(F.desc("__n"), assembly).limit(1).select(assembly)
    rows = rows.join(own, assembly, "left_semi").select(enum, stem).distinct()
    hit = rows.join(names.select(stem).distinct(), stem, "left_semi").groupBy(enum).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least)
    return rows.join(hit.select(enum), enum, "left_semi")


def merged_vocabulary(sources: list[DataFrame], key: str, display: str) -> DataFrame:
    """(key, display, source) over tables (key, display), strongest first: the first table that has a key names it, by its smallest display."""
    rows = reduce(DataFrame.unionByName, [d.select(key, display, F.lit(k).alias("source")) for k, d in enumerate(sources)])
    best = F.min(F.struct("source", display))
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(best.alias("__b")).select(key, f"__b.{display}", "__b.source")


def assemble_objects(sprites: DataFrame, declared: DataFrame, clips: DataFrame, most: int = 49) -> DataFrame:
    """(sprite, object, part, clip): each sprite's object, whether it is a part of a whole, and the first clip that shows the object.

    sprites: (sprite, name, area); declared: (sprite, marker); clips: (clip, sprite); ids are numbers.
    Sets that are declared for two sprites at least come first. Then a sprite whose name's words open those
    of others is their whole, if these have two kinds at least, three of a kind on average at most, none is
    larger and one is smaller. A kind is the words behind the whole's without numbers. Then clips in order:
    one of 2 to ``most`` sprites of which half are one object's (most of them, ties to the smaller object)
    shows that object; else its sprites that have no object yet, two at least, become one. The rest stand alone.
    Only clips that share sprites without an object wait for each other; each such component is one group.
    """
    base = sprites.select("sprite", "name", "area").dropDuplicates(["sprite"])
    marked = declared.join(base.select("sprite"), "sprite", "left_semi").groupBy("sprite").agg(F.min("marker").alias("marker"))
    sets = marked.groupBy("marker").agg(F.count("*").alias("n")).filter("n >= 2").select("marker")
    home = marked.join(sets, "marker", "left_semi").select("sprite", F.concat(F.lit("set:"), "marker").alias("object"), F.lit(True).alias("part"))

    parents = joins.longest_prefix_parent(base, "sprite", "name")
    up = base.select("sprite").join(parents, "sprite", "left")
    roots = graph.flatten_to_root(up, "sprite", "parent").filter("depth > 0").select(F.col("node").alias("sprite"), F.col("root").alias("whole"))
    top = base.select(F.col("sprite").alias("whole"), F.size(joins.name_tokens("name")).alias("words"), F.col("area").alias("whole_area"))
    parts = roots.join(base, "sprite").join(top, "whole")
    kind = F.array_join(F.filter(F.slice(joins.name_tokens("name"), F.col("words") + 1, F.greatest(F.size(joins.name_tokens("name")) - F.col("words"), F.lit(0))), lambda w: ~w.rlike("^[0-9]+$")), " ")
    parts = parts.withColumn("kind", kind)
    g = parts.groupBy("whole").agg(F.count_distinct("kind").alias("kinds"), F.count("*").alias("n"), F.max(F.col("area") - F.col("whole_area")).alias("over"), F.min(F.col("area") - F.col("whole_area")).alias("under"))
    good = g.filter("kinds >= 2 and n <= 3 * kinds and over <= 0 and under < 0").select("whole")
    pairs = parts.join(good, "whole", "left_semi").select("whole", "sprite")
    every = pairs.unionByName(pairs.select("whole", F.col("whole").alias("sprite")).distinct())
    taken = every.join(home.select("sprite"), "sprite", "left_semi").select("whole").distinct()
    free = every.join(taken, "whole", "left_anti").select("sprite", F.concat(F.lit("whole:"), F.col("whole").cast("string")).alias("object"), (F.col("sprite") != F.col("whole")).alias("part"))
    home = cut(home.unionByName(free))

    drawn = clips.select("clip", "sprite").distinct().join(base.select("sprite"), "sprite", "left_semi")
    sized = drawn.groupBy("clip").agg(F.count("*").alias("drawn")).filter(F.col("drawn").between(2, most))
    drawn = cut(drawn.join(sized, "clip").join(home.select("sprite", "object"), "sprite", "left"))
    shared = drawn.filter("object is null").select(F.concat(F.lit("c"), F.col("clip").cast("string")).alias("a"), F.concat(F.lit("s"), F.col("sprite").cast("string")).alias("b"))
    component = graph.connected_components(shared, "a", "b").filter(F.startswith("node", F.lit("c"))).select(F.substr("node", F.lit(2)).cast("long").alias("clip"), "component")
    rows = drawn.join(component, "clip", "left").withColumn("component", F.coalesce("component", F.concat(F.lit("c"), F.col("clip").cast("string"))))

    def seat(rows: pd.DataFrame) -> pd.DataFrame:
        placed, out = {}, []
        for clip, own in rows.sort_values(["clip", "sprite"]).groupby("clip", sort=True):
            seats = Counter(x for s, o in zip(own["sprite"], own["object"], strict=True) if (x := o or placed.get(s)))
            if seats:
                best = min(seats, key=lambda o: (-seats[o], o))
                if 2 * seats[best] >= len(own):
                    out.append((None, best, clip))
                    continue
            loose = [s for s, o in zip(own["sprite"], own["object"], strict=True) if not o and s not in placed]
            if len(loose) >= 2:
                placed |= dict.fromkeys(loose, f"clip:{clip}")
                out += [(s, f"clip:{clip}", clip) for s in loose]
        got = pd.DataFrame(out, columns=["sprite", "object", "clip"])
        return got.astype({"sprite": "Int64", "clip": "int64"})

    seated = cut(rows.select("component", "clip", "sprite", "object").groupBy("component").applyInPandas(seat, "sprite long, object string, clip long"))
    home = home.unionByName(seated.filter("sprite is not null").select("sprite", "object", F.lit(True).alias("part")))
    shown = seated.groupBy("object").agg(F.min("clip").alias("clip"))
    out = base.select("sprite").join(home, "sprite", "left")
    out = out.select("sprite", F.coalesce("object", F.concat(F.lit("alone:"), F.col("sprite").cast("string"))).alias("object"), F.coalesce("part", F.lit(False)).alias("part"))
    return out.join(shown, "object", "left").select("sprite", "object", "part", "clip")
