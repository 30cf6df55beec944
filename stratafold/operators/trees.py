"""Values that trees hand down or add up, in rounds that grow with the logarithm of the nodes and not with the depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.operators.storage import cut, cut_and_count, cut_in_rounds, dropped

#: A prime below 2 ** 31, so that products of two residues fit a long; hashes are ``LANES`` residues.
PRIME, LANES = (1 << 31) - 1, 4
#: Nodes of a round in which all nodes are joined, about, and rounds at most.
ROUND_ROWS, ROUNDS = 1_000_000, 16


def compose(outer: Column, inner: Column) -> Column:
    """The affine map (a, b, c, d, e, f), x' = a x + b y + c and y' = d x + e y + f, that applies ``inner`` first."""
    o, i = [outer[k] for k in range(6)], [inner[k] for k in range(6)]
    row = lambda p, q, r: [p * i[0] + q * i[3], p * i[1] + q * i[4], p * i[2] + q * i[5] + r]
    return F.array(*row(*o[:3]), *row(*o[3:]))


def _meet(how: str, above: Column, own: Column) -> Column:
    """What a node has from its own value and from its ancestors'; associative, so stretches of ancestors can be put together first."""
    if how == "all":
        return above & own
    if how == "nearest":
        return F.coalesce(own, above)
    if how == "path":
        return F.concat_ws("/", above, own)
    # An affine map leads from a node to its parent; that of a span leads from the parent's to the node's.
    outer, inner = (own, above) if how == "span" else (above, own)
    return F.when(outer.isNotNull() & inner.isNotNull(), compose(outer, inner))


def _as_map(span: Column, is_root: Column) -> Column:
    """The map from the parent's (start, length) to a node's: a root's is constant."""
    size = span["high"] - span["low"]
    zero, one = F.lit(0.0), F.lit(1.0)
    inner = F.array(one, span["low"], span["at"] - span["size"] * span["pivot"], zero, size, span["size"])
    root = F.array(zero, zero, span["start"].cast("double"), zero, zero, span["length"].cast("double"))
    return F.when(is_root, root).otherwise(inner)


def handed_down(nodes: DataFrame, node: str, parent: str, inherit: dict[str, str]) -> DataFrame:
    """(node, level, inherited columns) of every node below a root, its own value and its ancestors' put together.

    ``inherit`` names columns and how: ``all`` (true where it and all ancestors are), ``nearest`` (the nearest
    value that is not null, its own first), ``path`` (texts from the root down, with slashes), ``affine`` (maps
    of six numbers, the node's own applied first), ``span`` (start and length on one axis; a root's own struct
    has these, other nodes' low, high, size, at and pivot, and start counts from the root).

    Pointers double: after k rounds a row holds its nearest 2 ** k ancestors. A root has a null parent; nodes
    without a root above them, as below a parent that is no node or on a cycle, are left out.
    """
    root = F.col(parent).isNull()
    values = [(_as_map(F.col(c), root) if how == "span" else F.col(c)).alias(c) for c, how in inherit.items()]
    state, moving = cut_and_count(nodes.select(F.col(node).alias("node"), F.col(parent).alias("up"), (~root).cast("long").alias("level"), *values), F.col("up").isNotNull())
    for _ in range(state.count().bit_length() if moving else 0):
        above = state.select(F.col("node").alias("up"), F.col("up").alias("__up"), F.col("level").alias("__level"), *[F.col(c).alias(f"__{c}") for c in inherit])
        met = [_meet(how, F.col(f"__{c}"), F.col(c)).alias(c) for c, how in inherit.items()]
        moved = state.filter("up is not null").join(above, "up").select("node", F.col("__up").alias("up"), (F.col("level") + F.col("__level")).alias("level"), *met)
        state, moving = cut_and_count(state.filter("up is null").unionByName(moved), F.col("up").isNotNull())
        if not moving:
            break
    spans = [F.when(F.col(c).isNotNull(), F.struct(F.col(c)[2].alias("start"), F.col(c)[5].alias("length"))).alias(c) if how == "span" else F.col(c) for c, how in inherit.items()]
    return state.filter("up is null").select("node", F.col("level").cast("int").alias("level"), *spans)


def subtree_totals(nodes: DataFrame, node: str, parent: str, item: str, adds: dict[str, Column], keep: dict[str, Column] | None = None) -> DataFrame:
    """(node, parent, shape, adds, keep, leaves): for each node a hash of its subtree's items and nesting, and sums over the subtree.

    Subtrees of equal items and nesting have equal shapes, whatever the order of the children. ``adds`` are
    whole numbers of a node, ``keep`` other values of its own; leaves counts its children that are leaves, and is null for
    a leaf. Nodes of a cycle, and those above one, are left out; node ids are unique.

    Trees are contracted: in each round all nodes whose children are known become known (leaves are raked),
    and a node that waits for one child is a map of that child's values. Maps of neighbours in such a chain are put
    together by doubling pointers, so a chain becomes known in one round, whatever its length. What a node
    is depends on its subtree alone, so equal subtrees take equal ways. Children are added up as hashes
    and counted, never gathered. A round reads the rows that are not known yet.

    Leaves are known from their item, so only the other nodes get numbers and are joined: children are first added up as if
    all were leaves, which takes no join, and those that are none are taken off again. Joins of all nodes take
    ``ROUND_ROWS`` at a time, about, and what is stored goes once it is read for the last time.
    """
    spark, keep = nodes.sparkSession, keep or {}
    lanes, sums, hashes, zero = range(LANES), [f"s{k}" for k in range(LANES)], [f"h{k}" for k in range(LANES)], F.lit(0).cast("long")
    residue = lambda salt, *of: F.pmod(F.xxhash64(F.lit(salt), *of), F.lit(PRIME))
    had = lambda c: F.coalesce(F.col(c), zero)
    shape = F.concat(*[F.lpad(F.hex(h), 8, "0") for h in hashes]).alias("shape")
    given = [F.sum(residue(f"g{k}", *hashes)).alias(f"g{k}") for k in lanes]
    as_leaves = lambda rows: rows.select("*", *[residue(f"h{k}", "item", *[zero] * LANES).alias(f"h{k}") for k in lanes])
    held = [F.col(f"__keep{k}").alias(c) for k, c in enumerate(keep)]
    base = cut(nodes.select(F.col(node).alias("name"), F.col(parent).alias("up"), F.col(item).cast("string").alias("item"), *[a.alias(c) for c, a in adds.items()], *[v.alias(f"__keep{k}") for k, v in enumerate(keep.values())]).filter("name is not null"))
    rounds = min(ROUNDS, base.count() // ROUND_ROWS + 1)
    of = lambda rows, c, k: rows.filter(F.pmod(F.xxhash64(c), F.lit(rounds)) == k) if rounds > 1 else rows

    def marked_part(k: int) -> DataFrame:
        kids = as_leaves(of(base.filter("up is not null"), "up", k)).groupBy(F.col("up").alias("__up")).agg(F.count("*").alias("kids"), *given, *[F.sum(c).alias(f"more_{c}") for c in adds])
        return of(base, "name", k).join(kids, F.col("name") == F.col("__up"), "full").withColumn("node", F.monotonically_increasing_id() + F.lit(k << 57))

    marked = cut_in_rounds(marked_part, rounds, spark)
    dropped(base)
    inner = marked.filter("name is not null and kids is not null")

    def placed_part(k: int) -> DataFrame:
        above = of(inner, "name", k).select(F.col("name").alias("up"), F.col("node").alias("parent"))
        return of(inner, "up", k).join(above, "up", "left").select("node", "parent", "item", *adds, "kids", *[f"g{k}" for k in lanes], *[f"more_{c}" for c in adds])

    placed = cut_in_rounds(placed_part, rounds, spark)
    # A map of hashes for each lane, x -> c + m x, and ``ptr``, the node whose values it takes.
    mapped = [f"{x}{k}" for x in "cm" for k in lanes]

    def turned(live: DataFrame) -> DataFrame:
        # Raked nodes have no pointer and wait for none; what waits for one becomes a map of it.
        turns = F.col("ptr").isNull() & (F.col("waits") == 1)
        into = {f"c{k}": residue(f"c{k}", "item", *sums) for k in lanes} | {f"m{k}": residue(f"m{k}", "item", *sums) % F.lit(PRIME - 1) + 1 for k in lanes}
        return live.select(*[c for c in live.columns if c != "ptr" and c not in mapped], *[F.when(turns, into[c]).otherwise(F.col(c)).alias(c) for c in mapped], F.when(turns, F.col("rest")).otherwise(F.col("ptr")).alias("ptr"))

    def live_part(k: int) -> DataFrame:
        off = [F.sum(residue(f"g{k}", *hashes)).alias(f"off{k}") for k in lanes]
        kids = as_leaves(of(placed.filter("parent is not null"), "parent", k)).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("waits"), F.bit_xor("node").alias("rest"), *off, *[F.sum(c).alias(f"off_{c}") for c in adds])
        rows = of(placed, "node", k).join(kids, "node", "left")
        return turned(rows.select(
            "node", "parent", "item", (F.col("kids") - had("waits")).alias("leaves"), *[(F.col(c) + had(f"more_{c}") - had(f"off_{c}")).alias(c) for c in adds], had("waits").alias("waits"), had("rest").alias("rest"),
            *[(F.col(f"g{k}") - had(f"off{k}")).alias(f"s{k}") for k in lanes], F.lit(None).cast("long").alias("ptr"), *[zero.alias(c) for c in mapped],
        ))

    live = cut_in_rounds(live_part, rounds, spark)
    dropped(placed)
    new, parts, result = None, [], ["node", "parent", "leaves", *adds]
    while True:
        waiting = live.filter("ptr is not null").count()
        raked = live.filter("waits = 0 and ptr is null").select(*result, *[residue(f"h{k}", "item", *sums).alias(f"h{k}") for k in lanes])
        still = live.filter("waits > 0 and ptr is null")
        chains, last = live.filter("ptr is not null"), None
        for turn in range(waiting.bit_length() + 1 if waiting else 0):
            # Both lookups are of the same table, so a pointer passes up to three links in a round.
            step = chains.select(F.col("node").alias("ptr"), F.col("ptr").alias("__ptr"), *[F.col(c).alias(f"__{c}") for c in [*mapped, *adds]])
            own = chains.columns
            for _ in range(2):
                joined = chains.join(step, "ptr", "left")
                met = F.col("__ptr").isNotNull()
                maps = {f"c{k}": (F.col(f"c{k}") + F.col(f"m{k}") * F.col(f"__c{k}")) % PRIME for k in lanes} | {f"m{k}": F.col(f"m{k}") * F.col(f"__m{k}") % PRIME for k in lanes}
                maps |= {c: F.col(c) + F.col(f"__{c}") for c in adds} | {"ptr": F.col("__ptr")}
                went = {"moved": met | F.col("moved")} if "moved" in chains.columns else {"moved": met}
                chains = joined.select(*[F.when(met, maps[c]).otherwise(F.col(c)).alias(c) if c in maps else F.col(c) for c in own], went["moved"].alias("moved"))
            before, (last, moving) = last, cut_and_count(chains, F.col("moved"))
            dropped(*[before] if before is not None else [])
            # What still moves after as many rounds as the chains' number has binary digits is on a cycle, and goes.
            chains = last.filter("not moved").drop("moved") if turn == waiting.bit_length() else last.drop("moved")
            if not moving:
                break
        new = raked
        if waiting:
            end = raked.select(F.col("node").alias("ptr"), *[F.col(c).alias(f"__{c}") for c in [*hashes, *adds]])
            done = chains.join(end, "ptr").select("node", "parent", "leaves", *[(F.col(c) + F.col(f"__{c}")).alias(c) for c in adds], *[((F.col(f"c{k}") + F.col(f"m{k}") * F.col(f"__h{k}")) % PRIME).alias(f"h{k}") for k in lanes])
            new = raked.unionByName(done)
        new, found = cut_and_count(new, F.lit(True))
        if found and len(parts) >= 16:
            old, parts = parts, [cut(reduce(DataFrame.unionByName, [*parts, new]))]
            dropped(*old)
        elif found or not parts:
            parts.append(new)
        else:
            dropped(new)
        if found:
            brought = new.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("came"), F.bit_xor("node").alias("gone"), *given, *[F.sum(c).alias(f"more_{c}") for c in adds])
            left = still.unionByName(chains.join(raked.select(F.col("node").alias("ptr")), "ptr", "left_anti").select(still.columns)) if waiting else still
            left = left.join(brought, "node", "left").select(
                "node", "parent", "item", "leaves", *[(F.col(c) + had(f"more_{c}")).alias(c) for c in adds], (F.col("waits") - had("came")).alias("waits"), F.col("rest").bitwiseXOR(had("gone")).alias("rest"),
                *[(F.col(f"s{k}") + had(f"g{k}")).alias(f"s{k}") for k in lanes], "ptr", *mapped,
            )
            before, live = live, cut(turned(left))
            dropped(before)
        dropped(*[last] if last is not None else [])
        if not found:
            break
    dropped(live)
    whole = reduce(DataFrame.unionByName, parts)

    def named_part(k: int) -> DataFrame:
        back = of(inner, "node", k).select("node", "name", "up", *[f"__keep{k}" for k in range(len(keep))])
        return of(whole, "node", k).join(back, "node").select(F.col("name").alias("node"), F.when(F.col("parent").isNotNull(), F.col("up")).alias("parent"), shape, *adds, *held, "leaves")

    others = cut_in_rounds(named_part, rounds, spark)
    dropped(*parts)
    # A parent that is no node is none.
    orphans = marked.filter("name is null").select(F.col("__up").alias("up"), F.lit(True).alias("__none"))
    leaves = marked.filter("kids is null")
    leaves = leaves.withColumn("__none", F.lit(None).cast("boolean")) if orphans.isEmpty() else leaves.join(orphans, "up", "left")
    leaves = as_leaves(leaves).select(F.col("name").alias("node"), F.when(F.col("__none").isNull(), F.col("up")).alias("parent"), shape, *adds, *held, F.lit(None).cast("long").alias("leaves"))
    return others.unionByName(leaves)
