"""A Merkle tree over a dataset's rows, with proofs from checkpoints: only every third level of nodes is stored."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.llm.storage import stored
from stratafold.operators.aggs import numbered_rows

#: Children of a node, and levels from one stored level to the next.
ARITY, LEVELS = 16, 3
SPAN = ARITY**LEVELS


def value_text(value: Column) -> Column:
    """``-`` for a null, else the number of its UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values' texts one after the other."""
    return F.sha2(F.concat(*map(value_text, values)), 256)


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def interior(nodes: list[str], alone: bool) -> list[list[str]]:
    """``nodes`` of an aligned subtree and the levels above them: ``LEVELS``, or until one node is left where the subtree is ``alone``."""
    made = [nodes]
    while len(made) <= LEVELS and not (alone and len(made[-1]) == 1):
        made.append([digest(made[-1][k : k + ARITY]) for k in range(0, len(made[-1]), ARITY)])
    return made


def siblings(made: list[list[str]], at: int) -> list[str]:
    """For each level below the top, the nodes before and after the one above node ``at`` in its run, a bar between them."""
    steps = []
    for level in made[:-1]:
        run = at - at % ARITY
        steps.append("".join(level[run:at]) + "|" + "".join(level[at + 1 : run + ARITY]))
        at //= ARITY
    return steps


def fold_path(node: str, path: list[str]) -> str:
    """The root that ``node`` makes with the siblings on its path."""
    for step in path:
        before, after = step.split("|")
        node = digest([before, node, after])
    return node


def checkpoints(level: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The stored levels of a tree for each ``tree`` of (tree, at, last, node), itself stored, and (tree, root).

    ``last`` is the last place of the tree's level. A stored level is every third one: each aligned subtree
    of 16 ** 3 nodes is folded in one task, and only its top is written. A tree ends at the level where it has
    one node. The number of rounds is the logarithm of the largest tree's nodes to the base of 4,096.
    """
    kept, roots = [], None

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        top = interior(rows.sort_values("at")["node"].tolist(), key[2] < SPAN)[-1]
        return pd.DataFrame({"tree": [key[0]], "at": [key[1]], "last": [key[2] // SPAN], "node": top})

    while True:
        kept.append(level)
        done = level.filter("last = 0").select("tree", F.col("node").alias("root"))
        roots = done if roots is None else roots.unionByName(done)
        more = level.filter("last > 0").select("tree", F.expr(f"at div {SPAN}").alias("subtree"), "last", "at", "node")
        if more.isEmpty():
            return kept, stored(roots, "roots")
        level = stored(more.groupBy("tree", "subtree", "last").applyInPandas(fold, "tree string, at long, last long, node string"), "level")


def node_paths(level: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, subtree, path) for the level below: siblings of each node of ``level`` from its run up to the root.

    ``above`` has the path of the top of each aligned subtree of ``level``. Interior nodes are made
    again from the stored nodes of the subtree, read for their siblings, and forgotten.
    """

    def spread(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        made, rest = interior(rows["node"].tolist(), rows["last"].iloc[0] < SPAN), list(rows["path"].iloc[0])
        return pd.DataFrame({"tree": rows["tree"].to_numpy(), "subtree": rows["at"].to_numpy(), "path": [siblings(made, k) + rest for k in range(len(rows))]})

    met = level.select("tree", F.expr(f"at div {SPAN}").alias("subtree"), "last", "at", "node").join(above, ["tree", "subtree"])
    return met.groupBy("tree", "subtree").applyInPandas(spread, "tree string, subtree long, path array<string>")


def _placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Stored rows with ``at``, the place from 0 among the rows of their tree by ``order``, and ``last``, the last place; from one sort of all rows."""
    rows = numbered_rows(leaves, ["tree", *order], "__n")
    ends = rows.groupBy("tree").agg(F.min("__n").alias("__first"), (F.max("__n") - F.min("__n")).alias("last"))
    return stored(rows.join(ends, "tree").withColumn("at", F.col("__n") - F.col("__first")).drop("__n", "__first"), "placed")


def merkle_proofs(leaves: DataFrame, source: str, order: list[str]) -> DataFrame:
    """Adds subroot, root, proof_sha256, folded_root and verified to ``leaves`` with their digests ``leaf`` and ``tampered``.

    Leaves of one ``source``, by ``order`` and then by digest, nulls first, stand in runs of 16, whose digests are
    nodes in turn, until one node is left, the subroot; a tree of one leaf has that as its subroot. Subroots,
    by ``source``, nulls first, make one tree more, whose top is the root. A proof is the siblings of a
    leaf's run and of each run above it, and ``proof_sha256`` the digest of all of them in order, of
    no text where nothing has siblings. ``folded_root`` is folded from ``tampered`` and the original siblings.

    Repeated rows are leaves each; an empty table gives an empty result. Only every third level is stored, one
    subtree of 4,096 nodes is in a task at a time, and no source is in one task.
    """
    own = [c for c in leaves.columns if c != source]
    # A null source is "-", which is less than "=".
    base = _placed(leaves.withColumn("tree", F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("-"))).drop(source), [*order, "leaf", "tampered"])
    levels, subroots = checkpoints(base.withColumnRenamed("leaf", "node"))

    tops = _placed(subroots.select(F.lit("*").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("node")), ["name"])
    top_levels, top_roots = checkpoints(tops)
    found = top_roots.first()
    root = found["root"] if found else ""

    paths = top_roots.select("tree", F.lit(0).cast("long").alias("subtree"), F.array().cast("array<string>").alias("path"))
    for level in reversed(top_levels):
        paths = node_paths(level, paths)
    named = tops.select("name", F.col("at").alias("subtree"))
    subroot_paths = stored(paths.join(named, "subtree").select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("subtree"), "path"), "paths")

    paths = None
    for level in reversed(levels[1:]):
        paths = stored(node_paths(level, _tops_of(level, subroot_paths, paths)), "paths")
    above = _tops_of(levels[0], subroot_paths, paths).join(subroots.withColumnRenamed("root", "subroot"), "tree")

    def prove(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at", ignore_index=True)
        made, rest = interior(rows["leaf"].tolist(), rows["last"].iloc[0] < SPAN), list(rows["path"].iloc[0])
        proofs, folded = [], []
        for k, node in enumerate(rows["tampered"].tolist()):
            path = siblings(made, k) + rest
            proofs.append(digest([s.replace("|", "") for s in path]))
            folded.append(fold_path(node, path))
        rows = rows.assign(root=root, proof_sha256=proofs, folded_root=folded)
        rows["verified"] = rows["folded_root"] == root
        return rows[[*own, "subroot", "root", "proof_sha256", "folded_root", "verified"]]

    # Other columns travel as text, for an integer with nulls would turn into a float.
    kinds = dict(leaves.dtypes)
    met = base.withColumn("subtree", F.expr(f"at div {SPAN}")).join(above, ["tree", "subtree"]).withColumns({c: F.col(c).cast("string") for c in own})
    schema = ", ".join([*(f"`{c}` string" for c in own), "subroot string", "root string", "proof_sha256 string", "folded_root string", "verified boolean"])
    return met.groupBy("tree", "subtree").applyInPandas(prove, schema).withColumns({c: F.col(c).cast(kinds[c]) for c in own})


def _tops_of(level: DataFrame, subroot_paths: DataFrame, paths: DataFrame | None) -> DataFrame:
    """(tree, subtree, path) for each subtree of ``level``: from the level above, or of the subroot where a tree has one subtree."""
    alone = level.filter(f"at = 0 and last < {SPAN}").select("tree")
    whole = subroot_paths.join(alone, "tree", "left_semi")
    return whole if paths is None else whole.unionByName(paths.join(alone, "tree", "left_anti"))


def dataset_manifest(df: DataFrame, id_col: str, source_col: str, others: list[str], text_col: str, tamper: Column) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row, one tree for each source.

    A leaf is the digest of id, source, ``others`` and text. Where ``tamper`` holds, the row is
    checked as if A to Z in its text were small. See ``merkle_proofs`` for nulls, ties and empty tables.
    """
    small = F.translate(text_col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    head = [F.col(c) for c in (id_col, source_col, *others)]
    leaf = leaf_digest(*head, F.col(text_col))
    changed = F.when(F.coalesce(tamper, F.lit(False)), leaf_digest(*head, small)).otherwise(leaf)
    leaves = df.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), leaf.alias("leaf"), changed.alias("tampered"))
    proved = merkle_proofs(leaves, "source", ["id"])
    return proved.select(F.col("id").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
