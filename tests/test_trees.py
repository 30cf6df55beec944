"""Trees of any depth against plain walks, with cycles, dangling parents, nulls and empty tables."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stratafold.operators import graph as G
from stratafold.operators import objects as O
from stratafold.operators import storage, trees

NODES = "node long, parent long, item string, flag boolean, name string, m array<double>, s struct<start:double,length:double,low:double,high:double,size:double,at:double,pivot:double>"


def forest(n, seed, bend):
    """Random trees with the parents' places drawn near the own one where ``bend`` is small, so that they are deep."""
    rnd = random.Random(seed)
    rows = []
    for k in range(n):
        parent = None if k < 3 else rnd.randrange(max(0, k - bend), k)
        span = (rnd.random(), 1 + rnd.random(), rnd.random() / 2, 0.5 + rnd.random() / 2, rnd.random(), rnd.random(), rnd.random())
        rows.append((k, parent, rnd.choice(["a", "b", None]), rnd.choice([True, False, None]), rnd.choice(["x", "yy", "z"]), [round(rnd.uniform(-1, 1), 3) for _ in range(6)], span))
    # A dangling parent, a cycle of three with a tail, a self loop.
    extra = [(n, 10**6, "a"), (n + 1, n, "a"), (n + 2, n + 4, "a"), (n + 3, n + 2, "a"), (n + 4, n + 3, "a"), (n + 5, n + 4, "b"), (n + 6, n + 6, "b")]
    return rows + [(*e, True, "x", [1.0, 0.0, 0.0, 0.0, 1.0, 0.0], (0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.5)) for e in extra]


@pytest.mark.parametrize("bend", [1, 3, 200])
def test_values_are_handed_down(spark, bend):
    rows = forest(150, bend, bend)
    by = {r[0]: r for r in rows}
    want = {}
    for k in range(150):
        chain = [k]
        while by[chain[-1]][1] is not None:
            chain.append(by[chain[-1]][1])
        down = [by[x] for x in reversed(chain)]
        start, length = down[0][6][0], down[0][6][1]
        x = y = 0.0
        for r in reversed(down):
            x, y = r[5][0] * x + r[5][1] * y + r[5][2], r[5][3] * x + r[5][4] * y + r[5][5]
        for r in down[1:]:
            _, _, low, high, size, at, pivot = r[6]
            inner = length * (high - low) + size
            start, length = start + length * (low + (high - low) * pivot) + at - inner * pivot, inner
        items = [r[2] for r in down if r[2] is not None]
        want[k] = (len(chain) - 1, "/".join(r[4] for r in down), items[-1] if items else None, x, y, start, length)
    df = spark.createDataFrame(rows, NODES)
    got = G.walk_down(df, "node", "parent", "name", {"item": "nearest", "m": "affine", "s": "span"}).collect()
    assert {r["node"] for r in got} == set(want)
    for r in got:
        have = (r["level"], r["path"], r["item"], r["m"][2], r["m"][5], r["s"]["start"], r["s"]["length"])
        assert have[:3] == want[r["node"]][:3] and have[3:] == pytest.approx(want[r["node"]][3:], abs=1e-6, rel=1e-6)
    assert G.walk_down(df.filter("1 = 0"), "node", "parent", "name").count() == 0


@pytest.mark.parametrize("bend", [1, 3, 200])
def test_shapes_and_sums_of_subtrees(spark, bend):
    rows = forest(220, bend + 7, bend)
    kids = defaultdict(list)
    for r in rows:
        kids[r[1]].append(r[0])
    by, memo = {r[0]: r for r in rows}, {}
    for k in [225, *reversed(range(222))]:  # children have larger numbers; 225 hangs below a cycle
        if k in by:
            below = [memo[c] for c in kids[k]]
            memo[k] = (hashlib.md5(repr((by[k][2], sorted(b[0] for b in below))).encode()).hexdigest(), 1 + sum(b[1] for b in below), (by[k][2] is not None) + sum(b[2] for b in below))
    got = {r["node"]: r for r in G.subtree_shapes(spark.createDataFrame(rows, NODES), "node", "parent", "item").collect()}
    assert set(got) == set(memo)
    assert {k: r["drawn"] for k, r in got.items()} == {k: m[2] for k, m in memo.items()}
    pairs = {(memo[k][0], r["shape"]) for k, r in got.items()}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    sizes = {r["node"]: r["size"] for r in G.subtree_signature(spark.createDataFrame(rows, NODES), "node", "parent", "item").collect()}
    assert sizes == {k: m[1] for k, m in memo.items()}


def test_a_chain_of_100_000_nodes_takes_few_rounds(spark, monkeypatch):
    n, tables = 100_000, []
    whole = storage.stored
    monkeypatch.setattr(storage, "stored", lambda df, name: tables.append(name) or whole(df, name))
    chain = spark.range(n).selectExpr("id AS node", "nullif(id, 0) - 1 AS parent", "CAST(id % 7 AS STRING) AS item", "id % 40000 = 5 AS flag")
    got = O.nearest_ancestor(chain, "node", "parent", "flag").selectExpr("count(*) AS n", "count(holder) AS held", "sum(holder) AS total").first()
    assert tuple(got) == (n, n - 6, 5 * 40000 + 40005 * 40000 + 80005 * (n - 80006)) and len(tables) <= 40
    tables.clear()
    shapes = trees.subtree_totals(chain, "node", "parent", "item", {"size": G.F.lit(1).cast("long")}).selectExpr("count(*) AS n", "count(DISTINCT shape) AS shapes", "sum(size) AS total").first()
    assert tuple(shapes) == (n, n, n * (n + 1) // 2) and len(tables) <= 40


def test_nearest_ancestor_of_any_depth(spark):
    rows = forest(200, 4, 2)
    by = {r[0]: r for r in rows}
    flagged = defaultdict(list)
    for r in rows:
        if r[3] and r[1] is not None:
            flagged[r[1]].append(r[0])
    want = {}
    for k in range(200):
        mask = side = None
        up = by[k][1]
        while up is not None:
            mask = up if mask is None and by[up][3] else mask
            others = [x for x in flagged[by[up][1]] if x != up] if by[up][1] is not None else []
            side = min(others) if side is None and others else side
            up = by[up][1]
        want[k] = mask if mask is not None else side
    got = O.nearest_ancestor(spark.createDataFrame(rows, NODES), "node", "parent", "flag").collect()
    assert {r["node"]: r["holder"] for r in got} == want


def test_signatures_count_repeated_items(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "b"), (2, "a"), (2, "a"), (3, "a"), (3, "b"), (3, "b"), (4, None)]
    got = {r["owner"]: (r["n"], r["signature"]) for r in G.multiset_signature(spark.createDataFrame(rows, "owner long, item string"), "owner", "item").collect()}
    assert got[1] == got[2] and got[1] != got[3] and Counter(v[0] for v in got.values()) == {3: 3, 1: 1}


def test_subtrees_are_joined_in_rounds_and_little_stays_stored(spark, monkeypatch):
    monkeypatch.setattr(trees, "ROUND_ROWS", 100, raising=False)
    rnd = random.Random(4)
    rows = [(k, None if k % 41 == 0 else 900 if k % 37 == 0 else rnd.randrange(max(0, k - 60), k), f"i{rnd.randrange(2)}" if k % 5 else None) for k in range(200)]
    rows += [(400, 401, "a"), (401, 400, "b"), (402, 400, "i0"), (None, 3, "i1")]
    below = {}
    for n, p, _ in rows:
        if n is not None:
            below.setdefault(p, []).append(n)
    items = {n: i for n, _, i in rows}
    plain = lambda n: (items[n] or "", sorted(plain(k) for k in below.get(n, [])))
    size = lambda n: 1 + sum(map(size, below.get(n, [])))
    before = set(storage._STORED)
    got = trees.subtree_totals(spark.createDataFrame(rows, "node long, parent long, item string"), "node", "parent", "item", {"size": F.lit(1).cast("long")})
    # The marked nodes and the named ones stay; neither rounds nor what they read does.
    assert len(set(storage._STORED) - before) <= 2
    got = {r["node"]: r for r in got.collect()}
    assert set(got) == {*range(200), 402}
    assert all(got[n]["size"] == size(n) and got[n]["parent"] == (None if p == 900 else p) for n, p, _ in rows if n in got)
    shapes = {}
    for n in got:
        shapes.setdefault(got[n]["shape"], set()).add(str(plain(n)))
    assert all(len(v) == 1 for v in shapes.values()) and len(shapes) == len({str(plain(n)) for n in got})
