"""Iterative operators against plain versions on random input."""

import random

from stratafold.operators import aggs as A
from stratafold.operators import graph as G
from stratafold.operators import incremental as I
from stratafold.operators import joins as J
from stratafold.operators import windows as W
from stratafold.plans import catalogue


def test_components_equal_union_find(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = G.connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for x in root}


def test_flatten_a_deep_chain_and_leave_out_cycles(spark):
    nodes = [(0, None), *((k, k - 1) for k in range(1, 300)), (900, 901), (901, 900), (910, 911), (911, 912), (912, 910), (920, 910), (950, 951)]
    got = {r["node"]: (r["root"], r["depth"]) for r in G.flatten_to_root(spark.createDataFrame(nodes, "n long, p long"), "n", "p").collect()}
    assert got == {k: (0, k) for k in range(300)} | {950: (951, 1)}


def test_path_of_stops_at_roots_and_leaves_out_cycles(spark):
    nodes = [(0, None, "root"), *((k, k - 1, f"n{k}") for k in range(1, 40)), (50, 49, "lost"), (60, 61, "a"), (61, 62, "b"), (62, 60, "c"), (63, 62, "d"), (70, None, None), (71, 70, None)]
    got = {r["node"]: r["path"] for r in G.path_of(spark.createDataFrame(nodes, "n long, p long, name string"), "n", "p", "name").collect()}
    assert got == {k: "/".join(f"n{j}" for j in range(1, k + 1)) for k in range(40)} | {50: "lost", 70: "", 71: ""}


def test_walk_down_inherits(spark):
    schema = "n long, p long, name string, shown boolean, mask string, m array<double>, x struct<start: double, length: double, low: double, high: double, size: double, at: double, pivot: double>"
    rows = [
        (1, None, "a", True, "A", [2.0, 0.0, 1.0, 0.0, 2.0, 0.0], (10.0, 100.0, None, None, None, None, None)),
        (2, 1, "b", False, None, [1.0, 0.0, 3.0, 0.0, 1.0, 4.0], (None, None, 0.5, 1.0, -10.0, 5.0, 0.5)),
        (3, 2, "c", True, "C", [0.0, -1.0, 0.0, 1.0, 0.0, 0.0], (None, None, 0.0, 0.0, 8.0, 0.0, 0.0)),
    ]
    got = {r["node"]: r for r in G.walk_down(spark.createDataFrame(rows, schema), "n", "p", "name", {"shown": "all", "mask": "nearest", "m": "affine", "x": "span"}).collect()}
    assert [(got[k]["shown"], got[k]["mask"]) for k in (1, 2, 3)] == [(True, "A"), (False, "A"), (False, "C")]
    assert got[2]["m"] == [2.0, 0.0, 7.0, 0.0, 2.0, 8.0] and got[3]["m"] == [0.0, -2.0, 7.0, 2.0, 0.0, 8.0]
    assert tuple(got[1]["x"]) == (10.0, 100.0) and tuple(got[2]["x"]) == (70.0, 40.0) and tuple(got[3]["x"]) == (70.0, 8.0)


def test_subtrees_are_cut_where_they_repeat(spark):
    # Two benches of two planks each below rooms, a lone lamp, and a marker that draws nothing.
    rows = [(0, None, "scene", None), (1, 0, "room", None), (2, 0, "hall", None), (10, 1, "Bench (1)", "legs"), (11, 10, "x", "plank"), (12, 10, "y", "seat"), (20, 2, "Bench", "legs"), (21, 20, "p", "seat"), (22, 20, "q", "plank"), (30, 2, "lamp", "bulb"), (40, 0, "marker", None)]
    got = {(r["name"], r["drawn"], r["placements"]) for r in G.repeated_subtrees(spark.createDataFrame(rows, "n long, p long, name string, item string"), "n", "p", "item", "name").collect()}
    # The room draws a bench alone and the hall a bench and the lamp, so both are cut further.
    assert got == {("Bench", 3, 2), ("lamp", 1, 1)}
    assert G.repeated_subtrees(spark.createDataFrame([], "n long, p long, name string, item string"), "n", "p", "item", "name").count() == 0


def test_numbered_rows_keep_every_row(spark):
    from pyspark.sql import functions as F

    for parts in ("8", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        for df in (spark.range(600_000).select((F.col("id") * 7919 % 600_000).alias("k")), spark.range(200_000).select((F.col("id") * 7919 % 200_000).alias("k"), F.repeat(F.col("id").cast("string"), 20).alias("wide"))):
            n = df.count()
            got = A.numbered_rows(df, ["k"], "number").agg(F.count("*"), F.count_distinct("number"), F.min(F.col("number") - F.col("k")), F.max(F.col("number") - F.col("k"))).first()
            assert tuple(got) == (n, n, 1, 1)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert A.numbered_rows(spark.range(0), ["id"], "number").count() == 0


def test_subtree_signature_ignores_the_order_of_children(spark):
    nodes = [(1, None, "a"), (2, 1, "b"), (3, 1, "c"), (4, None, "a"), (5, 4, "c"), (6, 4, "b"), (7, None, "a"), (8, 7, "b")]
    got = {r["node"]: (r["size"], r["signature"]) for r in G.subtree_signature(spark.createDataFrame(nodes, "n long, p long, i string"), "n", "p", "i").collect()}
    assert got[1] == got[4] and got[1][0] == 3 and got[7][1] != got[1][1]


def test_upsert_twice_equals_once(spark):
    old = spark.createDataFrame([(1, "a", "ga"), (2, "b", "gb"), (3, "c", "gc")], "row_id long, path string, guid string")
    new = spark.createDataFrame([("a", "ga"), ("d", "gb"), ("e", "ge")], "path string, guid string")
    once = I.upsert(old, new, "row_id", "path", "guid")
    assert {(r["path"], r["row_id"]) for r in once.collect()} == {("a", 1), ("d", 2), ("e", 4)}
    again = I.upsert(once, new, "row_id", "path", "guid")
    assert {(r["path"], r["row_id"]) for r in again.collect()} == {("a", 1), ("d", 2), ("e", 4)}


def test_banded_hamming_join_equals_brute_force(spark):
    rnd = random.Random(4)
    rows = [(k, rnd.getrandbits(16), k % 3) for k in range(120)]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] == b[2] and (a[1] ^ b[1]).bit_count() <= 3}
    got = J.hamming_join(spark.createDataFrame(rows, "id long, h long, g long"), "id", "h", "g", 3, 16).collect()
    assert {(r["id_a"], r["id_b"]) for r in got} == want


def test_asof_clamps_outside(spark):
    keys = spark.createDataFrame([(1, 10, 1.0), (1, 20, 3.0)], "e long, t long, v double")
    at = spark.createDataFrame([(1, 5), (1, 15), (1, 20), (1, 30)], "e long, t long")
    assert {r["t"]: r["v"] for r in J.asof_interpolate(keys, at, "e", "t", "v").collect()} == {5: 1.0, 15: 2.0, 20: 3.0, 30: 3.0}


def test_dense_labels_stay_distinct_beyond_four_digits(spark):
    got = W.dense_labels(spark.range(12_000), "id", "dup_").collect()
    assert {r["id"]: r["label"] for r in got} == {k: f"dup_{k + 1:04d}" for k in range(12_000)}


def test_contains_join_finds_stems_of_any_length(spark):
    names = spark.createDataFrame([(1, "old red oak tall tree house wall"), (2, "red oak")], "id long, name string")
    stems = spark.createDataFrame([("red oak tall tree house", 1), ("red oak", 2)], "stem string, k long")
    assert {r["id"]: r["stem"] for r in J.contains_join(names, "id", "name", stems, "stem", "k").collect()} == {1: "red oak tall tree house", 2: "red oak"}


def test_queries_over_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey", "o_orderkey").collect()
    root = {x: x for r in orders for x in (r[0], r[1] % 97 + 10000000)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in orders:
        a, b = find(r[0]), find(r[1] % 97 + 10000000)
        root[max(a, b)] = min(a, b)
    got = catalogue.queries()["grf4_components"](spark, sf).collect()
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for x in root}
    users = {r[0] for r in spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().collect()}
    wanted = sum(r[0] in users for r in orders)
    assert wanted and catalogue.queries()["jon12_asof_of_all_orders"](spark, sf).count() == wanted
    assert sum(r["members"] for r in catalogue.queries()["agg17_decomposition_of_all_parts"](spark, sf).collect()) > 100
