"""Queries against their SQL on keys beyond those of the smallest scales."""

import hashlib
import re
from collections import defaultdict

import duckdb
import pytest

from stratafold.operators import aggs as A
from stratafold.operators import catalog as C
from stratafold.operators import graph as G
from stratafold.operators import joins as J
from stratafold.operators import objects as O
from stratafold.operators import scalar as S
from stratafold.operators import trees
from stratafold.plans import catalogue


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """Customers, orders and parts with keys of more digits."""
    folder = tmp_path_factory.mktemp("wide")
    spark.range(0, 300_000, 1).filter("id % 1000 < 30").selectExpr("id AS c_custkey", "CAST(id % 7 AS DOUBLE) AS c_acctbal").write.parquet(f"{folder}/customer.parquet")
    spark.range(12_000).selectExpr("id AS o_orderkey", "id % 11000 AS o_custkey").write.parquet(f"{folder}/orders.parquet")
    spark.range(300).selectExpr("id AS p_partkey", "concat('n', id % 20) AS p_name", "CAST(id % 50 AS INT) AS p_size").write.parquet(f"{folder}/part.parquet")
    con = duckdb.connect()
    for t in ("customer", "orders", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return str(folder), con


def both(spark, wide, name):
    got = catalogue.queries()[name](spark, wide[0])
    return sorted(map(tuple, got.collect())), sorted(wide[1].execute(f"SELECT {', '.join(got.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall())


def test_upsert_gives_no_id_twice(spark, wide):
    got, want = both(spark, wide, "set1_upsert")
    assert got == want and len({r[2] for r in want}) == len(want)


def test_labels_of_more_than_9999_roots_differ(spark, wide):
    got, want = both(spark, wide, "win7_dense_labels")
    assert got == want and len({r[2] for r in want}) == 11_000


def test_packages_of_all_sizes_are_resolved(spark, wide):
    got, want = both(spark, wide, "src8_resolve_packages")
    assert got == want and sum(r[3] for r in want) == 300


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def digests(spark):
    """Orders of each digest of their sorted items."""
    items, found = defaultdict(list), defaultdict(list)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_returnflag", "l_linestatus").collect():
        items[r[0]].append(r[1] + r[2])
    for k, v in items.items():
        found[hashlib.md5(",".join(sorted(v)).encode()).hexdigest()].append(k)
    return found


def test_repeated_units_have_their_signature(spark, digests):
    got = catalogue.queries()["grf8_repeated_units"](spark, SF).collect()
    assert {(r["signature"], r["placements"], r["speaker"]) for r in got} == {(d, len(v), min(v)) for d, v in digests.items() if len(v) > 1}


def test_units_of_several_files_have_their_signature(spark, digests):
    owner = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey").collect()}
    got = catalogue.queries()["grf9_merge_units_across"](spark, SF).collect()
    want = {d: [k for k in v if k in owner] for d, v in digests.items()}
    assert {tuple(r) for r in got} == {(d, len(v), len({owner[k] for k in v}), min(owner[k] for k in v)) for d, v in want.items() if v}


def test_cluster_shares_are_of_touching_boxes(spark):
    shares = {r["grp"]: (r["clusters"], r["figures"], r["main"]) for r in catalogue.queries()["agg25_cluster_share"](spark, SF).collect()}
    figures = {r["grp"]: (r["figures"], r["main"]) for r in catalogue.queries()["job8_figure_stats"](spark, SF).collect()}
    assert {k: v[1:] for k, v in shares.items()} == figures and max(v[0] for v in shares.values()) > 2


def test_subtrees_that_repeat_are_not_looked_through(spark, monkeypatch):
    read, plain = [], trees.subtree_totals
    monkeypatch.setattr(trees, "subtree_totals", lambda nodes, *more: read.append(nodes.count()) or plain(nodes, *more))
    rows = [(f"r{k}", None, f"own{k}") for k in range(3)] + [(f"r{k}.{j}", f"r{k}", "leaf") for k in range(3) for j in range(40)]
    got = G.repeated_subtrees(spark.createDataFrame(rows, "node string, parent string, item string").selectExpr("*", "node AS name"), "node", "parent", "item", "name").collect()
    assert read == [123, 0] and [(r["name"], r["placements"]) for r in got] == [("r0.0", 120)]


def test_few_interned_values_are_broadcast(spark):
    rows = spark.range(3_000_000).selectExpr("id", "id % 3 AS v")  # beyond what Spark broadcasts
    values, got = A.intern_values(rows, ["v"])
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert got.selectExpr("count(*)", "count_if(ref = id % 3 + 1)").first()[:] == (3_000_000, 3_000_000)


def test_position_words_are_made_once_for_a_name(spark):
    stem, position = S.position_code("name", {"top": "t", "left": "l", "topleft": "tl"})
    df = spark.createDataFrame([("Crate_top_left_2",), ("crate",), ("top",), (None,), ("a left b top",)], "name string").select("name", stem.alias("stem"), position.alias("position"))
    assert [tuple(r)[1:] for r in df.collect()] == [("crate", "tl"), (None, None), (None, None), (None, None), ("a_b", "l")]
    assert df.select("stem")._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 4  # one for each mention of the finished record


def test_rows_of_one_name_meet_the_vocabulary_once(spark):
    rows = spark.range(5000).selectExpr("id", "CASE WHEN id = 7 THEN NULL WHEN id % 5 = 0 THEN 'no hit' ELSE 'big red oak' END AS name")
    keys = spark.createDataFrame([("redoak", "Red oak"), ("oak", "Oak"), ("big", "Big")], "key string, display string")
    got = J.longest_ngram_match(rows, "id", "name", keys, "key", "display")
    assert {tuple(r) for r in got.collect()} == {(k, "Red oak") for k in range(5000) if k % 5 and k != 7}
    # Nothing is grouped by row: the runs of 4,000 rows of a name are never sorted.
    assert not re.search(r"Aggregate \[id#", got._jdf.queryExecution().optimizedPlan().toString())


def test_models_are_dealt_before_lists_are_made(spark):
    draws = spark.createDataFrame([(o, m, p, s, (o + s) % 3) for o in range(20) for m in range(2) for p in range(3) for s in range(2)], "obj long, mesh long, placement long, slot long, material long")
    got = C.model_table(draws, "obj", "mesh", "slot", "material", spark.createDataFrame([(0, "t"), (1, None)], "material long, texture string"), "texture")
    assert {tuple(r) for r in got.collect()} == {(o, m, f"{o % 3},{(o + 1) % 3}", 0 in (o % 3, (o + 1) % 3), 3) for o in range(20) for m in range(2)}
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()


def test_candidates_of_a_name_meet_by_folder(spark):
    rows = spark.range(6000).selectExpr("id", "'crate' AS base", "IF(id % 61 = 0, NULL, concat('d', id % 60)) AS dir", "id % 13 AS w", "(id * 7) % 11 AS h")
    got = O.resolve_candidate(rows.filter("id < 900").withColumnRenamed("id", "want"), "want", rows.filter("id >= 900"), "id")
    files = [tuple(r) for r in rows.filter("id >= 900").collect()]

    def best(r):
        fits = [((r.w, r.h) != (w, h), r.dir != d, i) for i, _, d, w, h in files if (r.w, r.h) == (w, h) or abs(r.w * h - r.h * w) <= 0.01 * r.w * h]
        return [(r.id, i, not inexact, not apart) for inexact, apart, i in [min(fits)]] if fits else []

    assert sorted(map(tuple, got.collect())) == sorted(x for r in rows.filter("id < 900").collect() for x in best(r))
    # Sizes meet within a folder, not with those of all folders of a name.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join Inner" in line and "<=>" in line and "abs(" in line for line in plan.splitlines())
