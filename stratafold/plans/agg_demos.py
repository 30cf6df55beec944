"""Queries of aggregates over the supplied tables."""

from pyspark.sql import functions as F

from stratafold.operators import aggs as A
from stratafold.operators import scalar as S
from stratafold.plans.registry import demo


@demo("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL ORDER BY n DESC, p_brand, p_type LIMIT 20")
def agg1_top_counts(t):
    return A.top_counts(t.part, ["p_brand", "p_type"], 20)


@demo("SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def agg2_count_distinct(t):
    return t.orders.groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("customers"))


@demo("""SELECT l_orderkey, round(avg(CASE WHEN l_discount > 0 THEN l_discount END), 9) AS mean, min_by(l_quantity, struct_pack(a := l_shipdate, b := l_partkey, c := l_quantity)) AS first_q,
max_by(l_quantity, struct_pack(a := l_shipdate, b := l_partkey, c := l_quantity)) AS last_q FROM lineitem GROUP BY 1""")
def agg3_group_report(t):
    key = F.struct("l_shipdate", "l_partkey", "l_quantity")
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.avg(F.when(F.col("l_discount") > 0, F.col("l_discount"))), 9).alias("mean"), F.min_by("l_quantity", key).alias("first_q"), F.max_by("l_quantity", key).alias("last_q"))


@demo("SELECT o_orderpriority, round(count(*) FILTER (o_orderstatus = 'F') / count(*) FILTER (o_totalprice > 1000), 9) AS share FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def agg4_share_where(t):
    return t.orders.groupBy("o_orderpriority").agg(F.round(A.share_where(F.col("o_orderstatus") == "F", F.col("o_totalprice") > 1000), 9).alias("share"))


SIGNALS_SQL = """SELECT s_suppkey, least(greatest(s_acctbal / 9000.0, 0.0), 1.0) AS score, 2.0 AS weight FROM supplier
UNION ALL SELECT l_suppkey, least(greatest((avg(l_quantity) - 20.0) / 10.0, 0.0), 1.0), 1.0 FROM lineitem GROUP BY l_suppkey"""


def supplier_signals(t):
    balance = t.supplier.select("s_suppkey", S.ramp("s_acctbal", 0.0, 9000.0).alias("score"), F.lit(2.0).alias("weight"))
    lots = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.avg("l_quantity").alias("q")).select("s_suppkey", S.ramp("q", 20.0, 30.0).alias("score"), F.lit(1.0).alias("weight"))
    return balance.unionByName(lots)


@demo(f"WITH s AS ({SIGNALS_SQL}), g AS (SELECT s_suppkey, sum(score * weight) / sum(weight) AS x FROM s GROUP BY 1) SELECT s_suppkey, round(x, 6) AS total, CASE WHEN x < 0.3 THEN '2d' WHEN x < 0.55 THEN 'mixed' ELSE '3d' END AS verdict FROM g")
def job1_profile(t):
    return A.weighted_score(supplier_signals(t), "s_suppkey", "score", "weight").withColumn("total", F.round("total", 6))


@demo("""SELECT s_suppkey, (s_suppkey % 10) / 10.0 AS total, CASE WHEN s_suppkey % 10 >= 6 THEN '3d' WHEN s_suppkey % 10 <= 3 THEN '2d' ELSE 'mixed' END AS verdict, 'balance,key' AS signals FROM supplier""")
def agg5_kept_signals(t):
    rows = t.supplier.select("s_suppkey", F.explode(F.array(F.struct(F.lit("key").alias("signal"), (F.col("s_suppkey") % 10 / 10).alias("score"), F.lit(1.0).alias("weight")), F.struct(F.lit("balance").alias("signal"), S.ramp("s_acctbal", 0.0, 9000.0).alias("score"), F.lit(0.0).alias("weight")))).alias("s"))
    got = A.weighted_score(rows.select("s_suppkey", "s.*"), "s_suppkey", "score", "weight", signal="signal")
    return got.withColumn("signals", F.array_join(F.transform("signals", lambda s: s["signal"]), ","))


@demo("""WITH m AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) SELECT a.c_nationkey, a.n, median(b.n) AS peer, round(a.n / median(b.n), 9) AS ratio FROM m a JOIN m b ON a.c_nationkey <> b.c_nationkey GROUP BY 1, 2""")
def agg6_peer_median(t):
    counts = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    return A.peer_median(counts, "c_nationkey", "n").withColumn("ratio", F.round("ratio", 9))


@demo("""WITH v AS (SELECT l_suppkey, l_returnflag, count(*) AS n, sum(l_quantity) AS w FROM lineitem GROUP BY ALL)
SELECT l_suppkey, l_returnflag, round(share, 9) AS share FROM (SELECT *, n / sum(n) OVER (PARTITION BY l_suppkey) AS share, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, w DESC, l_returnflag) AS r FROM v) WHERE r = 1""")
def agg7_majority(t):
    return A.majority(t.lineitem, "l_suppkey", "l_returnflag", "l_quantity").withColumn("share", F.round("share", 9))


@demo("SELECT l_orderkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1 AND count(*) > 1")
def agg8_unanimous(t):
    return A.unanimous(t.lineitem, "l_orderkey", "l_returnflag")


EVIDENCE_SQL = """SELECT d.doc_id, 'label' AS source, 1 AS strength, CASE WHEN l.quality = 1 THEN 'good' ELSE 'poor' END AS value FROM documents d JOIN labels l ON d.doc_id = l.doc_id
UNION ALL SELECT doc_id, 'lang', 2, lang FROM documents WHERE lang <> 'en' UNION ALL SELECT doc_id, 'keyword', 3, 'short' FROM documents WHERE n_chars < 200"""


def evidence(t):
    docs = t.documents.select("doc_id", "lang", "n_chars")
    label = docs.join(t.labels, "doc_id").select("doc_id", F.lit(1).alias("strength"), F.when(F.col("quality") == 1, "good").otherwise("poor").alias("value"))
    lang = docs.filter("lang <> 'en'").select("doc_id", F.lit(2).alias("strength"), F.col("lang").alias("value"))
    return label.unionByName(lang).unionByName(docs.filter("n_chars < 200").select("doc_id", F.lit(3).alias("strength"), F.lit("short").alias("value")))


@demo(f"WITH e AS ({EVIDENCE_SQL}) SELECT doc_id, min_by(value, strength) AS value FROM e GROUP BY 1")
def agg9_first_wins(t):
    return A.first_wins(evidence(t), "doc_id", "value", "strength")


@demo(f"WITH e AS ({EVIDENCE_SQL}), b AS (SELECT doc_id, min_by(value, strength) AS value, min(strength) AS strength FROM e GROUP BY 1) SELECT d.doc_id, b.value, b.strength FROM documents d LEFT JOIN b ON d.doc_id = b.doc_id")
def job2_label_by_evidence(t):
    best = evidence(t).groupBy("doc_id").agg(F.min_by("value", "strength").alias("value"), F.min("strength").alias("strength"))
    return t.documents.select("doc_id").join(best, "doc_id", "left")


@demo("""SELECT 'p_brand' AS facet, p_brand AS value, count(*) FILTER (p_type = 'PROMO') AS n FROM part GROUP BY 2 HAVING n > 0 OR value = 'Brand#11'
UNION ALL SELECT 'p_type', p_type, count(*) FILTER (p_brand = 'Brand#11') AS n FROM part GROUP BY 2 HAVING n > 0 OR p_type = 'PROMO'
UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), count(*) FILTER (p_brand = 'Brand#11' AND p_type = 'PROMO') AS n FROM part GROUP BY 2 HAVING n > 0""")
def agg10_facet_counts(t):
    return A.facet_counts(t.part, ["p_brand", "p_type", "p_size"], {"p_brand": "Brand#11", "p_type": "PROMO"})


@demo("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY r) AS "values" FROM r WHERE r <= 3 GROUP BY 1""")
def agg11_capped_list(t):
    return A.capped_list(t.orders, "o_custkey", "o_orderkey", [F.desc("o_totalprice"), "o_orderkey"], 3)


@demo("""SELECT l_orderkey, concat_ws('+', CASE WHEN bool_or(l_returnflag = 'R') THEN 'R' END, CASE WHEN bool_or(l_returnflag = 'A') THEN 'A' END, CASE WHEN bool_or(l_returnflag = 'N') THEN 'N' END) AS roles FROM lineitem GROUP BY 1""")
def agg12_role_set(t):
    return A.role_set(t.lineitem, "l_orderkey", "l_returnflag", ["R", "A", "N"])


@demo("SELECT c_nationkey, regexp_replace(c_name, '[0-9]+', '#', 'g') AS pattern, count(*) AS n, min(c_name) AS example FROM customer WHERE regexp_matches(c_name, '[0-9]') GROUP BY 1, 2 HAVING count(*) >= 12")
def agg13_numbered_corpora(t):
    return A.numbered_corpora(t.customer, "c_nationkey", "c_name", 12)


@demo("SELECT k AS key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) GROUP BY 1")
def agg14_key_frequency(t):
    return A.key_frequency(t.events, F.from_json("props", "map<string,string>"))


@demo("SELECT item, count(*) AS n FROM (SELECT regexp_replace(trim(unnest(string_split(p_name, ' '))), '[0-9]+$', '') AS item FROM part) WHERE item <> '' GROUP BY 1 HAVING count(*) >= 2")
def agg15_list_items(t):
    return A.list_item_frequency(t.part, "p_name", " ")


@demo("""WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS r, (SELECT greatest(20, count(*) // 20) FROM orders) AS s FROM orders)
SELECT CAST(r // s AS BIGINT) AS block, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM r GROUP BY 1""")
def agg16_progress_curve(t):
    return A.progress_curve(t.orders, ["o_orderdate", "o_orderkey"], "o_totalprice").withColumn("mean", F.round("mean", 4))


@demo("""SELECT part_group, count(DISTINCT p_type) AS kinds, count(*) AS members FROM (SELECT concat(p_brand, '/', CAST(p_size // 10 AS VARCHAR)) AS part_group, p_type, p_size, 50 AS whole FROM part) GROUP BY 1
HAVING count(DISTINCT p_type) >= 2 AND count(*) <= 3 * count(DISTINCT p_type) AND max(p_size - whole) <= 0 AND min(p_size - whole) < 0""")
def agg17_decomposition_of_all_parts(t):
    parts = t.part.withColumn("part_group", F.concat("p_brand", F.lit("/"), F.expr("p_size div 10").cast("string"))).withColumn("whole", F.lit(50))
    return A.decomposition_filter(parts, "part_group", "p_type", "p_size", "whole")


@demo("""WITH n AS (SELECT DISTINCT p_brand, p_type, p_name FROM part), w AS (SELECT DISTINCT p_brand, p_type, string_split(p_name, ' ') AS w FROM n), c AS (SELECT p_brand, count(*) AS total FROM (SELECT DISTINCT p_brand, w FROM w) GROUP BY 1),
d AS (SELECT DISTINCT p_brand, w FROM w), p AS (SELECT p_brand, k, array_to_string(w[1:k], ' ') AS prefix FROM d, range(1, 3) r(k) WHERE k <= len(w)), g AS (SELECT p_brand, k, prefix, count(*) AS n FROM p GROUP BY ALL)
SELECT g.p_brand, max_by(prefix, struct_pack(k := k, n := n, p := prefix)) AS prefix FROM g JOIN c ON g.p_brand = c.p_brand WHERE n >= 2 AND n >= 0.1 * total GROUP BY 1""")
def agg18_quorum_prefix(t):
    return A.quorum_prefix(t.part, "p_brand", F.split("p_name", " "), 0.1)


@demo("SELECT p_brand, stem, count(*) AS n, count(DISTINCT p_size) AS positions FROM (SELECT p_brand, p_size, split_part(p_name, ' ', 1) AS stem FROM part) WHERE length(stem) >= 4 GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT p_size) >= 2")
def agg19_piece_sets(t):
    return A.piece_sets(t.part.withColumn("stem", F.split_part("p_name", F.lit(" "), F.lit(1))), ["p_brand", "stem"], "p_size", "stem")


@demo("WITH n AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_partkey, max_by(l_suppkey, struct_pack(n := n, s := -l_suppkey)) AS l_suppkey FROM n GROUP BY 1")
def agg20_majority_page(t):
    return A.majority_page(t.lineitem, "l_partkey", "l_suppkey")


@demo("SELECT user_id, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'error') AS n_error FROM events GROUP BY 1")
def agg21_role_rollup(t):
    return A.role_rollup(t.events, "user_id", "event_type", ["view", "click", "error"])


@demo("""SELECT array_to_string(string_split(regexp_extract(url, '://([^?#]*)', 1), '/')[1:2], '/') AS root, count(*) AS n, CAST(sum(length(html)) AS BIGINT) AS bytes FROM pages GROUP BY 1""")
def agg22_content_roots(t):
    rows = t.pages.select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path"), F.length("html").alias("size"))
    return A.content_roots(rows, "path", "size")


@demo("SELECT l_orderkey, l_linenumber, l_partkey, dense_rank() OVER (ORDER BY l_returnflag, l_linestatus) AS ref FROM lineitem")
def agg23_intern_values(t):
    return A.intern_values(t.lineitem, ["l_returnflag", "l_linestatus"])[1].select("l_orderkey", "l_linenumber", "l_partkey", "ref")


@demo("SELECT count(*) FILTER (l_discount = 0) AS no_discount, count(*) FILTER (l_tax > 0.05) AS taxed, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem")
def agg24_stage_stats(t):
    return A.stage_stats(t.lineitem, {"no_discount": F.col("l_discount") == 0, "taxed": F.col("l_tax") > 0.05, "returned": F.col("l_returnflag") == "R"})


@demo("SELECT l_orderkey, max_by(l_partkey, struct_pack(w := CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END, a := l_quantity * l_extendedprice, p := -l_partkey)) AS l_partkey FROM lineitem GROUP BY 1")
def agg26_largest_member(t):
    return A.largest_member(t.lineitem, "l_orderkey", "l_partkey", F.col("l_quantity") * F.col("l_extendedprice"), F.col("l_returnflag") == "R")
