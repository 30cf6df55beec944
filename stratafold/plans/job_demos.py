"""Queries of set operations, gates and composite jobs over the supplied tables."""

from pyspark.sql import functions as F

from stratafold.operators import catalog as C
from stratafold.operators import gates as K
from stratafold.operators import incremental as I
from stratafold.operators import scalar as S
from stratafold.plans.join_demos import BOXES, BOXES_SQL, HASHES_SQL
from stratafold.plans.registry import both, demo

OLD, OLD_SQL = both("SELECT c_custkey AS row_id, concat('path/', CAST(c_custkey AS STRING)) AS rel_path, concat('g', CAST(c_custkey AS STRING)) AS guid, c_acctbal AS size FROM {customer} WHERE c_custkey % 10 <> 0")
NEW, NEW_SQL = both("""SELECT concat('path/', CAST(c_custkey + CASE WHEN c_custkey % 10 = 2 THEN 100000 ELSE 0 END AS STRING)) AS rel_path, concat('g', CAST(c_custkey AS STRING)) AS guid, c_acctbal + 1 AS size FROM {customer} WHERE c_custkey % 10 <> 1""")


@demo(f"""WITH o AS ({OLD_SQL}), n AS ({NEW_SQL}), p AS (SELECT n.*, o.row_id FROM n LEFT JOIN o ON n.rel_path = o.rel_path),
g AS (SELECT guid, min(row_id) AS row_id FROM o WHERE row_id NOT IN (SELECT row_id FROM p WHERE row_id IS NOT NULL) GROUP BY guid), j AS (SELECT p.rel_path, p.guid, coalesce(p.row_id, g.row_id) AS row_id FROM p LEFT JOIN g ON p.row_id IS NULL AND p.guid = g.guid)
SELECT rel_path, guid, coalesce(row_id, (SELECT max(row_id) FROM o) + row_number() OVER (PARTITION BY row_id IS NULL ORDER BY rel_path)) AS row_id FROM j""")
def set1_upsert(t):
    return I.upsert(t.sql(OLD), t.sql(NEW), "row_id", "rel_path", "guid").select("rel_path", "guid", "row_id")


@demo("SELECT 'lineitem' AS child, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 3)")
def set2_prune(t):
    left = I.prune({"lineitem": t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))}, t.orders.filter("o_orderkey % 10 <> 3"), "o_orderkey")
    return left["lineitem"].agg(F.count("*").alias("n")).select(F.lit("lineitem").alias("child"), "n")


@demo("SELECT 'a' AS build_id, s_suppkey AS k, s_acctbal, NULL AS segment FROM supplier UNION ALL SELECT 'b', c_custkey, c_acctbal, c_mktsegment FROM customer")
def set3_union_builds(t):
    a = t.supplier.select(F.col("s_suppkey").alias("k"), "s_acctbal")
    b = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("s_acctbal"), F.col("c_mktsegment").alias("segment"))
    return I.union_builds({"a": a, "b": b})


@demo("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set4_minus(t):
    side = lambda s: t.orders.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return side("F").subtract(side("P"))


@demo("SELECT p_name AS path, count(*) AS n, min(p_partkey) AS kept, count(DISTINCT (p_size, p_type)) > 1 AS conflict FROM part GROUP BY 1")
def set5_same_content(t):
    return I.same_content(t.part.withColumnRenamed("p_name", "path"), "path", ["p_size", "p_type"], "p_partkey")


@demo("""WITH g AS (SELECT c_nationkey, count(*) FILTER (c_acctbal > 8000) AS num, count(*) AS den FROM customer GROUP BY 1)
SELECT *, CASE WHEN den < 40 THEN 'skip' WHEN num / den < 0.2 THEN 'warn' ELSE 'ok' END AS status FROM g""")
def gat4_ratio_gate(t):
    return K.ratio_gate(t.customer, "c_nationkey", F.count_if(F.col("c_acctbal") > 8000), F.count("*"), 0.2, 40)


CHECKS_SQL = """SELECT c_nationkey, 'rich' AS subject, CASE WHEN max(c_acctbal) < 9900 THEN 'warn' ELSE 'ok' END AS status, false AS blocking FROM customer GROUP BY 1
UNION ALL SELECT c_nationkey, 'size', CASE WHEN count(*) < 50 THEN 'fail' ELSE 'ok' END, true FROM customer GROUP BY 1"""


def nation_checks(t):
    g = t.customer.groupBy("c_nationkey").agg(F.max("c_acctbal").alias("top"), F.count("*").alias("n"))
    rich = g.select("c_nationkey", F.lit("rich").alias("subject"), F.when(F.col("top") < 9900, "warn").otherwise("ok").alias("status"), F.lit(False).alias("blocking"))
    return rich.unionByName(g.select("c_nationkey", F.lit("size").alias("subject"), F.when(F.col("n") < 50, "fail").otherwise("ok").alias("status"), F.lit(True).alias("blocking")))


@demo(CHECKS_SQL)
def gat1_checks(t):
    return nation_checks(t)


@demo(f"WITH c AS ({CHECKS_SQL}) SELECT c_nationkey, CASE WHEN bool_or(status = 'fail' AND blocking) THEN 'BLOCKED' WHEN bool_or(status IN ('fail', 'warn')) THEN 'PARTIAL' ELSE 'READY' END AS verdict FROM c GROUP BY 1")
def gat2_verdict(t):
    return K.verdict(nation_checks(t), "c_nationkey")


@demo("""SELECT 'lineitem' AS child, count(*) AS n, count(*) FILTER (l_orderkey % 10 = 3) AS gone FROM lineitem UNION ALL
SELECT 'orders', count(*), count(*) FILTER (o_orderkey % 10 = 3) FROM orders""")
def gat3_orphan_report(t):
    live = t.orders.filter("o_orderkey % 10 <> 3")
    return K.orphan_report({"lineitem": (t.lineitem, "l_orderkey"), "orders": (t.orders, "o_orderkey")}, live, "o_orderkey")


@demo("SELECT source, CASE WHEN bool_or(n_chars > 15000) THEN 'SUPPORTED' WHEN bool_or(n_chars > 10000) THEN 'DETECTED BUT UNSUPPORTED' ELSE 'NOT DETECTED' END AS state FROM documents GROUP BY 1")
def gat7_coverage(t):
    return K.coverage_state(t.documents.select("source", "n_chars"), "source", F.col("n_chars") > 10000, F.col("n_chars") > 15000)


@demo(f"WITH c AS ({CHECKS_SQL}) SELECT c_nationkey, 'browse' AS capability, CASE WHEN NOT bool_and(status <> 'fail') THEN 'unavailable' WHEN NOT bool_and(status = 'ok') THEN 'degraded' ELSE 'available' END AS state FROM c GROUP BY 1")
def gat11_capabilities(t):
    return K.capabilities(nation_checks(t), "c_nationkey", "browse", F.col("status") != "fail", F.col("status") == "ok")


@demo("""SELECT n_regionkey, count(DISTINCT n_nationkey) AS nations, count(c_custkey) AS customers, round(avg(c_acctbal), 4) AS balance FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""")
def gat5_metrics(t):
    rows = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy("n_regionkey").agg(F.countDistinct("n_nationkey").alias("nations"), F.count("c_custkey").alias("customers"), F.round(F.avg("c_acctbal"), 4).alias("balance"))


@demo("SELECT o_orderkey, c_name, n_name, count(l_partkey) AS lines, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3")
def snk3_browse_table(t):
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("l_partkey").alias("lines"), F.sum("l_quantity").alias("quantity"))
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "c_name", "n_name", F.coalesce("lines", F.lit(0)).alias("lines"), "quantity")


@demo("""WITH u AS (SELECT DISTINCT l_partkey AS p, CAST(l_suppkey AS VARCHAR) AS h FROM lineitem), r AS (SELECT p, h, row_number() OVER (PARTITION BY p ORDER BY h) AS r, count(*) OVER (PARTITION BY p) AS used FROM u),
l AS (SELECT p, max(used) AS used, string_agg(h, ',' ORDER BY h) FILTER (r <= 25) AS used_by FROM r GROUP BY 1)
SELECT p_partkey, p_name, p_brand, CASE WHEN p_size % 3 > 0 THEN 'img/' || p_partkey END AS image, coalesce(used, 0) AS used, coalesce(used_by, '') AS used_by, count(*) OVER (PARTITION BY p_name) AS copies,
 count(*) OVER (PARTITION BY p_name) > 1 AS duplicate, CASE WHEN p_size > 10 THEN p_size END AS w FROM part LEFT JOIN l ON p = p_partkey""")
def snk3_browse_records(t):
    assets = t.part.select("p_partkey", "p_name", "p_brand", F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("img/"), F.col("p_partkey").cast("string"))).alias("image"))
    usage = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").cast("string").alias("holder"))
    copies = t.part.select("p_partkey", F.col("p_name").alias("component"))
    rects = t.part.filter("p_size > 10").select("p_partkey", F.col("p_size").alias("w"))
    rows = C.browse_table(assets, "p_partkey", "p_name", "p_brand", "image", usage, "holder", copies, details={"rect": rects})
    return rows.select("p_partkey", "p_name", "p_brand", "image", "used", F.array_join("used_by", ",").alias("used_by"), "copies", "duplicate", F.col("rect.w").alias("w"))


LISTS_SQL = "SELECT l_orderkey, string_agg(l_linenumber || l_returnflag || l_linestatus, ',' ORDER BY l_linenumber, l_returnflag, l_linestatus) AS s FROM lineitem GROUP BY 1"


@demo(f"WITH l AS ({LISTS_SQL}), m AS (SELECT l_orderkey, min(l_orderkey) OVER (PARTITION BY s) AS first FROM l) SELECT l_orderkey, dense_rank() OVER (ORDER BY first) AS set FROM m")
def snk3_interned_sets(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("item"))
    return C.interned_sets(rows, "l_orderkey", "l_linenumber", "item")[0]


@demo("""SELECT o_custkey, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'engine' ELSE 'game' END AS origin, count(*) AS hold_count FROM orders GROUP BY 1""")
def job4_mark_origin(t):
    return t.orders.groupBy("o_custkey").agg(F.when(F.bool_and(F.col("o_orderstatus") == "F"), "engine").otherwise("game").alias("origin"), F.count("*").alias("hold_count"))


DUPLICATES_SQL = f"""WITH RECURSIVE h AS ({HASHES_SQL}),
p AS (SELECT 'v' || CAST(a.vec_id AS VARCHAR) AS a, 'v' || CAST(b.vec_id AS VARCHAR) AS b FROM h a JOIN h b ON a.label = b.label AND a.vec_id < b.vec_id AND bit_count(xor(a.h, b.h)) <= 2
 UNION ALL SELECT 'd' || CAST(m AS VARCHAR), 'd' || CAST(doc_id AS VARCHAR) FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS m FROM documents) WHERE m < doc_id),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), w(node, c) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, w.c FROM w JOIN e ON e.a = w.node), r AS (SELECT node, min(c) AS component FROM w GROUP BY node)
SELECT node, component, 'dup_' || lpad(CAST(dense_rank() OVER (ORDER BY component) AS VARCHAR), 4, '0') AS label FROM r"""


def duplicate_rows(t):
    """Documents by digest of their text, embeddings by a hash of 16 bits beside those of their label."""
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    docs = t.documents.select(key("d", "doc_id").alias("id"), F.sha2("text", 256).alias("digest"), F.lit(None).cast("long").alias("h"), F.lit(None).cast("string").alias("grp"))
    return docs.unionByName(t.embeddings.select(key("v", "vec_id").alias("id"), F.lit(None).cast("string").alias("digest"), S.difference_bits("embedding", 16).alias("h"), F.col("label").cast("string").alias("grp")))


@demo(DUPLICATES_SQL)
def job5_duplicate_groups(t):
    return C.duplicate_groups(C.duplicate_links(duplicate_rows(t), "id", "digest", "h", ["grp"], 2, 16))


FIGURES_SQL = f"""WITH RECURSIVE b AS ({BOXES_SQL}), k AS (SELECT CAST(grp AS VARCHAR) || '/' || CAST(box AS VARCHAR) AS k, *,
 0.02 * greatest(max(x1) OVER (PARTITION BY grp) - min(x0) OVER (PARTITION BY grp), max(y1) OVER (PARTITION BY grp) - min(y0) OVER (PARTITION BY grp)) AS gap FROM b),
e AS (SELECT p.k AS a, q.k AS b FROM k p JOIN k q ON p.grp = q.grp AND p.box <> q.box AND p.x0 - p.gap <= q.x1 AND q.x0 - p.gap <= p.x1 AND p.y0 - p.gap <= q.y1 AND q.y0 - p.gap <= p.y1),
w(node, c) AS (SELECT k, k FROM k UNION SELECT e.b, w.c FROM w JOIN e ON e.a = w.node), r AS (SELECT node, min(c) AS c FROM w GROUP BY node), s AS (SELECT split_part(node, '/', 1) AS grp, c, count(*) AS n FROM r GROUP BY 1, 2)
SELECT CAST(grp AS BIGINT) AS grp, CAST(count(*) FILTER (n >= greatest(2, 0.25 * t)) AS BIGINT) AS figures, round(max(n) / max(t), 9) AS main FROM (SELECT *, sum(n) OVER (PARTITION BY grp) AS t FROM s) GROUP BY 1"""


@demo(FIGURES_SQL)
def job8_figure_stats(t):
    return C.figure_stats(t.sql(BOXES), "grp", "box").withColumn("main", F.round("main", 9)).drop("clusters")


@demo("""SELECT coalesce(p_brand, 'unlabelled') AS family, count(*) AS n, count(DISTINCT p_name) AS objects, max(p_size) AS largest FROM part GROUP BY 1""")
def job10_families(t):
    return t.part.groupBy(F.coalesce("p_brand", F.lit("unlabelled")).alias("family")).agg(F.count("*").alias("n"), F.countDistinct("p_name").alias("objects"), F.max("p_size").alias("largest"))


@demo("""SELECT user_id, count(*) AS frames, max_by(event_type, struct_pack(n := n, t := event_type)) AS track, sum(n) AS total FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def job12_animation_summary(t):
    n = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.count("*").alias("frames"), F.max_by("event_type", F.struct("n", "event_type")).alias("track"), F.sum("n").alias("total"))
