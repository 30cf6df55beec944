"""Queries of reports over groups of the supplied tables."""

from pyspark.sql import functions as F

from stratafold.operators import gates as K
from stratafold.operators import joins as J
from stratafold.operators import reports as R
from stratafold.operators import scalar as S
from stratafold.plans.job_demos import CHECKS_SQL, nation_checks
from stratafold.plans.join_demos import NEEDS, NEEDS_SQL
from stratafold.plans.registry import demo


@demo("SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_discount <> 0 THEN 'l_discount' END, CASE WHEN l_tax <> 0 THEN 'l_tax' END) AS features FROM lineitem")
def src17_populated_features(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", R.populated_features(["l_discount", "l_tax"]).alias("features"))


@demo("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'art/' || p_name WHEN 1 THEN 'ui/' || p_name ELSE CAST(p_size % 5 AS VARCHAR) || '#' || p_name END AS full_id FROM part")
def src18_expand_prefixed(t):
    code = F.concat((F.col("p_size") % 5).cast("string"), F.lit("#"), F.col("p_name"))
    return t.part.select("p_partkey", R.expand_prefixed(code, ["art/", "ui/"]).alias("full_id"))


@demo("""SELECT * FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, unnest(regexp_extract_all(html, '(?:href|lang)="([^"]*)"', 1)) AS member FROM pages) WHERE member NOT IN ('en', 'None')""")
def src22_harvest_enums(t):
    return R.harvest_members(t.pages, "page_id", "html", "<title>([^<]*)</title>", '(?:href|lang)="([^"]*)"', ["en", "None"])


@demo("SELECT p_partkey, CASE WHEN p_size % 5 <> 3 THEN p_partkey || '_' || replace(lower(p_name), ' ', '_') END AS stem, CASE p_size % 5 WHEN 0 THEN 'tl' WHEN 1 THEN 'b' WHEN 2 THEN 'l' WHEN 4 THEN 't' END AS position FROM part")
def prj16_position_code(t):
    place = F.element_at(F.array(*map(F.lit, (" top left ", " bottom ", " left top ", " ", " top bottom left "))), (F.col("p_size") % 5 + 1).cast("int"))
    name = F.concat(F.col("p_partkey").cast("string"), F.lit(" "), "p_name", place, F.col("p_size").cast("string"))
    stem, position = S.position_code(name, {"top": "t", "left": "l", "bottom": "b", "topleft": "tl"})
    return t.part.select("p_partkey", stem.alias("stem"), position.alias("position"))


@demo("""WITH g AS (SELECT c_nationkey, count(*) AS customers, max(c_acctbal) AS top FROM customer GROUP BY 1),
m AS (SELECT c_nationkey, 'customers' AS metric, CAST(customers AS DOUBLE) AS value FROM g UNION ALL SELECT c_nationkey, 'top', top FROM g),
p AS (SELECT m.*, (SELECT median(o.value) FROM m o WHERE o.metric = m.metric AND o.c_nationkey <> m.c_nationkey) AS peer FROM m)
SELECT c_nationkey, metric, value, round(peer, 6) AS peer, round(value / peer, 9) AS ratio FROM p""")
def gat6_peer_report(t):
    g = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.max("c_acctbal").alias("top"))
    return R.peer_report(g, "c_nationkey", ["customers", "top"]).withColumn("peer", F.round("peer", 6)).withColumn("ratio", F.round("ratio", 9))


@demo(f"""WITH c AS ({CHECKS_SQL}), v AS (SELECT c_nationkey, CASE WHEN bool_or(status = 'fail' AND blocking) THEN 'BLOCKED' WHEN bool_or(status IN ('fail', 'warn')) THEN 'PARTIAL' ELSE 'READY' END AS verdict FROM c GROUP BY 1)
SELECT c.c_nationkey, subject, status, verdict FROM c JOIN v ON c.c_nationkey = v.c_nationkey""")
def gat8_survey(t):
    checks = nation_checks(t)
    return checks.select("c_nationkey", "subject", "status").join(K.verdict(checks, "c_nationkey"), "c_nationkey")


@demo("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_discount, l_tax) AS r FROM lineitem)
SELECT l_suppkey, count(*) AS sampled, count(*) FILTER (l_discount > 0) AS discounted, count(*) FILTER (l_tax > 0) AS taxed FROM r WHERE r <= 60 GROUP BY 1""")
def gat9_sample_quality(t):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax"]
    return R.sample_quality(t.lineitem, "l_suppkey", order, {"discounted": F.col("l_discount") > 0, "taxed": F.col("l_tax") > 0})


@demo("""WITH g AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS members, count(*) FILTER (l_returnflag = 'R') / count(*) AS share FROM lineitem GROUP BY 1),
r AS (SELECT *, CASE WHEN members < 500 THEN 'too few members' WHEN share > 0.34 THEN 'mostly loose' END AS reason FROM g)
SELECT l_suppkey, members, CASE WHEN reason IS NULL THEN 'include' ELSE 'exclude' END AS decision, reason FROM r""")
def gat12_package_decision(t):
    return R.package_decision(t.lineitem, "l_suppkey", "l_partkey", F.col("l_returnflag") == "R", 500, 0.34)


@demo("""WITH g AS (SELECT l_orderkey, count(*) AS parts, max(l_quantity) / sum(l_quantity) AS main, min(l_quantity) / 50 AS fill FROM lineitem GROUP BY 1 HAVING count(*) >= 2)
SELECT l_orderkey, parts, round(main, 9) AS main, parts >= 50 OR main < 0.6 OR fill < 0.2 AS scene FROM g""")
def job7_prefab_objects(t):
    return R.unit_flags(t.lineitem, "l_orderkey", "l_quantity", F.min("l_quantity") / 50).withColumn("main", F.round("main", 9))


@demo("""SELECT o_orderpriority, count(*) AS levels, count(DISTINCT o_custkey) AS owners, min(o_orderdate) AS first, max(o_orderdate) AS last, mode_status AS status FROM orders
JOIN (SELECT o_orderpriority AS p, max_by(s, struct_pack(n := n, s := s)) AS mode_status FROM (SELECT o_orderpriority, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1) ON p = o_orderpriority GROUP BY ALL""")
def job9_corpus_report(t):
    g = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("levels"), F.count_distinct("o_custkey").alias("owners"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    n = t.orders.groupBy("o_orderpriority", F.col("o_orderstatus").alias("s")).agg(F.count("*").alias("n"))
    return g.join(n.groupBy("o_orderpriority").agg(F.max_by("s", F.struct("n", "s")).alias("status")), "o_orderpriority")


@demo("""SELECT l_orderkey, count(*) AS meshes, count(DISTINCT l_suppkey) AS makers, count(*) FILTER (p_size > 25) AS textured, count(*) FILTER (p_size <= 25) AS flat FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def job13_model_table(t):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("meshes"), F.count_distinct("l_suppkey").alias("makers"), F.count_if(F.col("p_size") > 25).alias("textured"), F.count_if(F.col("p_size") <= 25).alias("flat"))


@demo(f"""WITH p AS ({NEEDS_SQL}), e AS (SELECT entry, count(*) AS n_needs, count(*) FILTER (shipped = 0) AS n_missing FROM p GROUP BY 1)
SELECT n_missing = 0 AS reachable, count(*) AS entries, CAST(sum(n_needs) AS BIGINT) AS needs, CAST(sum(n_missing) AS BIGINT) AS missing FROM e GROUP BY 1""")
def job15_reach_report(t):
    present = t.part.filter("p_partkey % 50 <> 0").select(F.col("p_partkey").alias("needs"))
    e = J.declared_vs_present(t.sql(NEEDS), "entry", "needs", present)
    return e.groupBy("reachable").agg(F.count("*").alias("entries"), F.sum("n_needs").alias("needs"), F.sum("n_missing").alias("missing"))


@demo("""WITH p AS (SELECT o_custkey, l_orderkey, count(*) AS cuts, bool_and(l_quantity <= 45) AS fits FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY cuts DESC, l_orderkey) AS r FROM p),
s AS (SELECT *, sum(CASE WHEN r <= 4 AND cuts > 1 THEN 0 ELSE cuts END) OVER (PARTITION BY o_custkey) AS tail FROM r)
SELECT o_custkey, l_orderkey, cuts, fits, CAST(tail AS BIGINT) AS tail FROM s WHERE r <= 4 AND cuts > 1""")
def job17_page_layout_check(t):
    cuts = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return R.page_layout(cuts, "o_custkey", "l_orderkey", F.col("l_quantity") <= 45)
