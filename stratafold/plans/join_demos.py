"""Queries of joins over the supplied tables."""

from pyspark.sql import functions as F

from stratafold.operators import joins as J
from stratafold.operators import scalar as S
from stratafold.plans.registry import both, demo

NAMES, NAMES_SQL = both("""SELECT name, CAST(row_number() OVER (ORDER BY name) AS BIGINT) AS id, 1000 - 10 * length(name) AS w, 1000 - 10 * length(name) AS h
FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM {part} UNION SELECT DISTINCT p_name FROM {part}
      UNION SELECT DISTINCT concat(p_name, ' ', replace(p_brand, '#', ' ')) FROM {part}) u""")
VOCABULARY, VOCABULARY_SQL = both("""SELECT DISTINCT replace(k, ' ', '') AS key, k AS display
FROM (SELECT p_name AS k FROM {part} GROUP BY p_name HAVING count(*) >= 30 UNION SELECT split_part(p_name, ' ', 2) FROM {part}) u""")
BOXES, BOXES_SQL = both("""SELECT l_orderkey AS grp, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS box,
 l_quantity AS x0, l_discount * 400 AS y0, l_quantity + 8 AS x1, l_discount * 400 + 8 AS y1 FROM {lineitem}""")
NEEDS, NEEDS_SQL = both("SELECT DISTINCT l_orderkey AS entry, l_partkey AS needs, CASE WHEN l_partkey % 50 = 0 THEN 0 ELSE 1 END AS shipped FROM {lineitem}")


@demo("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def jon1_inner_join(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "c_mktsegment")


@demo("SELECT d.doc_id, coalesce(quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def jon2_left_enrich(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@demo("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jon3_orphans(t):
    return J.orphans(t.documents.select("doc_id"), t.labels, ["doc_id"])


@demo("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def jon4_live_rows(t):
    return J.live_rows(t.documents.select("doc_id"), t.labels, ["doc_id"])


@demo("""WITH s AS (SELECT p_type AS stem, row_number() OVER (ORDER BY p_type) AS k FROM (SELECT DISTINCT split_part(p_name, ' ', 2) AS p_type FROM part WHERE p_size <= 10))
SELECT p_partkey, min_by(stem, k) AS stem FROM part JOIN s ON list_contains(string_split(p_name, ' '), stem) GROUP BY p_partkey""")
def jon5_contains_join(t):
    stems = t.sql("SELECT stem, row_number() OVER (ORDER BY stem) AS k FROM (SELECT DISTINCT split_part(p_name, ' ', 2) AS stem FROM {part} WHERE p_size <= 10)")
    return J.contains_join(t.part, "p_partkey", "p_name", stems, "stem", "k")


@demo(f"""WITH v AS ({VOCABULARY_SQL}) SELECT p_partkey, coalesce(v2.display, v1.display, w2.display) AS display FROM part
LEFT JOIN v v2 ON v2.key = replace(p_name, ' ', '') LEFT JOIN v v1 ON v1.key = split_part(p_name, ' ', 1) LEFT JOIN v w2 ON w2.key = split_part(p_name, ' ', 2)
WHERE coalesce(v2.display, v1.display, w2.display) IS NOT NULL""")
def jon6_longest_ngram(t):
    return J.longest_ngram_match(t.part, "p_partkey", "p_name", t.sql(VOCABULARY), "key", "display")


@demo(f"""WITH n AS ({NAMES_SQL}), w AS (SELECT id, name, list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM n)
SELECT a.id, max_by(b.id, len(b.w)) AS parent FROM w a JOIN w b ON len(b.w) < len(a.w) AND a.w[1:len(b.w)] = b.w AND length(array_to_string(b.w, '')) >= 3 GROUP BY a.id""")
def jon7_longest_prefix_parent(t):
    return J.longest_prefix_parent(t.sql(NAMES), "id", "name")


@demo("""WITH p AS (SELECT regexp_extract(url, '://([^?#]*)', 1) AS p FROM pages), s AS (SELECT DISTINCT regexp_extract(p, '[^/]+/[0-9]+$') AS s FROM p WHERE regexp_matches(p, '[^/]+/[0-9]+$'))
SELECT CASE WHEN p = s THEN '' ELSE left(p, length(p) - length(s) - 1) END AS prefix, count(*) AS n FROM p JOIN s ON p = s OR suffix(p, '/' || s) GROUP BY 1""")
def jon8_suffix_join(t):
    paths = t.pages.select(F.regexp_extract("url", "://([^?#]*)", 1).alias("p"))
    suffixes = paths.filter(F.col("p").rlike("[^/]+/[0-9]+$")).select(F.regexp_extract("p", "[^/]+/[0-9]+$", 0).alias("s"))
    return J.suffix_join(paths, "p", suffixes, "s")


HASHES_SQL = "SELECT vec_id, label, " + " + ".join(f"CASE WHEN embedding[{k}] > embedding[{k + 1}] THEN {1 << (16 - k)} ELSE 0 END" for k in range(1, 17)) + " AS h FROM embeddings"


@demo(f"WITH h AS ({HASHES_SQL}) SELECT a.vec_id AS id_a, b.vec_id AS id_b, CAST(bit_count(xor(a.h, b.h)) AS BIGINT) AS distance FROM h a JOIN h b ON a.label = b.label AND a.vec_id < b.vec_id AND bit_count(xor(a.h, b.h)) <= 2")
def jon10_hamming_join(t):
    return J.hamming_join(t.embeddings.select("vec_id", "label", S.difference_bits("embedding", 16).alias("h")), "vec_id", "h", "label", 2, 16)


@demo(f"WITH b AS ({BOXES_SQL}) SELECT p.grp, p.box AS a, q.box AS b FROM b p JOIN b q ON p.grp = q.grp AND p.box < q.box AND p.x0 - 1 <= q.x1 AND q.x0 - 1 <= p.x1 AND p.y0 - 1 <= q.y1 AND q.y0 - 1 <= p.y1")
def jon11_box_overlap(t):
    return J.box_overlap_join(t.sql(BOXES), "grp", "box", 1.0)


ASOF_SQL = """SELECT w.entity, w.t, round(CASE WHEN l.t IS NULL THEN h.v WHEN h.t IS NULL OR h.t = l.t THEN l.v ELSE l.v + (h.v - l.v) * (w.t - l.t) / (h.t - l.t) END, 9) AS v
FROM w ASOF LEFT JOIN k l ON w.entity = l.entity AND w.t >= l.t ASOF LEFT JOIN k h ON w.entity = h.entity AND w.t <= h.t"""


@demo(f"WITH k AS (SELECT user_id AS entity, event_id AS t, value AS v FROM events), w AS (SELECT o_custkey AS entity, o_orderkey AS t FROM orders WHERE o_custkey IN (SELECT user_id FROM events)) {ASOF_SQL}")
def jon12_asof_of_all_orders(t):
    keys = t.events.select(F.col("user_id").alias("entity"), F.col("event_id").alias("t"), F.col("value").alias("v"))
    wanted = t.orders.select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("t")).join(keys.select("entity").distinct(), "entity", "left_semi")
    return J.asof_interpolate(keys, wanted, "entity", "t", "v").withColumn("v", F.round("v", 9))


@demo(f"""WITH a AS (SELECT user_id AS entity, event_id AS t, value AS v FROM events WHERE event_type = 'view'), b AS (SELECT user_id AS entity, event_id AS t, value AS v FROM events WHERE event_type = 'click'),
w AS (SELECT entity, t FROM a UNION SELECT entity, t FROM b), x AS (WITH k AS (SELECT * FROM a) {ASOF_SQL}), y AS (WITH k AS (SELECT * FROM b) {ASOF_SQL})
SELECT x.entity, x.t, x.v AS a, round(y.v + 5, 9) AS b FROM x JOIN y ON x.entity = y.entity AND x.t = y.t""")
def jon13_merge_two_series(t):
    keys = t.events.select(F.col("user_id").alias("entity"), F.col("event_id").alias("t"), F.col("value").alias("v"), "event_type")
    a, b = (keys.filter(F.col("event_type") == k).drop("event_type") for k in ("view", "click"))
    return J.merge_two_series(a, b, "entity", "t", "v", 5.0).select("entity", "t", F.round("a", 9).alias("a"), F.round("b", 9).alias("b"))


@demo(f"WITH p AS ({NEEDS_SQL}) SELECT entry, count(*) AS n_needs, count(*) FILTER (shipped = 0) AS n_missing, count(*) FILTER (shipped = 0) = 0 AS reachable FROM p GROUP BY entry")
def jon14_declared_vs_present(t):
    needs = t.sql(NEEDS)
    return J.declared_vs_present(needs, "entry", "needs", t.part.filter("p_partkey % 50 <> 0").select(F.col("p_partkey").alias("needs")))


@demo("SELECT n_nationkey, k FROM nation JOIN (VALUES ('nation-1', 1), ('NATION 2', 2), ('Nation_17', 3)) v(q, k) ON regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') = regexp_replace(lower(q), '[^a-z0-9]', '', 'g')")
def jon15_name_lookup(t):
    asked = t.spark.createDataFrame([("nation-1", 1), ("NATION 2", 2), ("Nation_17", 3)], "q string, k int")
    return J.name_lookup(t.nation, "n_name", asked, "q").select("n_nationkey", "k")


@demo("""WITH r AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem) SELECT x.o AS a, y.o AS b, count(*) AS shared FROM r x JOIN r y ON x.p = y.p AND x.o < y.o GROUP BY 1, 2 HAVING count(*) >= 2""")
def jon16_sharing_pairs(t):
    return J.sharing_pairs(t.lineitem, "l_orderkey", "l_partkey")
