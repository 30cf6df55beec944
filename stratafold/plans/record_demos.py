"""Queries of packages, schemas, geometry, groups, sinks and streams over the supplied tables."""

import uuid

from pyspark.sql import functions as F

from stratafold.operators import geometry as E
from stratafold.operators import graph as G
from stratafold.operators import incremental as I
from stratafold.operators import objects as O
from stratafold.operators import windows as W
from stratafold.operators.storage import shared_folder
from stratafold.plans.join_demos import NAMES, NAMES_SQL
from stratafold.plans.graph_demos import with_speaker
from stratafold.plans.registry import both, demo
from stratafold.sources import packages as P
from stratafold.sources import records as R
from stratafold.sources import sinks as K
from stratafold.streaming import inventory as T


@demo("""SELECT doc_id, CASE WHEN starts_with(text, 'The ') THEN 'the' WHEN source LIKE '%1' THEN 'first' WHEN regexp_matches(text[:192], '^\\s*[\\[{]') THEN 'json' ELSE 'unknown' END AS role FROM documents""")
def src5_sniff_role(t):
    rows = t.documents.select("doc_id", "source", F.col("text").cast("binary").alias("content"))
    return P.sniff_role(rows, "source", "content", [("the", b"The ", None, 0.9), ("first", None, "1$", 0.6)]).select("doc_id", "role")


@demo("""SELECT p_name, p_partkey, p_size, copies, conflict FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_size > 25, p_partkey) AS r, count(*) OVER (PARTITION BY p_name) AS copies,
min(p_size) OVER (PARTITION BY p_name) < max(p_size) OVER (PARTITION BY p_name) AS conflict FROM part) WHERE r = 1""")
def src8_resolve_packages(t):
    rows = t.part.select("p_name", "p_size", "p_partkey", F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("path"))
    return P.resolve_packages(rows, "p_name", "path", F.col("p_size") > 25, "p_size").select("p_name", "p_partkey", "p_size", "copies", "conflict")


@demo("""WITH r AS (SELECT 'text' AS schema, avg(CASE WHEN p_size IS NOT NULL AND p_retailprice IS NOT NULL AND p_brand IS NOT NULL THEN 1.0 END) AS score, 3 AS fields FROM part
UNION ALL SELECT 'number', avg((2 + CASE WHEN try_cast(p_brand AS BIGINT) IS NULL THEN 0 ELSE 1 END) / 3), 3 FROM part UNION ALL SELECT 'narrow', avg(CASE WHEN p_brand IS NULL THEN 1.0 ELSE 0.0 END), 2 FROM part)
SELECT schema, round(score, 9) AS score, CAST(fields AS BIGINT) AS fields, row_number() OVER (ORDER BY score DESC, fields, schema) = 1 AND score >= 0.9 AS chosen FROM r""")
def src16_fit_schema(t):
    fields = {"size": "p_size", "price": "p_retailprice", "brand": "p_brand"}
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(c).cast("string").alias("value")) for k, c in fields.items()]))
    samples = t.part.select(F.col("p_partkey").alias("sample"), values.alias("s")).select("sample", "s.*")
    kinds = {"text": {"size": "long", "price": "double", "brand": "string"}, "number": {"size": "long", "price": "double", "brand": "long"}, "narrow": {"size": "long", "price": "double"}}
    rows = R.fit_schema(samples, t.spark.createDataFrame([(s, f, k) for s, c in kinds.items() for f, k in c.items()], "schema string, field string, kind string"))
    return rows.withColumn("score", F.round("score", 9))


@demo("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 1 THEN l_tax * 100 ELSE l_quantity END AS foot_w, CASE WHEN l_linenumber % 2 = 1 THEN l_quantity ELSE l_tax * 100 END AS foot_h,
l_quantity > 0 AND l_tax * 100 > 0 AND l_discount * 100 + l_quantity <= 50 AND l_tax * 100 <= 50 AS inside FROM lineitem""")
def prj13_placing(t):
    w, h = F.col("l_quantity"), F.col("l_tax") * 100
    foot_w, foot_h = E.footprint(w, h, F.col("l_linenumber") % 2 * 90)
    inside = E.on_page(F.col("l_discount") * 100, F.lit(0), w, h, F.lit(50), F.lit(50))
    return t.lineitem.select("l_orderkey", "l_linenumber", foot_w.alias("foot_w"), foot_h.alias("foot_h"), inside.alias("inside"))


@demo("""SELECT l_orderkey, l_linenumber, round((0.5 * l_quantity - l_linenumber) / (l_quantity - l_linenumber), 9) AS share, round(1 - (0.5 * l_quantity - l_linenumber) / (l_quantity - l_linenumber), 9) AS flipped,
CASE WHEN abs(l_quantity / (l_quantity - l_linenumber) - 2) <= 0.01 * greatest(l_quantity / (l_quantity - l_linenumber), 2) THEN round(l_quantity / (l_quantity - l_linenumber), 9) END AS scale
FROM (SELECT l_orderkey, l_linenumber, l_quantity + 8 AS l_quantity FROM lineitem)""")
def prj13_anchors(t):
    full, off = F.col("l_quantity").cast("double") + 8, F.col("l_linenumber").cast("double")
    share, flipped = (E.anchor(F.lit(0.5), full, off, full - off, flip) for flip in (False, True))
    scale = E.fit_scale(full - off, F.lit(1.0), full, F.lit(2.0))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(share, 9).alias("share"), F.round(flipped, 9).alias("flipped"), F.round(scale, 9).alias("scale"))


@demo("""SELECT p_partkey, p_size * least(100 / p_size, 40 / (p_size + 10)) AS w, (p_size + 10) * least(100 / p_size, 40 / (p_size + 10)) AS h, CAST(p_size + 45 AS DOUBLE) AS start, CAST(110 AS DOUBLE) AS length FROM part""")
def prj19_layout(t):
    size = F.col("p_size").cast("double")
    w, h = E.placed_size(size, size + 10, F.lit(100), F.lit(40))
    start, length = E.child_span(F.lit(200), F.lit(0.25), F.lit(0.75), F.lit(10), F.col("p_size"), F.lit(0.5))
    return t.part.select("p_partkey", w.alias("w"), h.alias("h"), start.alias("start"), length.alias("length"))


@demo("""WITH f AS (SELECT p_partkey AS file, p_name AS base, p_brand AS dir, p_size AS w, p_size + p_partkey % 3 AS h FROM part), d AS (SELECT p_partkey AS want, p_name AS base, p_brand AS dir, p_size * 2 AS w, p_size * 2 AS h FROM part),
c AS (SELECT want, file, d.w = f.w AND d.h = f.h AS exact, d.dir = f.dir AS beside FROM d JOIN f USING (base) WHERE (d.w = f.w AND d.h = f.h) OR abs(d.w * f.h - d.h * f.w) <= 0.01 * d.w * f.h)
SELECT want, file, exact, beside FROM (SELECT *, row_number() OVER (PARTITION BY want ORDER BY exact DESC, beside DESC, file) AS r FROM c) WHERE r = 1""")
def jon9_resolve_candidate(t):
    files = t.part.select(F.col("p_partkey").alias("file"), F.col("p_name").alias("base"), F.col("p_brand").alias("dir"), F.col("p_size").alias("w"), (F.col("p_size") + F.col("p_partkey") % 3).alias("h"))
    double = (F.col("p_size") * 2).alias
    wanted = t.part.select(F.col("p_partkey").alias("want"), F.col("p_name").alias("base"), F.col("p_brand").alias("dir"), double("w"), double("h"))
    return O.resolve_candidate(wanted, "want", files, "file")


@demo("SELECT o_orderkey, o_custkey, 'cust_' || lpad(CAST(k AS VARCHAR), CAST(greatest(4, length(CAST(k AS VARCHAR))) AS INTEGER), '0') AS label FROM (SELECT *, dense_rank() OVER (ORDER BY o_custkey) AS k FROM orders)")
def win7_dense_labels(t):
    return W.dense_labels(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", "cust_")


@demo("""WITH c AS (SELECT 'C' || c_custkey AS node, 'N' || c_nationkey AS parent, 1 AS size, md5(c_mktsegment || '|') AS s FROM customer),
n AS (SELECT 'N' || n_nationkey AS node, 'R' || n_regionkey AS parent, 1 + count(c.node) AS size, md5('nation|' || coalesce(string_agg(c.s, ',' ORDER BY c.s), '')) AS s FROM nation LEFT JOIN c ON c.parent = 'N' || n_nationkey GROUP BY n_nationkey, n_regionkey),
r AS (SELECT 'R' || r_regionkey AS node, 1 + sum(n.size) AS size, md5('region|' || coalesce(string_agg(n.s, ',' ORDER BY n.s), '')) AS s FROM region LEFT JOIN n ON n.parent = 'R' || r_regionkey GROUP BY r_regionkey)
SELECT node, CAST(size AS BIGINT) AS size, min(node) OVER (PARTITION BY s) AS speaker FROM (SELECT node, size, s FROM c UNION ALL SELECT node, size, s FROM n UNION ALL SELECT node, size, s FROM r)""")
def grf7_subtree_signature(t):
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    nodes = t.region.select(key("R", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit("region").alias("item"))
    nodes = nodes.unionByName(t.nation.select(key("N", "n_nationkey").alias("node"), key("R", "n_regionkey").alias("parent"), F.lit("nation").alias("item")))
    nodes = nodes.unionByName(t.customer.select(key("C", "c_custkey").alias("node"), key("N", "c_nationkey").alias("parent"), F.col("c_mktsegment").alias("item")))
    return with_speaker(G.subtree_signature(nodes, "node", "parent", "item"), "node")


FAMILY, FAMILY_SQL = both("""SELECT o_orderkey AS node, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(floor(o_orderkey / 2) AS BIGINT) END AS parent, o_orderpriority LIKE '1%' AS flag FROM {orders}""")


@demo(f"""WITH RECURSIVE f AS ({FAMILY_SQL}), b AS (SELECT a.node, min(s.node) AS side FROM f a JOIN f s ON s.parent = a.parent AND s.node <> a.node AND s.flag GROUP BY 1),
w(node, mask, side) AS (SELECT node, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM f WHERE parent IS NULL
UNION ALL SELECT c.node, CASE WHEN p.flag THEN p.node ELSE w.mask END, coalesce(b.side, w.side) FROM w JOIN f p ON p.node = w.node JOIN f c ON c.parent = w.node LEFT JOIN b ON b.node = w.node)
SELECT node, coalesce(mask, side) AS holder FROM w""")
def grf12_nearest_ancestor(t):
    return O.nearest_ancestor(t.sql(FAMILY), "node", "parent", "flag")


@demo("SELECT c_custkey AS k, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey + 1000000, s_acctbal, NULL FROM supplier")
def set6_schema_evolve(t):
    old = t.supplier.select((F.col("s_suppkey") + 1000000).alias("k"), F.col("s_acctbal").cast("decimal(20,2)").alias("balance"))
    new = t.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return I.schema_evolve(old, new)


@demo("SELECT l_partkey AS clip, l_orderkey AS holder, bound, matched, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY bound DESC, matched DESC, l_orderkey) AS r FROM (SELECT l_partkey, l_orderkey, bool_or(l_returnflag = 'R') AS bound, max(l_quantity) AS matched FROM lineitem GROUP BY 1, 2)) WHERE r <= 8")
def job11_bind_clips(t):
    rows = t.lineitem.select(F.col("l_partkey").alias("clip"), F.col("l_orderkey").alias("holder"), (F.col("l_returnflag") == "R").alias("bound"), F.col("l_quantity").alias("matched"))
    return O.bind_clips(rows, "clip", "holder")


@demo("""WITH i AS (SELECT user_id, event_type, bool_and(value >= 2) AS lit, bool_or(event_id % 3 = 0) AS flag FROM events GROUP BY 1, 2),
u AS (SELECT user_id AS unit, count(*) AS items, count(*) FILTER (lit AND flag) AS shown, count(*) FILTER (lit) AS could FROM i GROUP BY 1) SELECT *, shown < 0.4 * could AS woken FROM u""")
def job16_visibility(t):
    rows = t.events.select(F.col("user_id").alias("unit"), F.col("event_type").alias("item"), (F.col("value") / 4).alias("toggle"), (F.col("event_id") % 3 == 0).alias("flag"))
    return O.visibility(rows, "unit", "item", "toggle", "flag")


@demo(f"""WITH n AS ({NAMES_SQL}), w AS (SELECT id, w * h AS area, list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM n),
p AS (SELECT id, area, (SELECT max_by(o.id, len(o.w)) FROM w o WHERE len(o.w) < len(w.w) AND list_slice(w.w, 1, len(o.w)) = o.w AND len(array_to_string(o.w, '')) >= 3) AS parent FROM w),
r AS (SELECT c.id, c.area, coalesce(g.parent, f.parent, c.parent, c.id) AS root FROM p c LEFT JOIN p f ON f.id = c.parent LEFT JOIN p g ON g.id = f.parent)
SELECT root AS object, count(*) AS members, max_by(id, struct_pack(a := area, i := -id)) AS largest, count(*) = 1 AS alone FROM r GROUP BY 1""")
def job6_group_objects(t):
    return O.group_objects(t.sql(NAMES), "id", "name", F.col("w") * F.col("h"))


@demo("""WITH k AS (SELECT token, count(DISTINCT p_partkey) AS n FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM part) GROUP BY 1 HAVING count(DISTINCT p_partkey) >= 6),
d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(html), '[a-z]+')) AS token FROM pages) SELECT token, n, token IN (SELECT token FROM d) AS confirmed FROM k""")
def job3_vocabulary(t):
    words = t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("token"))
    evidence = t.pages.select(F.explode(F.regexp_extract_all(F.lower("html"), F.lit("[a-z]+"), 0)).alias("token"))
    return O.vocabulary(words, "p_partkey", "token", evidence, 6)


@demo("SELECT n_regionkey AS build_id, n_nationkey, n_name FROM nation")
def snk1_write_catalogue(t):
    folder = f"{shared_folder(t.spark)}/catalogue-{uuid.uuid4().hex}"
    K.write_catalogue({"nation": t.nation.withColumnRenamed("n_regionkey", "build_id")}, folder)
    return t.spark.read.parquet(f"{folder}/nation").select("build_id", "n_nationkey", "n_name")


@demo("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def snk2_write_report(t):
    folder = f"{shared_folder(t.spark)}/report-{uuid.uuid4().hex}"
    K.write_report(t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")), folder)
    return t.spark.read.schema("status string, n long").json(folder)


def _digest_sql(table):
    sums = " || ',' || ".join(f"CAST(sum(CAST('0x' || substr(d, {8 * k + 1}, 8) AS BIGINT)) AS VARCHAR)" for k in range(8))
    return f"SELECT '{table}' AS input, count(*) AS n, sha256(count(*) || ',' || {sums}) AS digest, min(d) AS low, max(d) AS high, 'v1' AS code FROM (SELECT sha256(text) AS d FROM {table})"


@demo(f"{_digest_sql('documents')} UNION ALL {_digest_sql('benchmark')}")
def gat10_provenance(t):
    return K.provenance({"documents": (t.documents, "text"), "benchmark": (t.benchmark, "text")}, "v1")


@demo("""WITH f AS (SELECT c_nationkey, 'n' || c_nationkey || '/lvl_' || c_custkey || '.json' AS path, count(*) OVER (PARTITION BY c_nationkey) AS files, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS r FROM customer)
SELECT c_nationkey, path, files FROM f WHERE files >= 12 AND r % greatest(files // 8, 1) = 0 AND r // greatest(files // 8, 1) < 8""")
def src16_corpus_samples(t):
    path = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("/lvl_"), F.col("c_custkey").cast("string"), F.lit(".json"))
    return R.corpus_samples(t.customer.select("c_nationkey", path.alias("path")), "c_nationkey", "path")


@demo("SELECT 'path/' || c_custkey AS rel_path, 'g' || c_custkey AS guid, c_acctbal AS size, row_number() OVER (ORDER BY 'path/' || c_custkey) AS row_id FROM customer")
def str1_stream_inventory(t):
    schema = t.customer.schema
    stream = t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/customer[.]parquet")
    key = F.col("c_custkey").cast("string")
    rows = stream.select(F.concat(F.lit("path/"), key).alias("rel_path"), F.concat(F.lit("g"), key).alias("guid"), F.col("c_acctbal").alias("size"))
    return T.stream_upsert(rows, f"{shared_folder(t.spark)}/inventory-{uuid.uuid4().hex}", "row_id", "rel_path", "guid").select("rel_path", "guid", "size", "row_id")


@demo(r"""WITH l AS (SELECT l_orderkey, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS q, l_partkey % 3 AS p, l_linenumber % 4 <> 3 AS tile,
 CASE l_linenumber % 4 WHEN 0 THEN 'Shelf' WHEN 1 THEN 'Layer' || l_linenumber WHEN 2 THEN 'Paper' ELSE 'spawn' END AS name FROM lineitem),
w AS (SELECT l_orderkey, bool_or(tile AND regexp_matches(name, '^Layer[5-9]$')) AS named, max_by(name, struct_pack(k := 1 + CAST(p <> 0 AS INTEGER), m := -n)) FILTER (tile) AS fullest FROM l GROUP BY 1),
c AS (SELECT l.*, CASE WHEN NOT tile THEN 'group' WHEN name = 'Shelf' THEN 'shelf' WHEN CASE WHEN named THEN regexp_matches(name, '^Layer[5-9]$') ELSE name = fullest END THEN 'board' ELSE 'other' END AS kind FROM l JOIN w USING (l_orderkey)),
v AS (SELECT l_orderkey, kind, n, q AS v FROM c UNION ALL SELECT l_orderkey, kind, n, p FROM c WHERE p <> 0),
g AS (SELECT l_orderkey, count(*) FILTER (kind = 'board') AS item_tiles, count(DISTINCT v) FILTER (kind = 'board') AS distinct_items, count(*) FILTER (kind = 'other') AS obstacle_tiles, count(*) FILTER (kind = 'shelf') AS shelf_tiles FROM v GROUP BY 1)
SELECT l_orderkey, count(*) AS layers, count(*) FILTER (kind = 'board') AS depth_layers, item_tiles, distinct_items, coalesce(string_agg(name, ',' ORDER BY n) FILTER (kind = 'other'), '') AS obstacle_layers, obstacle_tiles, shelf_tiles,
 count(*) FILTER (kind = 'group') AS object_groups, count(*) AS time_limit, l_orderkey % 7 AS move_limit FROM c JOIN g USING (l_orderkey) GROUP BY ALL""")
def src15_tilemaps(t):
    """A map in JSON for each order, written from its lines, with properties of either shape."""
    kind = lambda *names: F.element_at(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in names]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    name = kind("Shelf", F.concat(F.lit("Layer"), F.col("l_linenumber").cast("string")), "Paper", "spawn")
    cells = F.array(F.col("l_quantity").cast("long"), F.lit(0).cast("long"), (F.col("l_partkey") % 3).cast("long"))
    layer = F.struct(F.col("l_linenumber").alias("n"), name.alias("name"), kind("tilelayer", "tilelayer", "tilelayer", "objectgroup").alias("type"), cells.alias("data"))
    maps = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(layer)).alias("layers"))  # an order has a few lines
    time, moves = F.concat(F.size("layers").cast("string"), F.lit(".0")), (F.col("l_orderkey") % 7).cast("string")
    old = F.to_json(F.struct("layers", F.struct(time.alias("Time"), moves.alias("Moves")).alias("properties")))
    new = F.to_json(F.struct("layers", F.array(F.struct(F.lit("time").alias("name"), time.alias("value")), F.struct(F.lit("moves").alias("name"), moves.alias("value"))).alias("properties")))
    rows = maps.select("l_orderkey", F.when(F.col("l_orderkey") % 2 == 0, old).otherwise(new).alias("text"))
    got = R.parse_tilemaps(rows, "l_orderkey", "text", "^Layer[5-9]$", "^Shelf", {"time_limit": ["limit", "time"], "move_limit": ["moves"]})
    return got.drop("width", "height", "shelf_types", "object_layers", "properties").withColumn("obstacle_layers", F.array_join("obstacle_layers", ","))
