"""Queries of catalogue jobs, inherited values and fuller records over the supplied tables."""

from pyspark.sql import functions as F

from stratafold.operators import aggs as A
from stratafold.operators import catalog as C
from stratafold.operators import gates as K
from stratafold.operators import graph as G
from stratafold.operators import incremental as I
from stratafold.operators import joins as J
from stratafold.operators import objects as O
from stratafold.operators import scalar as S
from stratafold.operators import windows as W
from stratafold.operators.storage import cut
from stratafold.plans.graph_demos import EDGES, EDGES_SQL, with_digest
from stratafold.plans.job_demos import DUPLICATES_SQL, FIGURES_SQL, duplicate_rows
from stratafold.plans.join_demos import ASOF_SQL, BOXES, NAMES
from stratafold.plans.registry import demo
from stratafold.sources import files as D
from stratafold.sources import records as R

PATH_SQL = "regexp_extract(url, '://([^?#]*)', 1)"
key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))


def places(t):
    """Regions, nations and customers as one forest."""
    rows = t.region.select(key("R", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("double").alias("k"))
    rows = rows.unionByName(t.nation.select(key("N", "n_nationkey").alias("node"), key("R", "n_regionkey").alias("parent"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("double").alias("k")))
    return rows.unionByName(t.customer.select(key("C", "c_custkey").alias("node"), key("N", "c_nationkey").alias("parent"), F.col("c_name").alias("name"), (F.col("c_custkey") % 100).cast("double").alias("k")))


@demo("""SELECT 'R' || r_regionkey AS node, '' AS path FROM region UNION ALL SELECT 'N' || n_nationkey, n_name FROM nation
UNION ALL SELECT 'C' || c_custkey, n_name || '/' || c_name FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def grf11_path_of(t):
    return G.path_of(places(t), "node", "parent", "name")


INHERIT_SQL = """WITH x AS (SELECT 'R' || r_regionkey AS node, r_regionkey AS a, NULL AS b, NULL AS c FROM region UNION ALL SELECT 'N' || n_nationkey, n_regionkey, n_nationkey, NULL FROM nation
UNION ALL SELECT 'C' || c_custkey, n_regionkey, n_nationkey, c_custkey % 100 FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT node, a % 4 <> 3 AND coalesce(b % 5 <> 4, true) AND coalesce(c % 3 <> 2, true) AS shown,
coalesce(CASE WHEN c % 10 = 0 THEN 'm' || CAST(c AS INTEGER) END, CASE WHEN b % 2 = 0 THEN 'm' || CAST(b AS INTEGER) END, 'm' || CAST(a AS INTEGER)) AS mask,
CAST(CASE WHEN b IS NULL THEN a WHEN c IS NULL THEN 2 * b + a ELSE 4 * c + 2 * b + a END AS DOUBLE) AS x FROM x"""


@demo(INHERIT_SQL)
def grf6_inherited(t):
    kind, k = F.substr("node", F.lit(1), F.lit(1)), F.col("k").cast("long")
    shown = F.when(kind == "R", k % 4 != 3).when(kind == "N", k % 5 != 4).otherwise(k % 3 != 2)
    mask = F.when((kind == "R") | ((kind == "N") & (k % 2 == 0)) | ((kind == "C") & (k % 10 == 0)), F.concat(F.lit("m"), k.cast("string")))
    place = F.array(F.lit(2.0), F.lit(0.0), F.col("k"), F.lit(0.0), F.lit(1.0), F.lit(0.0))
    rows = places(t).select("node", "parent", "name", shown.alias("shown"), mask.alias("mask"), place.alias("m"))
    return G.walk_down(rows, "node", "parent", "name", {"shown": "all", "mask": "nearest", "m": "affine"}).select("node", "shown", "mask", F.col("m")[2].alias("x"))


@demo(f"""WITH RECURSIVE e AS ({EDGES_SQL}), h AS (SELECT 'R' || r_regionkey AS k, 'UI' AS role FROM region UNION ALL SELECT 'N' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '3D' ELSE 'UI' END FROM nation),
w(source, node, hops) AS (SELECT DISTINCT k, k, 0 FROM h UNION ALL SELECT w.source, e.dst, w.hops + 1 FROM w JOIN e ON e.src = w.node WHERE w.hops < 6), d AS (SELECT DISTINCT source, node FROM w WHERE hops > 0)
SELECT node, count(DISTINCT source) AS holders, concat_ws('+', CASE WHEN bool_or(role = 'UI') THEN 'UI' END, CASE WHEN bool_or(role = '3D') THEN '3D' END) AS roles FROM d JOIN h ON h.k = d.source GROUP BY 1""")
def grf2_inherited_roles(t):
    holders = t.region.select(key("R", "r_regionkey").alias("k"), F.lit("UI").alias("role"))
    holders = holders.unionByName(t.nation.select(key("N", "n_nationkey").alias("k"), F.when(F.col("n_nationkey") % 2 == 0, "3D").otherwise("UI").alias("role")))
    return G.inherited_roles(G.bounded_reach(t.sql(EDGES), holders.select("k").distinct(), "k", 6), holders, "k", "role", ["UI", "VFX", "3D"])


@demo("""WITH l AS (SELECT l_orderkey AS o, 'L' || l_orderkey || '.' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS node, l_returnflag || l_linestatus AS item FROM lineitem),
o AS (SELECT o_orderkey AS o, o_custkey AS c, o_orderpriority || '|' || coalesce(string_agg(item, ',' ORDER BY item), '') AS sig, 1 + count(item) AS drawn FROM orders LEFT JOIN l ON l.o = o_orderkey GROUP BY 1, 2, o_orderpriority),
c AS (SELECT c, string_agg(sig, ';' ORDER BY sig) AS sig, sum(drawn) AS drawn FROM o GROUP BY 1),
li AS (SELECT item, count(*) AS n FROM l GROUP BY 1), oi AS (SELECT sig, count(*) AS n FROM o GROUP BY 1), ci AS (SELECT sig, count(*) AS n FROM c GROUP BY 1),
ob AS (SELECT o.*, oi.n AS n, coalesce((SELECT max(li.n) FROM l JOIN li USING (item) WHERE l.o = o.o), 0) > 1 AS below FROM o JOIN oi USING (sig)),
cb AS (SELECT c.c, c.sig, c.drawn, ci.n AS n, (SELECT bool_or(below OR ob.n > 1) FROM ob WHERE ob.c = c.c) AS below FROM c JOIN ci USING (sig)),
cuts AS (SELECT 'C' || sig AS sig, 'C' || c AS node, drawn FROM cb WHERE n > 1 OR (drawn <= 16 AND NOT below)
UNION ALL SELECT 'O' || ob.sig, 'O' || o, ob.drawn FROM ob JOIN cb ON cb.c = ob.c AND NOT (cb.n > 1 OR (cb.drawn <= 16 AND NOT cb.below)) WHERE ob.n > 1 OR (ob.drawn <= 16 AND NOT ob.below)
UNION ALL SELECT 'L' || item, l.node, 1 FROM l JOIN ob ON ob.o = l.o AND NOT (ob.n > 1 OR (ob.drawn <= 16 AND NOT ob.below)) JOIN cb ON cb.c = ob.c AND NOT (cb.n > 1 OR (cb.drawn <= 16 AND NOT cb.below)))
SELECT min_by(node, struct_pack(n := length(node), x := node)) AS name, CAST(max(drawn) AS BIGINT) AS drawn, count(*) AS placements FROM cuts GROUP BY sig""")
def grf8_repeated_subtrees(t):
    lines = t.sql("SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r, concat(l_returnflag, l_linestatus) AS item FROM {lineitem}")
    rows = lines.select(F.concat(F.lit("L"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("r").cast("string")).alias("node"), key("O", "l_orderkey").alias("parent"), "item")
    rows = rows.unionByName(t.orders.select(key("O", "o_orderkey").alias("node"), key("C", "o_custkey").alias("parent"), F.col("o_orderpriority").alias("item")))
    rows = rows.unionByName(t.orders.select(key("C", "o_custkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("item")).distinct())
    return G.repeated_subtrees(rows.withColumn("name", F.col("node")), "node", "parent", "item", "name").select("name", "drawn", "placements")


@demo("""WITH s AS (SELECT l_orderkey, md5(string_agg(l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus)) AS signature FROM lineitem GROUP BY 1),
u AS (SELECT o_custkey, signature, count(*) AS n FROM s JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2) SELECT signature, CAST(sum(n) AS BIGINT) AS placements, count(*) AS files, min(o_custkey) AS first FROM u GROUP BY 1""")
def grf9_merge_units_across(t):
    signed = G.multiset_signature(t.lineitem.withColumn("item", F.concat("l_returnflag", "l_linestatus")), "l_orderkey", "item")
    units = signed.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "signature").agg(F.count("*").alias("placements"), F.min("l_orderkey").alias("speaker"))
    merged = cut(G.merge_units(units, "o_custkey", speaker="speaker").drop("signature"))
    return with_digest(t, merged).select("signature", "placements", "files", "first")


@demo(f"""WITH p AS (SELECT page_id, url, regexp_extract(url, '://([^?#]*)', 1) AS p, html FROM pages), q AS (SELECT *, lower(regexp_extract(p, '[.]([^./]*)$', 1)) AS ext, list_filter(string_split(lower(p), '/')[1:-2], lambda x: x IN ('en', 'fr')) AS f FROM p)
SELECT page_id, coalesce(CASE WHEN ext = 'com' THEN 'Host' END, CASE WHEN ext = 'html' THEN CASE regexp_extract(left(html, 256), '<html lang="(e)n"', 1) WHEN 'e' THEN 'English' ELSE 'Page' END END,
CASE f[1] WHEN 'en' THEN 'EnglishFolder' WHEN 'fr' THEN 'FrenchFolder' END, CASE WHEN ext = 'net' THEN 'Loose' END, 'Other') AS kind FROM q""")
def src4_infer_type_rules(t):
    path, head = F.regexp_extract("url", "://([^?#]*)", 1), F.regexp_replace("html", '<html lang="en"', '<html lang="1"')
    kind = D.infer_type(path, head, {"com": "Host"}, {1: "English"}, {"en": "EnglishFolder", "fr": "FrenchFolder"}, r'<html lang="(\d+)"', "html", "Page", {"net": "Loose"})
    return t.pages.select("page_id", kind.alias("kind"))


@demo("SELECT event_type AS bundle, unnest(json_keys(props)) AS project_path FROM events")
def src14_manifest_containers(t):
    text = F.concat(F.lit('{"m_AssetBundleName": "'), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(""), F.lit('", "m_Container": '), F.col("props"), F.lit("}"))
    return R.manifest_entries(t.events.select(text.alias("text"), "event_type"), "text", "event_type")


@demo("""SELECT page_id, coalesce(nullif(regexp_extract(h, '<title>([^<]*)</title>', 1), ''), 'none') AS title, coalesce(try_cast(nullif(regexp_extract(h, 'content="([0-9]+)"', 1), '') AS INTEGER), -1) AS number FROM
(SELECT page_id, CASE WHEN contains(html, '<head>') THEN split_part(substr(html, strpos(html, '<head>') + 6), '</head>', 1) END AS h FROM pages)""")
def src19_scoped_fields(t):
    rows = t.pages.select("page_id", R.scoped("html", "<head>", "</head>").alias("head"))
    return R.extract_fields(rows, ["page_id"], "head", {"title": ("<title>([^<]*)</title>", "string", "none"), "number": ('content="([0-9]+)"', "int", -1)})


@demo("""WITH b AS (SELECT page_id, unnest(regexp_extract_all(html, '<p>[^<]*')) AS b FROM pages), m AS (SELECT page_id, regexp_extract(b, '<p>([A-Za-z]+)', 1) AS name, unnest(regexp_extract_all(regexp_replace(b, '^<p>[A-Za-z]+', ''), '[a-z]{5,}')) AS member FROM b WHERE regexp_matches(b, '<p>[A-Za-z]+'))
SELECT page_id, CASE WHEN regexp_matches(name, '^[A-M]') THEN 'early' ELSE 'late' END AS bucket, name, member, regexp_replace(member, 's$', '') AS stem FROM m WHERE regexp_matches(name, '^[A-Z]') AND member NOT IN ('there', 'these')""")
def src22_harvest_bodies(t):
    buckets = [("early", "^[A-M]"), ("late", "^[A-Z]")]
    return R.harvest_enums(t.pages, "page_id", "html", "<p>([A-Za-z]+)([^<]*)", "([a-z]{5,})", buckets, ["there", "these"], lambda m: F.regexp_replace(m, "s$", "")).select("page_id", "bucket", "name", "member", "stem")


@demo("""SELECT doc_id, concat_ws(',', CASE WHEN contains(e, 'license') THEN 'legal' END, CASE WHEN contains(e, '@') THEN 'mail' END, CASE WHEN contains(e, chr(10)) THEN 'lines' END) AS markers
FROM (SELECT doc_id, substr(text, 1, 512) || chr(1) || right(text, 512) AS e FROM documents)""")
def src27_content_markers(t):
    return t.documents.select("doc_id", R.content_markers("text", {"legal": "license", "mail": "@", "lines": "\n"}).alias("markers"))


@demo("""SELECT p_partkey, concat_ws(',', CASE WHEN p_name <> '' THEN 'p_name' END, CASE WHEN p_size <> 0 THEN 'p_size' END, CASE WHEN p_partkey % 5 <> 0 THEN 'BoxCount' END, CASE WHEN p_size % 7 <> 0 THEN 'coinCount' END) AS features, CAST(p_partkey % 5 + p_size % 7 AS DOUBLE) AS total FROM part""")
def src17_feature_totals(t):
    rows = t.part.select("p_partkey", "p_name", "p_brand", "p_size", (F.col("p_partkey") % 5).alias("BoxCount"), (F.col("p_size") % 7).alias("coinCount"))
    return R.feature_totals(rows, "p_partkey", ["p_brand"])


@demo("""WITH p AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '://[^/]*/([^?#]*)', 1), '/'), lambda x: x <> '' AND lower(x) NOT IN ('www')) AS p FROM pages)
SELECT page_id, p[-1] AS label, p[-2] AS parent FROM p""")
def prj3_label_and_parent(t):
    label, parent = S.label_and_parent(F.regexp_extract("url", "://[^/]*/([^?#]*)", 1), ["www"])
    return t.pages.select("page_id", label.alias("label"), parent.alias("parent"))


@demo(f"""WITH p AS (SELECT page_id, string_split({PATH_SQL}, '/') AS p FROM pages) SELECT page_id, list_filter(p[1:len(p) - 1], lambda x: x <> '' AND NOT starts_with(x, '_') AND lower(x) NOT IN ('en', 'fr'))[-1] AS label FROM p""")
def prj4_container_label(t):
    return t.pages.select("page_id", S.container_label(F.regexp_extract("url", "://([^?#]*)", 1), ["en", "fr"]).alias("label"))


@demo("""SELECT p_partkey, p_brand AS grp, CASE WHEN p_size % 3 > 0 THEN nullif(p_name, '') END AS label, CASE WHEN p_size % 2 = 0 THEN md5(p_name) END AS hash FROM part""")
def prj15_bundle_parts(t):
    name = F.concat("p_brand", F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("_assets_"), "p_name")).otherwise(""), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("_"), F.md5("p_name"))).otherwise(""), F.lit(".bundle"))
    group, label, digest = S.bundle_parts(name)
    return t.part.select("p_partkey", group.alias("grp"), label.alias("label"), digest.alias("hash"))


@demo("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity - 2.5 * CASE WHEN l_tax > 0.04 THEN -1 ELSE 1 END AS u, l_quantity + 7.5 * CASE WHEN l_tax > 0.04 THEN -1 ELSE 1 END AS v FROM lineitem),
c AS (SELECT *, greatest(least(u, v), 10) AS x0, least(greatest(u, v), 40) AS x1 FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN x0 < x1 THEN x0 END, 6) AS x0, round(CASE WHEN x0 < x1 THEN x1 END, 6) AS x1, CASE WHEN x0 < x1 THEN CAST(0 AS DOUBLE) END AS y0, CASE WHEN x0 < x1 THEN CAST(4 AS DOUBLE) END AS y1 FROM c""")
def prj20_windowed_box(t):
    one, none = F.lit(1.0), F.lit(0.0)
    box = S.affine_box((one, none, F.col("l_quantity").cast("double"), none, one, none), (10.0, 8.0), (0.25, 0.5), (F.col("l_tax") > 0.04, False))
    cut = S.window_box(box, (F.lit(10.0), F.lit(0.0), F.lit(40.0), F.lit(50.0)))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(c, 6).alias(k) for k, c in cut.items()])


@demo("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND NOT (o_totalprice > 200000) AND o_custkey % 2 = 0")
def flt1_browse_toggles(t):
    rows = t.orders.withColumn("dear", F.col("o_totalprice") > 200000).withColumn("even", F.col("o_custkey") % 2 == 0)
    return S.browse_filter(rows, {"o_orderstatus": "F"}, toggles={"dear": False, "even": True}).select("o_orderkey")


def fold_sql(c):
    k = f"regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]', '', 'g'), '[0-9]+$', '')"
    k = f"regexp_replace({k}, '(.)(items|item)$', '\\1')"
    return f"CASE WHEN length({k}) > 4 AND regexp_matches({k}, 's$') AND NOT regexp_matches({k}, '(ss|us|is|as)$') THEN regexp_replace({k}, 's$', '') ELSE {k} END"


@demo(f"""WITH v AS (SELECT {fold_sql("w")} AS key, min(w) AS display FROM (SELECT DISTINCT split_part(p_name, ' ', 2) AS w FROM part) GROUP BY 1), n AS (SELECT p_partkey, split_part(p_name, ' ', 1) || 's' AS a, split_part(p_name, ' ', 2) || 'Items' AS b FROM part)
SELECT p_partkey, coalesce(x.display, y.display) AS display FROM n LEFT JOIN v x ON x.key = {fold_sql("a")} LEFT JOIN v y ON y.key = {fold_sql("split_part(b, 'Items', 1)")} WHERE coalesce(x.display, y.display) IS NOT NULL""")
def jon6_folded_ngram(t):
    fold = lambda c: S.normalise_key(c, ["items", "item"])
    words = t.part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("w")).distinct().groupBy(fold(F.col("w")).alias("key")).agg(F.min("w").alias("display"))
    rows = t.part.select("p_partkey", F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("s "), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("Items")).alias("name"))
    return J.longest_ngram_match(rows, "p_partkey", "name", words, "key", "display", 2, fold)


@demo(f"""WITH k AS (SELECT user_id AS entity, event_id AS t, struct_pack(z := sin(value / 4), w := cos(value / 4)) AS v FROM events),
w AS (SELECT o_custkey AS entity, o_orderkey AS t FROM orders WHERE o_custkey IN (SELECT user_id FROM events)),
n AS (SELECT w.entity, w.t, l.t AS lt, h.t AS ht, l.v AS lv, h.v AS hv FROM w ASOF LEFT JOIN k l ON w.entity = l.entity AND w.t >= l.t ASOF LEFT JOIN k h ON w.entity = h.entity AND w.t <= h.t),
m AS (SELECT *, CASE WHEN ht = lt THEN 0 ELSE (t - lt) / (ht - lt) END AS s, CASE WHEN lv.z * hv.z + lv.w * hv.w < 0 THEN -1 ELSE 1 END AS g FROM n),
q AS (SELECT *, lv.z + (g * hv.z - lv.z) * s AS z, lv.w + (g * hv.w - lv.w) * s AS w FROM m)
SELECT entity, t, round(CASE WHEN lt IS NULL THEN hv.z WHEN ht IS NULL THEN lv.z ELSE z / sqrt(z * z + w * w) END, 6) AS z, round(CASE WHEN lt IS NULL THEN hv.w WHEN ht IS NULL THEN lv.w ELSE w / sqrt(z * z + w * w) END, 6) AS w FROM q""")
def jon12_asof_rotation(t):
    zero = F.lit(0.0)
    keys = t.events.select(F.col("user_id").alias("entity"), F.col("event_id").alias("t"), F.array(zero, zero, F.sin(F.col("value") / 4), F.cos(F.col("value") / 4)).alias("q"))
    wanted = t.orders.select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("t")).join(keys.select("entity").distinct(), "entity", "left_semi")
    return J.asof_rotation(keys, wanted, "entity", "t", "q").select("entity", "t", F.round(F.col("q")[2], 6).alias("z"), F.round(F.col("q")[3], 6).alias("w"))


STATES_SQL = "SELECT l_partkey AS bundle, CASE WHEN l_partkey % 3 <> 0 AND l_partkey IN (SELECT p_partkey FROM part) THEN 'local' WHEN bool_or(l_returnflag = 'R') THEN 'remote' ELSE 'missing' END AS state FROM lineitem GROUP BY 1"


def bundle_states(t):
    declared = t.lineitem.select(F.col("l_partkey").alias("bundle"), "l_returnflag")
    return J.declared_states(declared, "bundle", F.col("l_returnflag") == "R", t.part.filter("p_partkey % 3 <> 0"), "p_partkey")


@demo(STATES_SQL)
def jon14_declared_states(t):
    return bundle_states(t)


@demo("""WITH s AS (SELECT l_partkey AS bundle FROM lineitem WHERE l_partkey % 3 = 0 GROUP BY 1 HAVING max(l_quantity) < 49)
SELECT l_orderkey, count(DISTINCT l_partkey) AS missing FROM lineitem JOIN s ON bundle = l_partkey GROUP BY 1 ORDER BY 1 LIMIT 200""")
def jon14_unreachable_entries(t):
    declared = t.lineitem.select(F.col("l_partkey").alias("bundle"), "l_quantity")
    states = J.declared_states(declared, "bundle", F.col("l_quantity") >= 49, t.part.filter("p_partkey % 3 <> 0"), "p_partkey")
    return J.unreachable_entries(t.lineitem.withColumnRenamed("l_partkey", "bundle"), "l_orderkey", "bundle", states)


@demo(f"""WITH s AS ({STATES_SQL}), n AS (SELECT DISTINCT l_orderkey AS entry, l_partkey AS bundle FROM lineitem), g AS (SELECT entry, bool_or(state = 'missing') AS gone FROM n JOIN s USING (bundle) GROUP BY 1)
SELECT (SELECT count(*) FROM s WHERE state = 'local') AS local, (SELECT count(*) FROM s WHERE state = 'remote') AS remote, (SELECT count(*) FROM s WHERE state = 'missing') AS missing, CAST(0 AS BIGINT) AS unread,
count(*) FILTER (gone) AS unreachable, count(*) AS entries FROM g""")
def job15_reach_states(t):
    return C.reach_report(bundle_states(t), "bundle", t.lineitem.select(F.col("l_orderkey").alias("entry"), F.col("l_partkey").alias("bundle")), "entry")


@demo("""WITH a AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), b AS (SELECT DISTINCT l_suppkey AS c, l_partkey AS p FROM lineitem),
s AS (SELECT o, c, count(*) AS shared FROM a JOIN b USING (p) GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT o, c, shared, round(round(shared / (SELECT count(*) FROM a x WHERE x.o = s.o) * 20) / 20, 6) AS covers, round(round(shared / (SELECT count(*) FROM b y WHERE y.c = s.c) * 20) / 20, 6) AS share FROM s""")
def jon16_clip_candidates(t):
    objects = t.lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"))
    return J.clip_candidates(objects, "o", t.lineitem.select(F.col("l_suppkey").alias("c"), F.col("l_partkey").alias("p")), "c", "p").select("o", "c", "shared", F.round("covers", 6).alias("covers"), F.round("share", 6).alias("share"))


@demo("""SELECT 'file' || (p_partkey // 2) || CASE WHEN p_partkey % 2 = 1 THEN '#r' ELSE '' END AS path, p_partkey FROM part WHERE (p_partkey // 2) % 3 <> 0""")
def set2_prune_regions(t):
    rows = t.part.select(F.concat(F.lit("file"), F.expr("p_partkey div 2").cast("string"), F.when(F.col("p_partkey") % 2 == 1, "#r").otherwise("")).alias("path"), "p_partkey")
    live = rows.filter("(p_partkey div 2) % 3 <> 0").select(F.substring_index("path", "#", 1).alias("path"))
    return I.prune_regions(rows, "path", live)


@demo("SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_partkey % 4 <> 0 THEN l_partkey END AS l_partkey FROM lineitem")
def set2_release_holders(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return I.release_holders(rows, "l_partkey", t.part.filter("p_partkey % 4 <> 0"), "p_partkey")


@demo("""WITH v AS (SELECT l_suppkey, l_shipdate, count(*) AS n, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), r AS (SELECT *, n / sum(n) OVER (PARTITION BY l_suppkey) AS share, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, w DESC, l_shipdate) AS r FROM v)
SELECT l_suppkey, max(CASE WHEN r = 1 THEN CAST(l_shipdate AS VARCHAR) END) AS day, round(max(CASE WHEN r = 1 THEN share END), 9) AS share, coalesce(string_agg(CASE WHEN r > 1 THEN CAST(l_shipdate AS VARCHAR) END, ',' ORDER BY r), '') AS others FROM r WHERE r <= 6 GROUP BY 1""")
def agg7_vote(t):
    rows = t.lineitem.select("l_suppkey", F.col("l_shipdate").cast("string").alias("day"), "l_quantity")
    return A.vote(rows, "l_suppkey", "day", "l_quantity").withColumn("share", F.round("share", 9))


@demo("""WITH p AS (SELECT c_nationkey, '.' || lower(substr(c_mktsegment, 1, 1)) AS extension, c_name || '.' || substr(c_mktsegment, 1, 1) AS name, c_acctbal FROM customer),
h AS (SELECT c_nationkey, extension, bool_and(c_acctbal > -900) AS ok FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, extension ORDER BY name) AS r FROM p) WHERE r <= 3 GROUP BY 1, 2),
g AS (SELECT c_nationkey, extension, regexp_replace(regexp_replace(name, '[.][^.]*$', ''), '[0-9]+', '#', 'g') || extension AS pattern, count(*) AS n, min(name) AS example FROM p GROUP BY ALL)
SELECT c_nationkey, extension, pattern, n, (SELECT count(*) FROM p WHERE p.c_nationkey = g.c_nationkey AND p.extension = g.extension) AS files, example, n >= 12 AS corpus FROM g JOIN h USING (c_nationkey, extension) WHERE ok AND n >= 4 AND contains(pattern, '#') ORDER BY n DESC, c_nationkey, pattern LIMIT 60""")
def agg13_corpora(t):
    rows = t.customer.withColumn("name", F.concat("c_name", F.lit("."), F.substring("c_mktsegment", 1, 1)))
    return A.corpora(rows, "c_nationkey", "name", sample=F.col("c_acctbal") > -900, most=60)


@demo(f"""WITH r AS (SELECT array_to_string(string_split({PATH_SQL}, '/')[1:2], '/') AS root, {PATH_SQL} AS p, length(html) AS s, split_part(url, ':', 1) AS k FROM pages), d AS (SELECT root, p, row_number() OVER (PARTITION BY root ORDER BY p) AS r FROM (SELECT DISTINCT root, p FROM r))
SELECT r.root, count(*) AS n, CAST(sum(s) AS BIGINT) AS bytes, count(DISTINCT k) AS packages, (SELECT string_agg(p, ',' ORDER BY p) FROM d WHERE d.root = r.root AND d.r <= 3) AS examples FROM r GROUP BY 1""")
def agg22_described_roots(t):
    rows = t.pages.select(F.regexp_extract("url", "://([^?#]*)", 1).alias("path"), F.length("html").alias("size"), F.split_part("url", F.lit(":"), F.lit(1)).alias("scheme"))
    return A.described_roots(rows, "path", "size", "scheme")


@demo(FIGURES_SQL.replace("SELECT CAST(grp AS BIGINT) AS grp, ", "SELECT CAST(grp AS BIGINT) AS grp, count(*) AS clusters, "))
def agg25_cluster_share(t):
    return C.figure_stats(t.sql(BOXES), "grp", "box").withColumn("main", F.round("main", 9))


@demo("""WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n, sum(count(*)) OVER (PARTITION BY l_suppkey) AS t FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, count(*) AS clusters, count(*) FILTER (n >= greatest(2, 0.25 * t)) AS figures, round(max(n) / max(t), 9) AS main FROM c GROUP BY 1""")
def agg25_group_share(t):
    return A.cluster_share(t.lineitem, "l_suppkey", "l_returnflag").withColumn("main", F.round("main", 9))


@demo("""SELECT source, doc_id, CAST(coalesce(used, 0) AS BIGINT) AS used FROM (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used FROM documents) WHERE coalesce(used, 0) < 20000""")
def win5_excerpt_rows(t):
    return W.excerpt_rows(t.documents.select("source", "doc_id", "n_chars"), "source", "n_chars", ["doc_id"], 20000).select("source", "doc_id", F.col("used").cast("long").alias("used"))


INSTANT_SQL = """WITH e AS (SELECT user_id AS entity, min(event_id) AS a, max(event_id) AS b FROM events GROUP BY 1), w AS (SELECT entity, k, a + (b - a) * k / 12 AS t FROM e, range(13) r(k)),
n AS (SELECT w.entity, w.k, w.t, l.event_id AS lt, h.event_id AS ht, l.value AS lv, h.value AS hv FROM w ASOF LEFT JOIN events l ON w.entity = l.user_id AND w.t >= l.event_id ASOF LEFT JOIN events h ON w.entity = h.user_id AND w.t <= h.event_id),
v AS (SELECT entity, k, t, CASE WHEN lt IS NULL THEN hv WHEN ht IS NULL OR ht = lt THEN lv ELSE lv + (hv - lv) * (t - lt) / (ht - lt) END AS v FROM n),
r AS (SELECT *, (v + 1) * 2 AS area, max(v) OVER (PARTITION BY entity) - min(v) OVER (PARTITION BY entity) AS travel FROM v), s AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(area, 9), k) AS r FROM r)
SELECT entity, round(area, 6) AS area, travel > v + 1 OR travel > 2 AS follow FROM s WHERE r = 7"""


@demo(INSTANT_SQL)
def win9_sampled_instant(t):
    keys = t.events.select(F.col("user_id").alias("entity"), F.col("event_id").alias("t"), F.col("value").alias("x"), F.col("value").alias("y"), (F.col("value") + 1).alias("w"), F.lit(2.0).alias("h"))
    return W.median_instant(keys, "entity", "t", ["x", "y"], ("w", "h")).select("entity", F.round("area", 6).alias("area"), "follow")


@demo("""WITH g AS (SELECT c_nationkey, count(*) AS n, max(c_acctbal) AS top FROM customer GROUP BY 1), r AS (SELECT c_nationkey, 'size' AS "check", CASE WHEN n < 50 THEN 'fail' WHEN n < 60 THEN 'warn' ELSE 'ok' END AS status, n || ' customers' AS message, 'add customers' AS remedy, true AS blocking FROM g
UNION ALL SELECT c_nationkey, 'rich', CASE WHEN top < 9000 THEN 'fail' WHEN top < 9900 THEN 'warn' ELSE 'ok' END, 'of ' || n || ' none is rich', 'look for others', false FROM g)
SELECT c_nationkey, "check", status, message, CASE WHEN status <> 'ok' THEN remedy END AS remedy, blocking FROM r""")
def gat1_check_rows(t):
    g = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.max("c_acctbal").alias("top"))
    n, top = F.col("n"), F.col("top")
    return K.check_rows(g, "c_nationkey", [("size", n < 50, n < 60, "{n} customers", "add customers", True), ("rich", top < 9000, top < 9900, "of {n} none is rich", "look for others", False)])


@demo("""WITH g AS (SELECT n_regionkey, count(c_custkey) AS total, count(DISTINCT n_nationkey) AS nations, count(*) FILTER (c_acctbal > 5000) AS rich FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)
SELECT *, round(nations / nullif(total, 0), 9) AS nations_share, round(rich / nullif(total, 0), 9) AS rich_share FROM g""")
def gat5_metrics_per_total(t):
    rows = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    got = K.per_total(rows, "n_regionkey", F.count("c_custkey"), {"nations": F.count_distinct("n_nationkey"), "rich": F.count_if(F.col("c_acctbal") > 5000)})
    return got.withColumn("nations_share", F.round("nations_share", 9)).withColumn("rich_share", F.round("rich_share", 9))


@demo("""WITH v AS (SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'good' WHEN l.quality = 0 THEN 'poor' END AS a, CASE WHEN d.lang <> 'en' THEN d.lang END AS b, CASE WHEN contains(lower(text), 'license') THEN 'legal' WHEN n_chars < 200 THEN 'short' END AS c FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT doc_id, coalesce(a, b, c) AS value, CASE WHEN a IS NOT NULL THEN 'label' WHEN b IS NOT NULL THEN 'lang' WHEN c IS NOT NULL THEN 'keyword' END AS source, CASE WHEN a IS NOT NULL THEN 'high' WHEN b IS NOT NULL THEN 'medium' WHEN c IS NOT NULL THEN 'low' END AS confidence,
concat_ws(',', 'label=' || a, 'lang=' || b, 'keyword=' || c) AS evidence FROM v""")
def job2_label_ladder(t):
    quality = t.labels.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("value"))
    word = F.coalesce(S.first_keyword("text", [("legal", ["license"])]), F.when(F.col("n_chars") < 200, "short"))
    return C.label_by_evidence(t.documents, "doc_id", [("label", "high", quality), ("lang", "medium", F.when(F.col("lang") != "en", F.col("lang"))), ("keyword", "low", word)])


@demo("""WITH l AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 40), g AS (SELECT l_partkey, count(*) AS n, bool_and(regexp_matches(CAST(l_suppkey AS VARCHAR), '[0-4]$')) AS a FROM l GROUP BY 1)
SELECT p_partkey, CASE WHEN coalesce(a, false) OR regexp_matches(p_name, '^[a-m]') THEN 'engine' ELSE 'game' END AS origin, coalesce(n, 0) AS hold_count FROM part LEFT JOIN g ON l_partkey = p_partkey""")
def job4_mark_origin_by_holders(t):
    holds = t.lineitem.filter("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").cast("string").alias("holder"))
    return C.mark_origin(t.part.select("p_partkey", "p_name"), "p_partkey", "p_name", holds, "holder", "[0-4]$", "^[a-m]")


@demo(f"WITH g AS ({DUPLICATES_SQL}), e AS (SELECT sum(n - 1) AS exact FROM (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY sha256(text))) SELECT count(DISTINCT component) AS groups, count(*) AS members, CAST(max(exact) AS BIGINT) AS exact_links FROM g, e")
def job5_duplicate_stats(t):
    links = C.duplicate_links(duplicate_rows(t), "id", "digest", "h", ["grp"], 2, 16)
    return C.duplicate_stats(C.duplicate_groups(links), links).drop("near_links")


@demo("""SELECT coalesce(p_brand, 'unlabelled') AS family, count(*) AS n, count(DISTINCT o) AS objects, count(*) FILTER (o IS NULL) AS loose, max(p_size) AS largest FROM part LEFT JOIN (SELECT l_partkey, min(l_orderkey) AS o FROM lineitem WHERE l_quantity > 30 GROUP BY 1) ON l_partkey = p_partkey GROUP BY 1""")
def job10_families_of_objects(t):
    owner = t.lineitem.filter("l_quantity > 30").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_orderkey").alias("o"))
    return C.families(t.part.join(owner, "p_partkey", "left"), F.col("p_brand"), "o", F.col("p_size"))


@demo("""WITH k AS (SELECT user_id, event_type AS track, event_id AS t, round(value, 1) AS v, CASE WHEN event_id % 3 = 0 THEN 'position' ELSE 'image' END AS kind FROM events), w AS (SELECT user_id, CAST(max(t) - min(t) AS BIGINT) AS duration, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, bool_or(kind <> 'image') AS moves FROM k GROUP BY 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY images DESC, frames DESC, track) AS r FROM (SELECT user_id, track, count(DISTINCT v) AS images, count(*) AS frames FROM k GROUP BY 1, 2)) WHERE r = 1)
SELECT w.user_id, track, frames, images, duration, kinds, moves, images >= 2 AS changes FROM w JOIN b USING (user_id)""")
def job12_clip_summary(t):
    keys = t.events.select("user_id", F.col("event_type").alias("track"), F.col("event_id").alias("t"), F.round("value", 1).alias("v"), F.when(F.col("event_id") % 3 == 0, "position").otherwise("image").alias("kind"))
    return C.animation_summary(keys, "user_id", "track", "t", "v", "kind")


MODELS_SQL = """WITH d AS (SELECT o_custkey AS obj, l_linenumber AS mesh, l_orderkey AS placement, l_partkey % 5 AS slot, l_partkey % 20 AS material FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
s AS (SELECT obj, mesh, string_agg(CAST(material AS VARCHAR), ',' ORDER BY slot, material) AS materials, bool_or(material % 4 = 0) AS textured FROM d GROUP BY obj, mesh, placement) SELECT obj, mesh, materials, textured, count(*) AS placements FROM s GROUP BY ALL"""


def models(t):
    draws = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("obj"), F.col("l_linenumber").alias("mesh"), F.col("l_orderkey").alias("placement"), (F.col("l_partkey") % 5).alias("slot"), (F.col("l_partkey") % 20).alias("material"))
    materials = t.part.select((F.col("p_partkey") % 20).alias("material"), F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("t"), (F.col("p_partkey") % 20).cast("string"))).alias("texture"))
    return C.model_table(draws, "obj", "mesh", "slot", "material", materials, "texture")


@demo(MODELS_SQL)
def job13_models(t):
    return models(t)


@demo(f"WITH m AS ({MODELS_SQL}) SELECT obj, count(*) AS meshes, CAST(sum(placements) AS BIGINT) AS placements, count(*) FILTER (textured) AS textured, count(*) FILTER (NOT textured) AS flat FROM m GROUP BY 1")
def job13_model_counts(t):
    return C.model_counts(models(t), "obj")


@demo("""WITH o AS (SELECT *, o_orderpriority AS corpus, o_orderstatus || ',' || o_orderpriority AS listed FROM orders), s AS (SELECT corpus, count(*) AS n, avg(o_totalprice) AS v FROM o GROUP BY 1), f AS (SELECT corpus FROM s ORDER BY n DESC, corpus LIMIT 1),
c AS (SELECT *, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // (SELECT greatest(20, count(*) // 20) FROM o WHERE corpus = (SELECT corpus FROM f)) AS b FROM o WHERE corpus = (SELECT corpus FROM f)),
i AS (SELECT regexp_replace(trim(unnest(string_split(listed, ','))), '[0-9]+$', '') AS item FROM o)
SELECT 'sets' AS section, corpus, NULL AS item, n, round(v, 4) AS value FROM s UNION ALL SELECT 'curve', (SELECT corpus FROM f), CAST(b AS VARCHAR), count(*), round(avg(o_totalprice), 4) FROM c GROUP BY b
UNION ALL SELECT 'families', NULL, item, count(*), NULL FROM i WHERE item <> '' GROUP BY item HAVING count(*) >= 2 UNION ALL SELECT 'keys', NULL, k, count(*), NULL FROM (SELECT unnest(CASE WHEN o_orderkey % 2 = 0 THEN ['a', 'b'] ELSE ['a'] END) AS k FROM o) GROUP BY k""")
def job9_corpus_sections(t):
    config = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))).otherwise(F.create_map(F.lit("a"), F.lit("1")))
    rows = t.orders.withColumn("listed", F.concat_ws(",", "o_orderstatus", "o_orderpriority"))
    return C.corpus_report(rows, "o_orderpriority", ["o_orderdate", "o_orderkey"], "o_totalprice", "listed", config).withColumn("value", F.round("value", 4))


@demo(f"""WITH k AS (SELECT 't' || user_id AS entity, event_id AS t, value / 100 AS v FROM events), i AS (SELECT l_orderkey AS item, l_suppkey AS unit, bool_or(l_returnflag <> 'R') AS flag, max(l_discount) * 10 AS alpha FROM lineitem GROUP BY 1, 2),
g AS (SELECT DISTINCT l_orderkey AS item, 't' || (l_orderkey % 50) AS toggle FROM lineitem), moments AS (SELECT l_suppkey AS unit, CAST(max(l_orderkey) AS BIGINT) AS t FROM lineitem GROUP BY 1),
w AS (SELECT DISTINCT toggle AS entity, t FROM i JOIN moments USING (unit) JOIN g USING (item)), v AS ({ASOF_SQL}),
x AS (SELECT i.*, moments.t, coalesce(v.v, 1) AS low FROM i JOIN moments USING (unit) JOIN g USING (item) LEFT JOIN v ON v.entity = g.toggle AND v.t = moments.t)
SELECT unit, t, count(*) AS items, count(*) FILTER (low >= 0.5 AND flag) AS shown, count(*) FILTER (low >= 0.5) AS could, round(avg(greatest(0, least(1, alpha * least(1, low)))), 6) AS alpha, count(*) FILTER (low >= 0.5 AND flag) < 0.4 * count(*) FILTER (low >= 0.5) AS woken FROM x GROUP BY 1, 2""")
def job16_visibility_at(t):
    items = t.lineitem.groupBy(F.col("l_orderkey").alias("item"), F.col("l_suppkey").alias("unit")).agg(F.bool_or(F.col("l_returnflag") != "R").alias("flag"), (F.max("l_discount") * 10).alias("alpha"))
    toggles = t.lineitem.select(F.col("l_orderkey").alias("item"), F.concat(F.lit("t"), (F.col("l_orderkey") % 50).cast("string")).alias("toggle")).distinct()
    keys = t.events.select(F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("toggle"), F.col("event_id").alias("t"), (F.col("value") / 100).alias("v"))
    times = t.lineitem.groupBy(F.col("l_suppkey").alias("unit")).agg(F.max("l_orderkey").cast("long").alias("t"))
    return C.visibility_at(items, "item", "unit", "flag", "alpha", toggles, keys, times, "t").withColumn("alpha", F.round("alpha", 6))


@demo("""WITH m AS (SELECT DISTINCT p_brand AS e, split_part(p_type, ' ', 1) AS a, split_part(p_name, ' ', 2) AS stem FROM part), o AS (SELECT a FROM m GROUP BY a ORDER BY count(DISTINCT e) DESC, a LIMIT 1), r AS (SELECT DISTINCT e, stem FROM m WHERE a = (SELECT a FROM o)),
n AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS stem FROM part WHERE p_size <= 25), h AS (SELECT e FROM r WHERE stem IN (SELECT stem FROM n) GROUP BY e HAVING count(*) >= 2) SELECT e, stem FROM r WHERE e IN (SELECT e FROM h)""")
def job3_confirmed_enums(t):
    stem = F.split_part("p_name", F.lit(" "), F.lit(2)).alias("stem")
    members = t.part.select(F.col("p_brand").alias("e"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("a"), stem)
    return O.confirmed_enums(members, "e", "a", "stem", t.part.filter("p_size <= 25").select(stem), 2)


@demo("""WITH v AS (SELECT c_mktsegment AS k, min(c_name) AS d, 0 AS s FROM customer WHERE c_acctbal > 9000 GROUP BY 1 UNION ALL SELECT split_part(p_name, ' ', 1), min(p_name), 1 FROM part GROUP BY 1 UNION ALL SELECT lang, min(source), 2 FROM documents GROUP BY 1)
SELECT k, min_by(d, s) AS d, CAST(min(s) AS INTEGER) AS source FROM v GROUP BY k""")
def job3_merged_vocabulary(t):
    first = F.split_part("p_name", F.lit(" "), F.lit(1)).alias("k")
    tables = [t.customer.filter("c_acctbal > 9000").select(F.col("c_mktsegment").alias("k"), F.col("c_name").alias("d")), t.part.select(first, F.col("p_name").alias("d")), t.documents.select(F.col("lang").alias("k"), F.col("source").alias("d"))]
    return O.merged_vocabulary(tables, "k", "d")


@demo()
def job6_assembled_objects(t):
    sprites = t.sql(NAMES).select(F.col("id").alias("sprite"), "name", (F.col("w") * F.col("h")).alias("area"))
    declared = t.part.filter("p_size > 48").select(F.col("p_partkey").alias("sprite"), F.col("p_brand").alias("marker"))
    return O.assemble_objects(sprites, declared, t.lineitem.select(F.col("l_orderkey").alias("clip"), F.col("l_partkey").alias("sprite")))
