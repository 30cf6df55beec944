"""Queries of projections, predicates and record parsing over the supplied tables."""

from pyspark.sql import functions as F

from stratafold.operators import scalar as S
from stratafold.plans.registry import demo

SEAMS = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"


@demo("SELECT doc_id, sha256(text) AS sha FROM documents")
def src3_content_hash(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha"))


@demo("SELECT page_id, regexp_extract(h, 'href=\"([^\"]*)\"', 1) AS href FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"[^\"]*\"')) AS h FROM pages)")
def src9_scan_matches(t):
    return t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))


@demo("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1 FROM pages")
def src19_extract_fields(t):
    fields = {"title": "<title>([^<]*)</title>", "lang": '<html lang="([^"]*)"', "h1": "<h1>([^<]*)</h1>"}
    return t.pages.select("page_id", *[F.regexp_extract("html", p, 1).alias(k) for k, p in fields.items()])


@demo("""SELECT doc_id, starts_with(substr(text, 1, 512), upper(substr(text, 1, 1))) AND substr(text, 1, 1) <> lower(substr(text, 1, 1)) AS capital_head,
 contains(substr(text, 1, 512), chr(10)) AS head_break, contains(right(text, 512), '.') AS tail_stop FROM documents""")
def src27_corpus_sniff(t):
    head, first = F.substring("text", 1, 512), F.substring("text", 1, 1)
    return t.documents.select("doc_id", ((first == F.upper(first)) & (first != F.lower(first))).alias("capital_head"), head.contains("\n").alias("head_break"), F.right("text", F.lit(512)).contains(".").alias("tail_stop"))


@demo("SELECT page_id, regexp_extract(url, '[.]([a-z]+)([?#]|$)', 1) AS ext, CASE WHEN regexp_matches(url, '[.]html([?#]|$)') THEN 'page' WHEN regexp_matches(url, '/([?#]|$)') THEN 'folder' ELSE 'other' END AS kind FROM pages")
def src4_infer_type(t):
    kind = F.when(F.col("url").rlike(r"[.]html([?#]|$)"), "page").when(F.col("url").rlike("/([?#]|$)"), "folder").otherwise("other")
    return t.pages.select("page_id", F.regexp_extract("url", "[.]([a-z]+)([?#]|$)", 1).alias("ext"), kind.alias("kind"))


@demo("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def src14_manifest_entries(t):
    return t.events.select(F.from_json("props", "map<string,bigint>").alias("m")).select(F.col("m")["k"].alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@demo("SELECT vec_id, " + " + ".join(f"CASE WHEN embedding[{k}] > embedding[{k + 1}] THEN {1 << (16 - k)} ELSE 0 END" for k in range(1, 17)) + " AS h FROM embeddings")
def src12_difference_hash(t):
    return t.embeddings.select("vec_id", S.difference_bits("embedding", 16).alias("h"))


@demo(f"SELECT p_partkey, array_to_string({SEAMS.format('p_name')}, '|') AS words FROM part")
def prj1_name_tokens(t):
    return t.part.select("p_partkey", F.array_join(S.name_tokens("p_name"), "|").alias("words"))


@demo("""WITH k AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'), '[0-9]+$', '') AS k FROM part)
SELECT p_partkey, CASE WHEN length(k) > 4 AND regexp_matches(k, 's$') AND NOT regexp_matches(k, '(ss|us|is|as)$') THEN regexp_replace(k, 's$', '') ELSE k END AS key FROM k""")
def prj2_normalise_key(t):
    return t.part.select("p_partkey", S.normalise_key("p_name").alias("key"))


@demo("""WITH p AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '://[^/]*/([^?#]*)', 1), '/'), lambda x: x <> '' AND lower(x) NOT IN ('en', 'www')) AS p FROM pages)
SELECT page_id, p[-1] AS label FROM p""")
def prj3_label_from_path(t):
    return t.pages.select("page_id", S.deepest_label(F.regexp_extract("url", "://[^/]*/([^?#]*)", 1), ["en", "www"]).alias("label"))


@demo("""WITH p AS (SELECT page_id, string_split(regexp_extract(url, '://([^?#]*)', 1), '/') AS p FROM pages), q AS (SELECT page_id, CASE WHEN list_position(p, 'en') > 0 THEN p[list_position(p, 'en') + 1] END AS f FROM p)
SELECT page_id, CASE WHEN f NOT IN ('1', '2') AND f <> '' THEN f END AS folder FROM q""")
def prj4_folder_after(t):
    return t.pages.select("page_id", S.folder_after(F.regexp_extract("url", "://([^?#]*)", 1), "en", ["1", "2"]).alias("folder"))


@demo("SELECT doc_id, CASE WHEN contains(lower(text), 'license') OR contains(lower(text), 'copyright') THEN 'legal' WHEN contains(lower(text), '@') THEN 'contact' WHEN contains(lower(text), 'tion') THEN 'prose' END AS label FROM documents")
def prj5_first_keyword(t):
    return t.documents.select("doc_id", S.first_keyword("text", [("legal", ["license", "copyright"]), ("contact", ["@"]), ("prose", ["tion"])]).alias("label"))


@demo("""WITH w AS (SELECT p_partkey, regexp_extract(lower(p_name), '^([a-z][a-z0-9]{2,}) ', 1) AS w FROM part)
SELECT p_partkey, CASE WHEN w <> '' AND w NOT IN ('the', 'new') AND NOT regexp_matches(w, '^[0-9a-f]{8,}$') AND NOT regexp_matches(w, '^((lot|small)[0-9]*|[a-z][0-9]+)$') THEN w END AS label FROM w""")
def prj6_prefix_label(t):
    return t.part.select("p_partkey", S.prefix_label("p_name", ["the", "new"], ["lot", "small"], " ").alias("label"))


@demo("SELECT c_custkey, regexp_replace(c_name, '[0-9]+', '#', 'g') AS pattern FROM customer")
def prj7_numbering_pattern(t):
    return t.customer.select("c_custkey", S.numbering_pattern("c_name").alias("pattern"))


@demo("SELECT event_id, CASE WHEN lower(event_type) IN ('view', 'click') THEN 'browse' WHEN lower(event_type) IN ('purchase') THEN 'buy' END AS kind FROM events")
def prj8_media_kind(t):
    return t.events.select("event_id", S.media_kind("event_type", {"browse": ["view", "click"], "buy": ["purchase"]}).alias("kind"))


@demo("SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'x$') THEN 9 WHEN regexp_matches(p_name, '^a') THEN 0 WHEN regexp_matches(p_name, 'e') THEN 1 ELSE 5 END AS rank FROM part")
def prj9_rank_by_pattern(t):
    return t.part.select("p_partkey", S.rank_by_pattern("p_name", ["^a", "e"], ["x$"]).alias("rank"))


@demo("SELECT o_orderkey, round(least(greatest((o_totalprice - 1000.0) / (300000.0 - 1000.0), 0.0), 1.0), 9) AS score FROM orders")
def prj10_ramp(t):
    return t.orders.select("o_orderkey", F.round(S.ramp("o_totalprice", 1000.0, 300000.0), 9).alias("score"))


@demo("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def prj11_first_limit(t):
    return t.events.select("event_id", S.first_limit(F.from_json("props", "map<string,string>"), ["limit", "k"]).alias("k"))


@demo("SELECT o_orderkey, (o_orderkey >> 2) & 15 AS bits FROM orders")
def prj12_bit_field(t):
    return t.orders.select("o_orderkey", S.bit_field("o_orderkey", 2, 15).alias("bits"))


@demo("""SELECT vec_id, round(degrees(2 * atan2(CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE))), 6) AS deg,
CAST(floor(least(greatest(CASE WHEN v <= 0.0031308 THEN v * 12.92 ELSE pow(v, 1 / 2.4) * 1.055 - 0.055 END, 0.0), 1.0) * 255 + 0.5) AS INTEGER) AS display
FROM (SELECT *, abs(CAST(embedding[3] AS DOUBLE)) AS v FROM embeddings)""")
def prj14_angles_and_colours(t):
    e = lambda k: F.col("embedding")[k].cast("double")
    return t.embeddings.select("vec_id", F.round(S.quat_to_degrees(e(0), e(1)), 6).alias("deg"), S.to_display(F.abs(e(2))).alias("display"))


@demo("SELECT s_suppkey, string_split(s_name, '#')[1] AS grp, CASE WHEN contains(s_name, '#') THEN substr(s_name, strpos(s_name, '#') + 1) END AS label FROM supplier")
def prj15_bundle_name(t):
    group, label = S.name_fields("s_name", "#")
    return t.supplier.select("s_suppkey", group.alias("grp"), label.alias("label"))


@demo("""WITH a(alias, name, grp) AS (VALUES ('nation_1', 'Gaul', 'west'), ('nation_2', 'Cathay', 'east'))
SELECT n_nationkey, coalesce(a.name, n_name) AS n_name, a.grp FROM nation LEFT JOIN a ON lower(n_name) = a.alias WHERE lower(n_name) NOT IN ('nation_3', 'nation_4')""")
def prj17_apply_rules(t):
    aliases = t.spark.createDataFrame([("Nation_1", "Gaul", "west"), ("NATION_2", "Cathay", "east")], "alias string, name string, grp string")
    return S.apply_rules(t.nation, "n_name", aliases, ["nation_3", "nation_4"]).select("n_nationkey", "n_name", "grp")


@demo("SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'R' WHEN bool_or(l_returnflag = 'N') THEN 'N' ELSE min(l_returnflag) END AS flag FROM lineitem GROUP BY l_orderkey")
def prj18_choose_preferred(t):
    held = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("s"))
    return held.select("l_orderkey", S.choose_preferred("s", ["R", "N"]).alias("flag"))


@demo("""WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount AS a, l_tax AS b, l_quantity AS c, -l_tax AS d, l_discount AS e, 2.0 AS f FROM lineitem),
p AS (SELECT *, [a*x + b*y + c for x in [-5.0, 5.0] for y in [-2.0, 6.0]] AS px, [d*x + e*y + f for x in [-5.0, 5.0] for y in [-2.0, 6.0]] AS py FROM m)
SELECT l_orderkey, l_linenumber, l_partkey, round(list_min(px), 6) AS x0, round(list_min(py), 6) AS y0, round(list_max(px), 6) AS x1, round(list_max(py), 6) AS y1 FROM p""".replace(
    "[a*x + b*y + c for x in [-5.0, 5.0] for y in [-2.0, 6.0]]", "[" + ", ".join(f"a*{x} + b*{y} + c" for x in (-5.0, 5.0) for y in (-2.0, 6.0)) + "]"
).replace("[d*x + e*y + f for x in [-5.0, 5.0] for y in [-2.0, 6.0]]", "[" + ", ".join(f"d*{x} + e*{y} + f" for x in (-5.0, 5.0) for y in (-2.0, 6.0)) + "]"))
def prj20_affine_box(t):
    m = (F.col("l_discount"), F.col("l_tax"), F.col("l_quantity"), -F.col("l_tax"), F.col("l_discount"), F.lit(2.0))
    box = S.affine_box(m, (10.0, 8.0), (0.5, 0.25))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(c, 6).alias(k) for k, c in box.items()])


@demo("SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#11' AND p_size BETWEEN 5 AND 40 AND (contains(lower(p_name), 'a') OR contains(lower(p_type), 'a'))")
def flt1_browse_filter(t):
    return S.browse_filter(t.part, {"p_brand": "Brand#11"}, ("p_size", 5, 40), (["p_name", "p_type"], "A")).select("p_partkey", "p_name")


@demo("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
def flt2_type_filter(t):
    return t.orders.filter(F.col("o_orderstatus").isin("F", "P")).select("o_orderkey")


@demo("SELECT vec_id, len(list_filter(embedding[1:2], lambda v: v BETWEEN 0 AND 1)) = 2 AS unit FROM embeddings")
def flt3_in_unit_range(t):
    return t.embeddings.select("vec_id", S.in_unit_range(F.slice("embedding", 1, 2)).alias("unit"))


@demo("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def flt4_group_visible(t):
    return S.group_visible(t.orders, "o_orderkey", F.col("o_orderpriority") == "1-URGENT", t.lineitem, "l_orderkey", F.col("l_quantity") >= 49).select("o_orderkey")
