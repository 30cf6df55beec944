"""The registered queries of the operators of this subpackage, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.llm import langid, lexical, lines, lm, media, merkle, mixture, neardup, packing, pieces, tokens, topk, urls

BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: The URL rules, and hosts that the method lists besides the addresses of pages whose title strings keywords together.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
LISTED_HOSTS = ["spam-farm.example.org", "cheap-pills.example.com"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among one picture for each row of embeddings, and an edited copy for each twentieth."""
    pictures = media.pictures(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return media.media_copies(pictures, "image_id")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text."""
    return tokens.token_counts(_table(spark, sf_dir, "documents"), "doc_id", "text", BPE)


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other vectors of each hundredth one, by integer inner product."""
    return topk.top_inner_products(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 100 == 0)


def op4_piece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the pieces of every whole text and of what they decode to."""
    return pieces.piece_digests(_table(spark, sf_dir, "documents"), "doc_id", "text", PIECES)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 1024 ids."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), "doc_id", "text", BPE)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every page; listed are two hosts and the addresses of all pages whose title holds two bars at least."""
    pages = _table(spark, sf_dir, "pages")
    host, path = urls.url_parts("url")
    stuffed = pages.filter(F.regexp_extract("html", "<title>([^<]*)</title>", 1).rlike(r"\|.*\|")).select(F.concat(host, path).alias("key"))
    listed = spark.createDataFrame([(h,) for h in LISTED_HOSTS], "key string").union(stuffed)
    return urls.judge_urls(pages, "page_id", "url", RULES, listed)


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every whole text; one fold of seven is held out of learning."""
    return lm.lm_scores(_table(spark, sf_dir, "documents"), "doc_id", "text")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups over sets of four-word shingles."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), "doc_id", "text", width=4, percent=80)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and removed lines of every document, and a digest of what is left; a line on ten sources goes but once."""
    kept = lines.dedup_lines(_table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return kept.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.md5("text").alias("text_md5"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text; one fold of three is held out of learning."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", held)
    languages, weights = langid.train_language_model(docs.filter(~F.col("held_out")), "doc_id", "text", "lang")
    got = langid.identify_language(docs, "doc_id", "text", languages, weights, ["held_out"])
    return got.select("doc_id", "held_out", "lang_pred", "score")


def op11_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document in windows of 2048 ids that mirror the sources' shares of all ids."""
    return mixture.pack_mixture(_table(spark, sf_dir, "documents"), "doc_id", "text", "source", WORD_BPE)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document in a tree of the trees of its sources; one fold of five is checked with its text tampered with."""
    tamper = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.dataset_manifest(_table(spark, sf_dir, "documents"), "doc_id", "source", ["lang", "n_chars"], "text", tamper)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents for every benchmark item."""
    return lexical.ranked_search(_table(spark, sf_dir, "documents"), "doc_id", "text", _table(spark, sf_dir, "benchmark"), "item_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_media_copies, op2_token_counts, op3_exact_topk, op4_piece_coding, op5_best_fit_packing,
        op6_url_filter, op7_lm_scores, op8_near_duplicates, op9_line_dedup, op10_language,
        op11_mixture_packing, op12_merkle_manifest, op13_ranked_search,
    )}


_RULE_CASES = """
  WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END"""


def _tree_sql(leaves: str, name: str, depth: int) -> str:
    """CTEs: levels of the trees of ``leaves`` (tree, pos, node, folded, doc, proof) of 16 children each, and each doc's node, fold and proof above them."""
    ctes = [f"""{name}n0 AS (SELECT tree, pos, min(node) AS node, count(*) OVER (PARTITION BY tree) AS c FROM {leaves} GROUP BY tree, pos),
{name}f0 AS (SELECT doc, tree, pos, folded, proof FROM {leaves})"""]
    for k in range(depth):
        n, f = f"{name}n{k}", f"{name}f{k}"
        ctes.append(f"""{name}n{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM
  (SELECT tree, pos // 16 AS pos, CASE WHEN any_value(c) > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE min(node) END AS node FROM {n} GROUP BY tree, pos // 16)),
{name}f{k + 1} AS (SELECT f.doc, f.tree, f.pos // 16 AS pos,
    CASE WHEN any_value(n.c) > 1 THEN sha256(string_agg(CASE WHEN n.pos = f.pos THEN f.folded ELSE n.node END, '' ORDER BY n.pos)) ELSE any_value(f.folded) END AS folded,
    any_value(f.proof) || coalesce(string_agg(n.node, '' ORDER BY n.pos) FILTER (n.pos <> f.pos), '') AS proof
  FROM {f} f JOIN {n} n ON f.tree = n.tree AND f.pos // 16 = n.pos // 16 GROUP BY f.doc, f.tree, f.pos)""")
    return ",\n".join(ctes)


_SMALL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SIZED = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = " || ".join(_SIZED.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
#: CRC-32 of the digits of doc_id: one step for each bit.
_CRC = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: [CAST(ascii(d) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
  lambda x, i: xor(xor(x, i) >> 1, 3988292384 * (xor(x, i) & 1))), CAST(4294967295 AS BIGINT))"""
_MANIFEST_SQL = f"""
WITH l AS (SELECT row_number() OVER () AS doc, doc_id, source, sha256({_LEAF} || {_SIZED.format("text")}) AS leaf,
           CASE WHEN {_CRC} % 5 = 0 THEN sha256({_LEAF} || {_SIZED.format(_SMALL.format("text"))}) END AS changed FROM documents),
r AS (SELECT doc, coalesce('=' || source, '-') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS node, coalesce(changed, leaf) AS folded, '' AS proof FROM l),
{_tree_sql("r", "a", 6)},
s AS (SELECT tree AS name, node, '*' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos FROM an6),
t AS (SELECT f.doc, s.tree, s.pos, s.node, f.folded, f.proof FROM af6 f JOIN s ON s.name = f.tree),
{_tree_sql("t", "b", 4)}
SELECT doc_id, leaf, an6.node AS subroot, bn4.node AS root, sha256(proof) AS proof_sha256, bf4.folded AS folded_root, bf4.folded = bn4.node AS verified
FROM l JOIN bf4 USING (doc) JOIN bn4 ON true JOIN an6 ON an6.tree = coalesce('=' || source, '-')"""
_TERMS = "regexp_extract_all(" + _SMALL + ", '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, {_TERMS.format("text")} AS terms FROM documents),
n AS (SELECT doc, doc_id, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
q AS (SELECT DISTINCT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark),
p AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p JOIN s ON true GROUP BY term, docs),
g AS (SELECT item_id, doc_id, doc, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words)))) AS BIGINT) AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN n USING (doc) JOIN s ON true GROUP BY ALL)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM g WHERE score > 0) WHERE r <= 50"""


def oracle_sql() -> dict[str, str]:
    return {
        "op12_merkle_manifest": _MANIFEST_SQL,
        "op13_ranked_search": _SEARCH_SQL,
        "op3_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10""",
        "op6_url_filter": f"""
WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) LIKE '%|%|%' AS stuffed, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r AS (SELECT *, CASE {_RULE_CASES} AS rule FROM p)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN {" OR ".join(f"host = '{h}' OR suffix(host, '.{h}')" for h in LISTED_HOSTS)} OR (host <> '' AND host || path IN (SELECT host || path FROM p WHERE stuffed)) THEN 'block' ELSE 'allow' END AS verdict
FROM r""",
        "op9_line_dedup": """
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
b AS (SELECT trim(line, ' ') AS k, min(doc_id) AS first FROM l WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 10),
f AS (SELECT trim(line, ' ') AS k, min(pos) AS pos FROM l JOIN b ON trim(line, ' ') = b.k AND l.doc_id = b.first GROUP BY 1),
d AS (SELECT l.doc_id, l.pos, l.line, b.k IS NOT NULL AND NOT (l.doc_id = b.first AND l.pos = f.pos) AS gone
      FROM l LEFT JOIN b ON trim(l.line, ' ') = b.k LEFT JOIN f ON f.k = b.k),
a AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS text_md5 FROM d GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, text_md5 FROM documents t LEFT JOIN a ON a.doc_id = t.doc_id""",
    }
