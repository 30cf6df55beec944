"""A pipeline over documents: language, shared lines, near duplicates, packing."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.llm import langid, lines, neardup, packing
from stratafold.llm.storage import shared_folder, stored
from stratafold.llm.urls import maybe_listed

#: A text is rejected as letters without a language if that has this probability at least, averaged over its bytes,
#: and a higher one than in this share of the labelled texts that are held out of learning and labelled rightly.
LEAST_NOISE, CLEAN_SHARE = 0.75, 0.999


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters that are in some language; all columns of documents stay as they are.

    The network learns from two labelled texts of three; what scrambled letters look like is learned from
    the same texts. The third ones, held out, tell how noisy clean texts may seem. Without labelled texts
    all with a letter stay. Null and letterless texts go; null ids and repeated rows are judged alike.
    """
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    languages, weights = langid.train_language_model(docs.filter(~held), "doc_id", "text", "lang", noise=True)
    if not languages:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(columns)
    judged = lambda rows: langid.identify_language(rows, "doc_id", "text", languages, weights, columns[2:])
    seen = judged(docs.filter(held & F.col("lang").isNotNull())).filter(F.col("lang_pred") == F.col("lang"))
    usual = seen.agg(F.percentile_approx("noise", CLEAN_SHARE, 10_000)).first()[0] or 0.0
    kept = judged(docs).filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("noise") <= max(LEAST_NOISE, usual)))
    return kept.select(columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many sources share; documents that lose all their lines go."""
    kept = lines.dedup_lines(docs, "doc_id", "text", "source").filter((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", "\n", " ")) != ""))
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.select("doc_id", "text", "lang", "source", length.alias("n_chars"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest id; a null id is the largest.

    Rows are told apart by a hash of id and text, so null ids and ids of several texts do no harm. Of rows
    that repeat both, one stays. Texts without words are in no group and stay. Texts that stay for
    certain, by a filter of all rows that go or repeat, are not moved.
    """
    rows = docs.withColumn("row", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    near = stored(neardup.near_duplicates(rows, "row", "text", width=5, percent=80).select("row", "component_id", "n_shingles"), "near")
    copies = rows.groupBy("row", "doc_id").agg(F.count("*").alias("copies")).join(near.filter("n_shingles > 0").distinct(), "row")
    best = copies.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "copies")).alias("b")).select("b.row", "b.copies")
    wordless = near.filter("n_shingles = 0").select("row", F.lit(1).cast("long").alias("copies")).distinct()
    chosen = stored(best.unionByName(wordless), "kept")
    odd = stored(near.select("row").distinct().join(chosen.filter("copies = 1"), "row", "left_anti").select(F.col("row").alias("key")), "odd")
    asked = maybe_listed(odd, "row")
    kept = rows.filter(asked).join(chosen, "row")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    one = kept.filter("copies > 1").groupBy("row").agg(F.min(F.struct(*columns)).alias("r")).select("r.*")
    return rows.filter(~asked).select(*columns).unionByName(kept.filter("copies = 1").select(*columns)).unionByName(one)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents with their sequences."""
    return packing.pack_documents(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("minhash_near_dedup", minhash_near_dedup), ("best_fit_packing", best_fit_packing)]

#: Language identification and packing cannot be expressed in SQL; tests hold each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
