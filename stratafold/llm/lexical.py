"""Ranked lexical search over an inverted index in blocks, term at a time with a limit on accumulators."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafold.llm.storage import stored

#: Fixed values of the ranking: runs of ASCII letters and digits and of all other characters beyond ASCII are terms.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters and documents of one block of the index, items that one task holds against a block, and bits of the filter of wanted terms.
BLOCK_CHARS, BLOCK_DOCS, ITEM_BLOCK, FILTER_BITS = 16_000_000, 20_000, 256, 1 << 23
#: Terms that a task remembers as wanted or not before it starts anew.
TABLE_ENTRIES = 500_000
_SMALL = str.maketrans(UPPER, LOWER)
#: Stands for a null id, which ranks first among equals.
_LEAST = -(1 << 63)


class Wanted(dict):
    """Whether a term's bit is set in a filter, remembered for each term."""

    def __init__(self, bits: bytes) -> None:
        self.bits = bits

    def __missing__(self, term: str) -> int:
        if len(self) > TABLE_ENTRIES:
            self.clear()
        at = zlib.crc32(term.encode("utf-8")) % FILTER_BITS
        self[term] = kept = self.bits[at >> 3] >> (at & 7) & 1
        return kept


def term_filter(terms: DataFrame) -> bytes:
    """One bit for the hash of each ``term``, in ``FILTER_BITS`` bits whatever their number; set by Spark in stretches of 32,768 bits."""
    at = F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(FILTER_BITS))
    parts = terms.select(at.alias("at")).groupBy(F.expr("at div 32768").alias("part")).agg(F.expr("bitmap_construct_agg(at % 32768)").alias("bits"))
    bits = bytearray(FILTER_BITS // 8)
    for part, held in parts.collect():  # at most FILTER_BITS / 32,768 rows of 4 KB
        bits[part * 4096 : (part + 1) * 4096] = held
    return bytes(bits)


def inverted_blocks(df: DataFrame, id_col: str, text_col: str, bits: bytes) -> DataFrame:
    """(block, term, df, total, docs, freqs, ids): for each block of documents a row for each wanted term and one, of a null term, for the documents.

    ``docs`` are the places in the block that hold the term, 32-bit integers, ascending, ``freqs`` how often.
    In the row of a null term ``docs`` are those with any term, ``freqs`` their numbers of terms, ``total`` the sum
    of these, and ``ids`` all ids as strings. Terms whose bit in ``bits`` is not set have no row. A block has
    about ``BLOCK_CHARS`` characters of whole texts; a longer text has its own.
    """
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string())]
    names = ["block", "term", "df", "total", "docs", "freqs", "ids"]
    packed = lambda x: np.array(x, "<i4").tobytes()

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    class Block:
        def __init__(self, name: str) -> None:
            self.name, self.ids, self.size, self.found = name, [], 0, {}
            self.docs, self.lengths = [], []

        def add(self, doc: str, text: str, wanted: Wanted, find: re.Pattern) -> None:
            words = find.findall(text.translate(_SMALL))
            at = len(self.ids)
            if words:
                self.docs.append(at)
                self.lengths.append(len(words))
            for term, tf in Counter([w for w in words if wanted[w]]).items():
                held = self.found.get(term)
                if held is None:
                    held = self.found[term] = ([], [])
                held[0].append(at)
                held[1].append(tf)
            self.ids.append(doc)
            self.size += len(text)

        def rows(self) -> Iterator[pa.RecordBatch]:
            out = [(self.name, None, len(self.docs), sum(self.lengths), packed(self.docs), packed(self.lengths), self.ids)]
            out += [(self.name, term, len(docs), None, packed(docs), packed(freqs), None) for term, (docs, freqs) in self.found.items()]
            for k in range(0, len(out), 10_000):
                yield batch(out[k : k + 10_000])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, wanted, find = TaskContext.get().partitionId(), 0, Wanted(bits), re.compile(TERM)
        block = Block(f"{task}-0")
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if block.ids and (block.size + len(text) > BLOCK_CHARS or len(block.ids) >= BLOCK_DOCS):
                    yield from block.rows()
                    number += 1
                    block = Block(f"{task}-{number}")
                block.add(doc, text, wanted, find)
        if block.ids:
            yield from block.rows()

    docs = df.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return docs.mapInArrow(index, "block string, term string, df long, total long, docs binary, freqs binary, ids array<string>")


def item_terms(items: DataFrame, id_col: str, text_col: str, per_block: int = ITEM_BLOCK) -> DataFrame:
    """(group, item, item_id, term): the distinct terms of each item, items in groups of about ``per_block``."""
    rows = items.select(F.col(id_col).alias("item_id"), F.translate(text_col, UPPER, LOWER).alias("t")).distinct()
    rows = rows.withColumn("item", F.xxhash64(F.col("item_id").isNull(), "item_id", "t"))
    groups = max(1, -(-rows.count() // per_block))
    terms = F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(TERM), F.lit(0))))
    return rows.withColumn("group", F.pmod("item", F.lit(groups)).cast("int")).select("group", "item", "item_id", terms.alias("term"))


def best_of_block(term_docs: list[np.ndarray], gains: list[np.ndarray], n_docs: int, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the ``k`` best documents of a block, ties to smaller ``ids``; terms come rarest first.

    Each term adds its gains to the documents that have accumulators. It makes new ones only while what this
    and all later terms can still give reaches the k-th best partial score; after that only survivors are
    updated, exactly, and one whose partial score and all that may follow stay below the k-th goes.
    """
    score, alive = np.zeros(n_docs, np.int64), np.zeros(n_docs, bool)
    most = [int(g.max(initial=0)) for g in gains]
    left = sum(most)
    making, kth = True, 0
    for docs, gain, top in zip(term_docs, gains, most, strict=True):
        # A document without an accumulator can reach ``left`` at most; an equal score may win by its id.
        if making and left < kth:
            making = False
        if making:
            score[docs] += gain
            alive[docs] = True
        else:
            held = alive[docs]
            score[docs[held]] += gain[held]
        left -= top
        own = np.flatnonzero(alive)
        if len(own) >= k:
            kth = int(np.partition(score[own], len(own) - k)[len(own) - k])
            if not making:
                alive[own[score[own] + left < kth]] = False
    own = np.flatnonzero(alive & (score > 0))
    best = own[np.lexsort((ids[own], -score[own]))[:k]]
    return best, score[best]


def ranked_search(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each item, ties by ascending id.

    A term that N documents have, of which df hold it, weighs floor(1000 ln((2 N + 2) / (2 df + 1))); a document with tf of it adds
    weight * (10^9 tf div (1000 tf + 20 m)), where m is 50 and half its number of terms in percent of the mean.

    The documents become an inverted index in blocks, stored once. Groups of items meet a block's lists of
    their terms alone; a task searches one block for one group and returns ``k`` documents an item, with weights from the whole corpus.
    Null texts have no terms; null ids rank first among equals; repeated documents rank each; items equal
    in id and text are one, and items that share an id alone are ranked apart under it. An empty
    table on either side gives an empty result; other columns are not read.
    """
    wanted = stored(item_terms(items, item_id, item_text), "wanted")
    bits = term_filter(wanted.select("term").distinct())
    index = stored(inverted_blocks(docs, doc_id, doc_text, bits), "index")
    whole, lists = index.filter("term is null"), index.filter("term is not null")
    n_docs, n_terms = whole.agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()

    # Up to ITEM_BLOCK items of a group share a term's list.
    sharing = wanted.groupBy("term", "group").agg(F.collect_list("item").alias("items"))
    held = lists.select("term", "df").join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("n"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("n") + 1)))
    weighed = stored(sharing.join(held, "term").withColumn("weight", weight.cast("long")), "weighed")
    met = lists.select("term", "block", "docs", "freqs").join(weighed, "term")
    groups = (wanted.agg(F.max("group")).first()[0] or 0) + 1
    against = whole.select("block", "docs", "freqs", "ids", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).toDF("own", "places", "lengths", "ids", "against")

    def search(lists: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        read = lambda b: np.frombuffer(b, "<i4").astype(np.int64)
        names = block["ids"].iloc[0]
        ids = np.array([_LEAST if x is None else int(x) for x in names], np.int64)
        length = np.zeros(len(ids), np.int64)
        length[read(block["places"].iloc[0])] = read(block["lengths"].iloc[0])
        m = 50 + 50 * length * n_docs // max(n_terms, 1)
        lists = lists.sort_values(["n", "term"], ignore_index=True)
        places = [read(d) for d in lists["docs"]]
        gains = [w * (1_000_000_000 * tf // (1000 * tf + 20 * m[at])) for w, at, tf in zip(lists["weight"], places, map(read, lists["freqs"]), strict=True)]
        own = defaultdict(list)
        for row, some in enumerate(lists["items"]):
            for item in some:
                own[item].append(row)
        out = []
        for item, rows in own.items():
            best, score = best_of_block([places[r] for r in rows], [gains[r] for r in rows], len(ids), ids, k)
            out += [(item, names[at], s) for at, s in zip(best.tolist(), score.tolist(), strict=True)]
        return pd.DataFrame(out, columns=["item", "doc_id", "score"])

    near = met.groupBy("block", "group").cogroup(against.groupBy("own", "against")).applyInPandas(search, "item long, doc_id string, score long")
    near = near.withColumn("doc_id", F.col("doc_id").cast("long"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    best = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(wanted.select("item", "item_id").distinct(), "item").select(F.col("item_id").alias(item_id), "rank", F.col("doc_id").alias(doc_id), "score")
