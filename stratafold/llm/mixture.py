"""Packing token sequences so that every window holds sources in target proportions, by deficit round-robin."""

from __future__ import annotations

import functools
import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.llm.merging import PairTable, merge_ragged
from stratafold.llm.storage import stored
from stratafold.llm.tokens import byte_letters, ragged, slices

#: Tokens that a queue gives at a time; a window's share of a source is right to within one such unit, and what is owed is carried on.
UNIT = 64
#: Windows' worth of rounds that one task plays, and tokens of a queue's segment, whose texts one task cuts.
ROUNDS, SEGMENT = 1024, 1 << 18
#: Weights are whole numbers that add up to about this.
SCALE = 1 << 20
#: Bytes of text that a task takes apart at once; a longer text is taken whole.
SLICE_BYTES = 6_000_000
#: Chunks of composed Latin letters with one small letter each, with a comma or a stop or without.
LATIN = "^[A-Za-zÀ-ÖØ-öø-įı-ɏ]+[,.]?$"
#: Texts that tell whether words are merged as the library does it.
PROBES = ["The quick Brown fox's jumping, over. Ärger ÉTÉ straße naïveté, don't zzxqj a I antidisestablishmentarianism.", "ŒUVRE ﬁn Σίσυφος İstanbul x2, Ǆ ŉ a,. b.. .c", "", "é"]


class WordVocabulary:
    """Ids of whole texts as the tokenizers library gives them, found once for each distinct chunk of some texts.

    Chunks lie between spaces and line ends. That is exact for vocabularies whose pre-tokens hold no white
    space, which texts with a double space and a line end are probed for at the start. Chunks of Latin
    letters, with a comma or a stop behind them or not, are single words to such vocabularies; if these end
    words with a suffix, the lower-case words are merged together in one ragged array, which is probed
    against the library too. All other chunks are asked of the library.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        specials = [t["content"] for t in spec["added_tokens"]]
        self.pairs = self._word_pairs(spec["model"])
        self.stops = [self.library.encode(c, add_special_tokens=False).ids for c in ",."]
        probes = ["One  two\nthree's 4 .", *(f"a {s}b\n{s} {s}" for s in specials), *PROBES]
        ids, lengths = self.encode(pa.array(probes))
        whole = [self.library.encode(p, add_special_tokens=False).ids for p in probes]
        if any(" " in s or "\n" in s for s in specials) or ids.tolist() != sum(whole, []) or lengths.tolist() != list(map(len, whole)):
            raise ValueError("this vocabulary has tokens across spaces, or words of another form")

    def _word_pairs(self, model: dict) -> PairTable | None:
        """The merges of words whose last symbol carries the model's suffix; None where it has no suffix."""
        vocab, end = model["vocab"], model.get("end_of_word_suffix")
        if not end:
            return None
        letters = byte_letters()
        self.inner, self.last = (np.array([vocab[c + s] for c in letters], np.int64) for s in ("", end))
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        return PairTable([(vocab[a], vocab[b], r, vocab[a + b]) for r, (a, b) in enumerate(pairs)])

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each of the distinct lower-case words."""
        edges = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        held = np.frombuffer(words.buffers()[2], np.uint8)[edges[0] : edges[-1]]
        lengths, ends = np.diff(edges).astype(np.int64), edges[1:] - edges[0]
        symbols = self.inner[held]
        symbols[ends - 1] = self.last[held[ends - 1]]
        return merge_ragged(symbols, lengths, self.pairs)

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each of the distinct chunks."""
        plain = pc.match_substring_regex(chunks, LATIN).to_numpy(zero_copy_only=False) if self.pairs else np.zeros(len(chunks), bool)
        words = chunks.filter(pa.array(plain))
        stop = np.full(len(words), -1)
        for k, c in enumerate(",."):
            stop[pc.ends_with(words, c).to_numpy(zero_copy_only=False)] = k
        some = pc.utf8_lower(pc.utf8_rtrim(words, ",.")).dictionary_encode()
        ids, counts = self._words(some.dictionary) if len(words) else (np.empty(0, np.int64), np.empty(0, np.int64))
        which = some.indices.to_numpy(zero_copy_only=False)
        # Words, then the two stops, are parts of chunks; the library's chunks follow.
        asked = [e.ids for e in self.library.encode_batch_fast(chunks.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)]
        parts = np.concatenate([ids, *map(np.array, self.stops), np.array(sum(asked, []) if len(asked) < 100 else list(itertools.chain.from_iterable(asked)))]).astype(np.int64)
        sizes = np.concatenate([counts, [len(s) for s in self.stops], np.fromiter(map(len, asked), np.int64, len(asked))]).astype(np.int64)
        n = len(counts)
        first, second = np.empty(len(chunks), np.int64), np.full(len(chunks), -1)
        first[plain], first[~plain] = which, n + 2 + np.arange(len(asked))
        second[plain] = np.where(stop >= 0, n + stop, -1)
        order = np.stack([first, second], 1).ravel()
        order, own = order[order >= 0], np.repeat(np.arange(len(chunks)), 1 + (second >= 0))
        return ragged(parts, sizes, order), np.bincount(own, sizes[order], len(chunks)).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and the number of each text's ids."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        ids, sizes = self._chunks(coded.dictionary)
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        before = np.r_[0, np.cumsum(sizes[which])]
        return ragged(ids, sizes, which).astype(self.kind), np.diff(np.r_[0, before[ends]])


@functools.cache
def word_vocabulary(path: str) -> WordVocabulary:
    """The vocabulary at ``path``, read once by each Python worker."""
    return WordVocabulary(path)


def queued_tokens(df: DataFrame, id_col: str, text_col: str, source_col: str, vocabulary: str, end_id: int, segment: int = SEGMENT) -> DataFrame:
    """(queue, block, cell, at, id, ids): every document's ids and ``end_id`` in a segment of its source's queue.

    A queue is a source, with a mark so that a null source has one of its own. Each task is a block
    and cuts each of its queues into cells of about ``segment`` ids; ``at`` counts the ids before a
    document in its cell. ``id`` is a string; ``ids`` has 2 or 4 bytes for each id.
    """
    names = ["queue", "block", "cell", "at", "id", "ids"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, block = word_vocabulary(vocabulary), TaskContext.get().partitionId()
        filled: dict[str, tuple[int, int]] = {}
        for b in batches:
            for start, stop in slices(b.column(2), SLICE_BYTES):
                part = b.slice(start, stop - start)
                ids, lengths = words.encode(part.column(2))
                ends = np.cumsum(lengths + 1)
                whole = np.empty(ends[-1], ids.dtype)
                last = np.zeros(len(whole), bool)
                last[ends - 1] = True
                whole[last], whole[~last] = end_id, ids
                cells, at = [], []
                for queue, n in zip(part.column(0).to_pylist(), (lengths + 1).tolist(), strict=True):
                    cell, before = filled.get(queue, (0, 0))
                    cells.append(cell)
                    at.append(before)
                    filled[queue] = (cell, before + n) if before + n < segment else (cell + 1, 0)
                offsets = np.r_[0, ends].astype(np.int32) * ids.itemsize
                held = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(whole)])
                columns = [part.column(0), pa.array([block] * len(ends), pa.int32()), pa.array(cells, pa.int32()), pa.array(at, pa.int64()), part.column(1), held]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    queue = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("-"))
    rows = df.select(queue.alias("queue"), F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "queue string, block int, cell int, at long, id string, ids binary")


def with_total_before(df: DataFrame, keys: list[str], span: Column, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows before each one, by ``order`` within ``keys``.

    Spans, which follow the order, are added up apart and then among themselves, so no task sorts all rows of a key.
    """
    rows = df.withColumn("__span", span)
    inner = Window.partitionBy(*keys, "__span").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy(*keys, "__span").agg(F.sum(value).alias("__t"))
    outer = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("__b", F.coalesce(F.sum("__t").over(outer), F.lit(0))).drop("__t")
    inside = F.coalesce(F.sum(value).over(inner), F.lit(0))
    return rows.withColumn("__i", inside).join(spans, [*keys, "__span"]).withColumn(name, F.col("__i") + F.col("__b")).drop("__i", "__b", "__span")


def queue_weights(totals: DataFrame, targets: DataFrame | None) -> DataFrame:
    """(queue, tokens, weight): whole weights from 1, of ``targets`` (source, weight), or else each source's share of all tokens."""
    all_tokens = totals.agg(F.sum("tokens")).first()[0] or 1
    wanted = totals.withColumn("__w", F.col("tokens") / all_tokens)
    if targets is not None:
        given = targets.groupBy(F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("queue")).agg(F.sum("weight").cast("double").alias("__given"))
        wanted = wanted.join(given, "queue", "left").withColumn("__w", F.coalesce("__given", "__w"))
    whole = wanted.agg(F.sum("__w")).first()[0] or 1.0
    return wanted.select("queue", "tokens", F.greatest(F.lit(1), F.round(F.col("__w") / whole * SCALE)).cast("long").alias("weight"))


def _many(df: DataFrame, count: Column, name: str, parts: int) -> DataFrame:
    """Each row once for every number from 0 below ``count``; long stretches of numbers are dealt out first."""
    step = 4096
    far = df.withColumn("__n", count).withColumn("__far", F.explode(F.expr(f"sequence(0L, (__n - 1) div {step})")))
    return far.repartition(parts).withColumn(name, F.explode(F.expr(f"sequence(__far * {step}, least(__n, (__far + 1) * {step}) - 1)"))).drop("__n", "__far")


def dealt_runs(weights: DataFrame, capacity: int, unit: int = UNIT, rounds: int = ROUNDS) -> DataFrame:
    """(queue, first, last, sequence_id, offset): stretches of each queue's ids in the order of a deficit round-robin.

    ``weights`` has queue, tokens and weight. In each round every queue is owed its weight's share of one
    unit and gives the unit once a whole one is owed; the rest is its deficit in the next round. By round k
    a queue of weight w has given floor(k * w / W) units, so a task that starts there knows all
    deficits from the numbers alone. When a queue is empty the others fill its place. Windows are cut
    every ``capacity`` ids, and within one a queue's units stand together; the ids after the last whole
    window fill sequences of falling powers of two.
    """
    units = capacity // unit
    total, whole = weights.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(1))).first()
    spark = weights.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    queues = weights.filter("tokens > 0").withColumn("units", F.expr(f"(tokens + {unit - 1}) div {unit}"))
    # Unit j is given in round ceil(j * W / w); a block has ``rounds`` times as many rounds as a window has units.
    block_of = lambda j: f"((({j}) * {whole}L + {units}L * weight - 1) div ({units}L * weight) - 1) div {rounds}"
    queues = queues.withColumn("blocks", F.expr(block_of("units") + " + 1"))
    dense = _many(queues.filter("blocks < units"), F.col("blocks"), "block", parts)
    given = lambda b: F.expr(f"least(units, ({b}) * {rounds * units}L * weight div {whole}L)")
    dense = dense.withColumn("j0", given("block")).withColumn("j1", given("block + 1"))
    # A queue with fewer units than blocks has a row for each unit instead.
    sparse = _many(queues.filter("blocks >= units"), F.col("units"), "j0", parts).withColumn("j1", F.expr("j0 + 1")).withColumn("block", F.expr(block_of("j1")))
    columns = ["queue", "block", "tokens", "weight", "j0", "j1"]
    parts_of = dense.filter("j1 > j0").select(columns).unionByName(sparse.select(columns))
    n = parts_of.groupBy("block").agg(F.sum(F.expr(f"least(tokens, j1 * {unit}) - j0 * {unit}")).alias("n"))
    starts = with_total_before(n, [], F.expr("block div 4096"), ["block"], "n", "start").drop("n")

    base, tail = total // capacity * capacity, total % capacity
    sizes = [1 << k for k in range(tail.bit_length() - 1, -1, -1) if tail >> k & 1]
    tail_edges = base + np.cumsum([0, *sizes], dtype=np.int64)

    def deal(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["queue", "j0"], ignore_index=True)
        count = (rows["j1"] - rows["j0"]).to_numpy()
        row = np.repeat(np.arange(len(rows)), count)
        j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + rows["j0"].to_numpy()[row]
        name = rows["queue"].ne(rows["queue"].shift()).cumsum().to_numpy()[row]
        w = rows["weight"].to_numpy()[row]
        order = np.lexsort((j, name, ((j + 1) * whole + w - 1) // w))
        row, j, name = row[order], j[order], name[order]
        size = np.minimum(unit, rows["tokens"].to_numpy()[row] - j * unit)
        place = int(rows["start"].min()) + np.cumsum(size) - size
        end = int(place[-1] + size[-1])
        windows = np.arange(place[0] // capacity + 1, (min(end, base) - 1) // capacity + 1) * capacity
        edges = np.unique(np.r_[place, windows, tail_edges[(tail_edges > place[0]) & (tail_edges < end)]])
        own = np.searchsorted(place, edges, "right") - 1
        first, length, name = (j * unit - place)[own] + edges, np.r_[edges[1:], end] - edges, name[own]
        late = edges >= base
        part = np.clip(np.searchsorted(tail_edges, edges, "right") - 1, 0, None)
        sequence = np.where(late, base // capacity + part, edges // capacity)
        offset = np.where(late, edges - tail_edges[part], edges % capacity)
        # Within its window a queue's ids stand together.
        order = np.lexsort((first, name, sequence))
        begins = np.r_[True, sequence[1:] != sequence[:-1]]
        into = np.cumsum(length[order]) - length[order]
        offset = np.repeat(offset[begins] - into[begins], np.diff(np.r_[np.flatnonzero(begins), len(begins)])) + into
        row, first, length, name = row[own][order], first[order], length[order], name[order]
        new = begins | np.r_[True, (name[1:] != name[:-1]) | (first[1:] != first[:-1] + length[:-1])]
        last = (first + length)[np.r_[new[1:], True]]
        return pd.DataFrame({"queue": rows["queue"].to_numpy()[row[new]], "first": first[new], "last": last, "sequence_id": sequence[new], "offset": offset[new]})

    # Neighbouring blocks that are thin, because most queues are empty, are dealt together.
    group = F.expr(f"start div {rounds * capacity}").alias("group")
    return parts_of.join(starts, "block").groupBy(group).applyInPandas(deal, "queue string, first long, last long, sequence_id long, offset long")


def pack_mixture(
    df: DataFrame, id_col: str, text_col: str, source_col: str, vocabulary: str, end_id: int = 1, capacity: int = 2048, targets: DataFrame | None = None, segment: int = SEGMENT
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source): all documents in windows of ``capacity`` ids.

    Every window holds each source in its target proportion, to within ``UNIT`` ids: that of ``targets``
    (source, weight), or that of the source's own ids in ``df``. Sources that ``targets`` leaves out
    weigh their share of all ids; where a source is used up, the others fill the windows. Only the ids after the last
    whole window lie in shorter sequences, whose lengths are powers of two, so nothing is padded.

    Null and empty texts are their end id alone; a null source is a source of its own; null ids and
    repeated rows are packed as they are; an empty table gives an empty result; other columns are not read.
    """
    ids = stored(queued_tokens(df, id_col, text_col, source_col, vocabulary, end_id, segment), "queued")
    width = word_vocabulary(vocabulary).kind.itemsize
    cells = ids.groupBy("queue", "block", "cell").agg(F.sum(F.octet_length("ids") / width).cast("long").alias("n"))
    cells = stored(with_total_before(cells, ["queue"], F.expr("block div 256"), ["block", "cell"], "n", "before"), "cells")
    weights = stored(queue_weights(cells.groupBy("queue").agg(F.sum("n").alias("tokens")), targets), "weights")
    runs = dealt_runs(weights, capacity)

    # Runs and cells of a queue meet in stretches of it; a pair is kept by the stretch in which it begins.
    stretch = 4 * segment
    cells = cells.withColumn("s", F.explode(F.expr(f"sequence(before div {stretch}, (before + n - 1) div {stretch})")))
    runs = runs.withColumn("s", F.explode(F.expr(f"sequence(first div {stretch}, (last - 1) div {stretch})")))
    met = runs.join(cells, ["queue", "s"]).withColumn("a", F.greatest("first", "before")).withColumn("e", F.least(F.col("last"), F.expr("before + n")))
    met = met.filter(f"a < e and a div {stretch} = s").select("queue", "block", "cell", F.expr("a - before").alias("a"), F.expr("e - before").alias("e"), "sequence_id", F.expr("offset + a - first").alias("offset"))

    def cut(docs: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        docs, runs = docs.sort_values("at", ignore_index=True), runs.sort_values("a", ignore_index=True)
        tokens = np.frombuffer(b"".join(docs["ids"]), f"<u{width}").astype("<u4")
        at, a = docs["at"].to_numpy(), runs["a"].to_numpy()
        edges = np.union1d(at, a)
        ends = np.r_[edges[1:], len(tokens)]
        doc, run = np.searchsorted(at, edges, "right") - 1, np.searchsorted(a, edges, "right") - 1
        view = memoryview(tokens.tobytes())
        return pd.DataFrame({
            "id": docs["id"].to_numpy()[doc], "start": edges - at[doc], "length": ends - edges,
            "ids_crc32": [zlib.crc32(view[4 * s : 4 * e]) for s, e in zip(edges.tolist(), ends.tolist(), strict=True)],
            "doc_tokens": np.diff(np.r_[at, len(tokens)])[doc], "sequence_id": runs["sequence_id"].to_numpy()[run],
            "offset": runs["offset"].to_numpy()[run] + edges - a[run], "queue": docs["queue"].iloc[0] if len(docs) else "",
        })

    keys = ["queue", "block", "cell"]
    pieces = ids.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInPandas(cut, "id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string")
    source = F.when(F.col("queue") != "-", F.substring("queue", 2, 1 << 30))
    return pieces.select(F.col("id").cast("long").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", source.alias("source"))

