"""Near-duplicate documents: b-bit MinHash signatures joined by a multi-index over their chunks."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratafold.llm.components import components, without_repeats
from stratafold.llm.storage import stored
from stratafold.llm.urls import maybe_listed

#: A signature: chunks of 16-bit minima. A chunk may hold one error, so signatures that differ in at
#: most 2 * CHUNKS - 1 places have a chunk with one error at most, and share a key.
CHUNKS, CHUNK_VALUES = 12, 7
VALUES = CHUNKS * CHUNK_VALUES
#: Candidates whose signatures agree in fewer places are not compared on full sets: at a similarity of
#: 0.8 the agreement is below this five standard deviations from its mean.
LEAST_AGREEMENT = 49
#: Members that are compared with their leader in one task's group.
GROUP_MEMBERS = 256
#: Distinct words whose hashes a Python worker keeps.
TABLE_ENTRIES = 250_000


@functools.cache
def _word_hashes() -> dict[bytes, int]:
    return {}


@functools.cache
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    draw = lambda: rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)
    return draw() | np.uint64(1), draw()


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``width`` words; all words as one if there are fewer."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    table = _word_hashes()
    if len(table) > TABLE_ENTRIES:
        table.clear()
    hashes = list(map(table.get, words))
    if None in hashes:
        for i, h in enumerate(hashes):
            if h is None:
                hashes[i] = table[words[i]] = xxhash.xxh64_intdigest(words[i])
    h = np.array(hashes, np.uint64)
    span = min(width, len(h))
    out = np.full(len(h) - span + 1, span, np.uint64)
    for k in range(span):
        out = (out ^ h[k : len(h) - span + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """``VALUES`` minima, 16 bits of each."""
    mul, add = _multipliers()
    out = np.empty(VALUES, np.uint16)
    for s in range(0, VALUES, CHUNK_VALUES):
        rows = slice(s, s + CHUNK_VALUES)
        mixed = shingles[None, :] * mul[rows, None] + add[rows, None]
        low = mixed.min(axis=1)
        low ^= low >> np.uint64(31)
        out[rows] = (low * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)
    return out


def signatures(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n_shingles, content binary, signature binary) of every row; both binaries null for empty sets."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                s = shingle_set(text, width)
                rows.append((len(s), xxhash.xxh128_digest(s.tobytes()), signature(s).astype("<u2").tobytes()) if len(s) else (0, None, None))
            n, content, sig = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(content, pa.binary()), pa.array(sig, pa.binary())],
                names=["id", "n_shingles", "content", "signature"],
            )

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(sign, "id long, n_shingles long, content binary, signature binary")


def chunk_keys(classes: DataFrame) -> DataFrame:
    """(key, id): for each chunk, every way to leave one of its values out."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.array([[c * CHUNK_VALUES + k for k in range(CHUNK_VALUES) if k != gone] for c in range(CHUNKS) for gone in range(CHUNK_VALUES)])
        for b in batches:
            if not len(b):
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u2").reshape(-1, VALUES).astype(np.uint64)
            key = np.broadcast_to(np.arange(len(kept), dtype=np.uint64) + np.uint64(1), (len(sig), len(kept))).copy()
            for k in range(kept.shape[1]):
                key = (key ^ sig[:, kept[:, k]]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(32)
            ids = np.repeat(np.asarray(b.column(0)), len(kept))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), pa.array(ids)], names=["key", "id"])

    return classes.select("id", "signature").mapInArrow(keys, "key long, id long")


def _agreement(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``pairs`` (a, b) whose signatures agree in ``LEAST_AGREEMENT`` places at least."""
    one = classes.select(F.col("id").alias("a"), F.col("signature").alias("sig_a"))
    other = classes.select(F.col("id").alias("b"), F.col("signature").alias("sig_b"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u2").reshape(-1, VALUES) for k in (2, 3))
            yield b.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= LEAST_AGREEMENT))

    return pairs.join(one, "a").join(other, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(near, "a long, b long")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``pairs`` (a, b) with 100 * intersection >= percent * union of their full shingle sets.

    A pair's first text travels to its second one. Second ones with many firsts are dealt into groups
    of about ``GROUP_MEMBERS``, each with a copy of the second text.
    """
    many = pairs.groupBy("b").agg((F.count("*") / GROUP_MEMBERS).cast("long").alias("extra"))
    dealt = pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("extra") + 1).alias("part"))
    leaders = many.select(F.col("b").alias("id"), "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("extra"))).alias("part"))
    wanted = dealt.select(F.col("a").alias("id"), "b", "part").unionByName(leaders)

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sets = {i: shingle_set(t, width) for i, t in zip(rows["id"], rows["text"], strict=True)}
        lead = sets.pop(key[0])
        found = []
        for i, s in sets.items():
            both = len(np.intersect1d(s, lead, assume_unique=True))
            if 100 * both >= percent * (len(s) + len(lead) - both):
                found.append(i)
        return pd.DataFrame({"a": pd.Series(found, dtype="int64"), "b": key[0]})

    return wanted.join(texts, "id").groupBy("b", "part").applyInPandas(compare, "a long, b long")


def linked_to_anchors(anchored: DataFrame, members: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between ``anchored`` (id, anchor) and ``members`` (id, component) of the component that is the anchor.

    Both sides of an anchor are dealt into blocks of about ``GROUP_MEMBERS``, and each block of one side
    meets each of the other. Signatures meet first; only documents near one of the other side bring their
    texts. A document needs one link to a component, so a block gives one at most.
    """
    sides = []
    for side, key in ((anchored.select("id", "anchor"), "x"), (members.select("id", F.col("component").alias("anchor")), "m")):
        size = side.groupBy("anchor").agg((F.count("*") / GROUP_MEMBERS + 1).cast("long").alias(f"{key}_blocks"))
        sides.append((side, size))
    (x, x_size), (m, m_size) = sides
    sizes = stored(x_size.join(m_size, "anchor"), "sizes")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    x = x.join(sizes, "anchor").select("id", "anchor", F.lit(True).alias("open"), block("x_blocks").alias("xb"), every("m_blocks").alias("mb"))
    m = m.join(sizes, "anchor").select("id", "anchor", F.lit(False).alias("open"), every("x_blocks").alias("xb"), block("m_blocks").alias("mb"))

    def near(rows: pd.DataFrame) -> pd.DataFrame:
        sign = np.frombuffer(b"".join(rows["signature"]), "<u2").reshape(-1, VALUES)
        open_ = rows["open"].to_numpy(bool)
        hit = np.zeros(len(rows), bool)
        inside = np.flatnonzero(~open_)
        for i in np.flatnonzero(open_):
            agree = inside[(sign[inside] == sign[i]).sum(axis=1) >= LEAST_AGREEMENT]
            hit[agree] = True
            hit[i] = len(agree) > 0
        return rows.loc[hit, ["id", "anchor", "open", "xb", "mb"]]

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [shingle_set(t, width) for t in rows["text"]]
        sign = np.stack([signature(s) for s in sets])
        ids, open_ = rows["id"].to_numpy(), rows["open"].to_numpy(bool)
        inside, found = np.flatnonzero(~open_), []
        for i in np.flatnonzero(open_):
            agree = (sign[inside] == sign[i]).sum(axis=1)
            order = np.argsort(-agree, kind="stable")
            for j in inside[order[: int((agree >= LEAST_AGREEMENT).sum())]]:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    found.append((ids[i], ids[j]))
                    break
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    places = ["anchor", "xb", "mb"]
    met = x.unionByName(m).join(classes.select("id", "signature"), "id").groupBy(*places).applyInPandas(near, "id long, anchor long, open boolean, xb long, mb long")
    return stored(met, "anchored").join(texts, "id").groupBy(*places).applyInPandas(compare, "a long, b long")


def linked_across(members: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between ``members`` (key, id, component) of one key and several components.

    The members of a key are dealt into blocks of about ``GROUP_MEMBERS``, and each two blocks meet in
    one group, where arrays hold all pairs. Signatures meet first; only members near one of another
    component bring their texts. Links that join nothing new in a group are left out.
    """
    several = members.groupBy("key").agg((F.count("*") / GROUP_MEMBERS + 1).cast("long").alias("blocks"), F.min("component").alias("low"), F.max("component").alias("high"))
    members = members.join(several.filter("low < high").select("key", "blocks"), "key")
    rows = without_repeats(stored(members, "across"), "key").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    place = F.concat_ws("/", F.col("key").cast("string"), F.least("block", "other").cast("string"), F.greatest("block", "other").cast("string"))
    rows = rows.select(place.alias("place"), "id", "component", "block").join(classes.select("id", "signature"), "id")

    def apart(rows: pd.DataFrame) -> np.ndarray:
        component, block = rows["component"].to_numpy(), rows["block"].to_numpy()
        one = (block == block[0]).all()
        return (component[:, None] != component) & (one | (block[:, None] != block))

    def near(rows: pd.DataFrame) -> pd.DataFrame:
        sign, open_ = np.frombuffer(b"".join(rows["signature"]), "<u2").reshape(-1, VALUES), apart(rows)
        hit = [bool((open_[i] & ((sign == sign[i]).sum(axis=1) >= LEAST_AGREEMENT)).any()) for i in range(len(rows))]
        return rows.loc[hit, ["place", "id", "component", "block"]]

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        sets = [shingle_set(t, width) for t in rows["text"]]
        sign, open_ = np.stack([signature(s) for s in sets]), apart(rows)
        ids, label, found = rows["id"].to_numpy(), rows["component"].to_numpy().copy(), []
        for i in range(len(ids)):
            agree = (sign[:i] == sign[i]).sum(axis=1) >= LEAST_AGREEMENT
            for j in np.flatnonzero(agree & open_[i, :i]):
                if label[i] == label[j]:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    found.append((ids[i], ids[j]))
                    label[label == label[j]] = label[i]
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    rows = stored(rows.groupBy("place").applyInPandas(near, "place string, id long, component long, block long"), "across_near")
    return without_repeats(rows, "place").join(texts, "id").groupBy("place").applyInPandas(compare, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row.

    Rows with equal shingle sets form classes first. Class representatives that share a chunk key with
    one value left out are candidates. In each bucket all are compared with its smallest id on full
    sets. In buckets whose members are then still in several components, members outside the largest
    one are searched against all of it in blocks, and then against each other in blocks. So a bucket of
    copies costs one comparison each, and no pair of a bucket stays open unless it is in one component.

    Null, empty and wordless texts are linked with nothing and kept. A row with
    a null id takes the component of its set, if any has an id; of rows that share an id but not a text
    any may decide; other columns are not read; an empty table
    gives an empty result.
    """
    signed = stored(signatures(df, id_col, text_col, width), "signatures")
    filled = signed.filter("content is not null and id is not null")
    classes = stored(filled.groupBy("content").agg(F.min("id").alias("id"), F.first("signature").alias("signature"), F.count("*").alias("copies")), "classes")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bucket = Window.partitionBy("key")
    shared = chunk_keys(classes).withColumn("lead", F.min("id").over(bucket)).withColumn("last", F.max("id").over(bucket))
    shared = stored(shared.filter(F.col("lead") < F.col("last")).select("key", "id", "lead"), "buckets")
    # Texts of documents that no bucket joins with another are not moved, but for the few that pass the filter.
    met = stored(shared.select("id").distinct(), "met")
    texts = stored(texts.filter(maybe_listed(met.select(F.col("id").alias("key")), "id")).join(met, "id", "left_semi"), "texts")
    first = shared.filter("id <> lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct()
    first = stored(_agreement(first, classes), "candidates")
    links = stored(confirmed(first, texts, width, percent), "links")
    joined = components(links)

    labelled = shared.join(joined, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    several = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    open_ = stored(labelled.join(several, "key", "left_semi"), "open")
    # The component with most members in a bucket is its anchor; the others are held against it in blocks.
    share = open_.groupBy("key", "component").agg(F.count("*").alias("n"))
    anchor = share.groupBy("key").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("anchor"))
    outside = stored(open_.join(anchor, "key").filter("component <> anchor"), "outside")
    anchored = outside.select("id", "anchor").distinct()
    more = stored(linked_to_anchors(anchored, open_.select("id", "component").distinct(), classes, texts, width, percent), "links")
    if not more.isEmpty():
        links = links.union(more)
        joined = components(links)
        outside = outside.drop("component").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    more = stored(linked_across(outside.select("key", "id", "component"), classes, texts, width, percent), "links")
    if not more.isEmpty():
        joined = components(links.union(more))

    label = classes.select("content", "id").join(joined, "id", "left").select("content", F.coalesce("component", "id").alias("component_id"))
    out = signed.select("id", "n_shingles", "content").join(label, "content", "left")
    out = out.select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id_col)
