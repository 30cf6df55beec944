"""Mixture packing, Merkle manifests and ranked search against plain versions, with nulls, ties, repeated rows, long texts and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stratafold.llm import langid, lexical, merkle, mixture, packing, queries, tokens, topk

WORDS = ["the", "of", "Thand", "érable", "ét", "x1,", "don't", "\n", "  ", "<|endoftext|>", "naïve.", "123", "😀", "\t", "ΣΑΣ", " "]
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, queue string, at long, tree string, block string, term string, score long"


def table(spark, n=120, sources=4, more=()):
    rnd = random.Random(n)
    texts = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(90))) for _ in range(n)]
    rows = [(k, t, None if k % 11 == 0 else f"s{k % sources if k % 3 else 0}", "en", len(t or "")) for k, t in enumerate([*texts, None, "", "a" * 20_000, "word " * 6000, texts[3], *more])]
    rows += [rows[3], rows[3], (None, "null id The", "s1", None, None), (None, None, None, None, None)]
    rows = [(*r, "q", 7, "t", "b", "x", 1) for r in rows]
    return spark.createDataFrame(rows, SCHEMA), rows


def check_packing(got, rows, capacity):
    lib = Tokenizer.from_file(queries.WORD_BPE)
    want = Counter((r[0], r[2], tuple([*lib.encode(r[1] or "", add_special_tokens=False).ids, 1])) for r in rows)
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"], r["source"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
        by_bin[r["sequence_id"]].append((r["offset"], r["length"]))
    for (doc, source, ids), copies in want.items():
        crc = lambda s, n: zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())  # noqa: B023, E731
        own = [p for p in by_doc[doc, source, len(ids)] if crc(p[0], p[1]) == p[2]]
        covered = Counter(k for s, n, _ in own for k in range(s, s + n))
        assert all(covered[k] >= copies for k in range(len(ids)))
    assert sum(r["length"] for r in got) == sum(len(ids) * c for (_, _, ids), c in want.items())
    lengths = {}
    for seq, parts in by_bin.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        lengths[seq] = at
    short = [n for n in lengths.values() if n != capacity]
    assert all(n & (n - 1) == 0 and n < capacity for n in short) and len(short) == len(set(short))


def test_mixture_packing_keeps_every_id_without_padding(spark):
    df, rows = table(spark)
    check_packing(mixture.pack_mixture(df, "doc_id", "text", "source", queries.WORD_BPE, segment=500).collect(), rows, 2048)
    check_packing(mixture.pack_mixture(df, "doc_id", "text", "source", queries.WORD_BPE, capacity=256).collect(), rows, 256)
    assert mixture.pack_mixture(df.filter("1 = 0"), "doc_id", "text", "source", queries.WORD_BPE).count() == 0


def test_windows_hold_the_targets_until_a_source_is_used_up(spark):
    rows = [(k, "one two three four " * 60, "a" if k < 300 else "b" if k < 400 else "c") for k in range(430)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5), ("b", 0.25), ("c", 0.25)], "source string, weight double")
    got = mixture.pack_mixture(df, "doc_id", "text", "source", queries.WORD_BPE, targets=targets).toPandas()
    held = got.groupby(["sequence_id", "source"])["length"].sum().unstack().fillna(0).sort_index()
    used_up = held.index[held["c"] > 0].max()
    early = held[held.index < used_up]
    assert len(early) >= 10 and (abs(early["a"] - 1024) <= 64).all() and (abs(early["b"] - 512) <= 64).all() and (abs(early["c"] - 512) <= 64).all()
    # Afterwards a and b share the windows two to one.
    later = held[(held.index > used_up + 1) & (held["b"] > 0)].iloc[:-2]
    assert (abs(later["a"] - 2 * later["b"]) <= 3 * 64).all()


def test_blocks_of_rounds_carry_their_deficits(spark):
    weights = spark.createDataFrame([("a", 70_000, 700_000), ("b", 20_011, 299_999), ("c", 130, 1), ("d", 64, 50)], "queue string, tokens long, weight long")
    one = {tuple(r) for r in mixture.dealt_runs(weights, 2048, rounds=1 << 20).collect()}
    many = mixture.dealt_runs(weights, 2048, rounds=3).collect()
    place = lambda runs: sorted((q, t, s) for q, f, e, s, o in runs for t in range(f, e) if s < 44)
    assert place(one) == place(many) and len(place(one)) == 44 * 2048


def test_chunks_of_a_vocabulary_across_spaces_are_refused():
    with pytest.raises(ValueError, match="across spaces"):
        mixture.WordVocabulary(queries.BPE)


def plain_manifest(rows):
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    sized = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    small = str.maketrans(queries.lexical.UPPER, queries.lexical.LOWER)

    def levels(nodes):
        made = [nodes]
        while len(made[-1]) > 1:
            made.append([h(*made[-1][k : k + 16]) for k in range(0, len(made[-1]), 16)])
        return made

    def climb(made, at, node):
        proof = []
        for level in made[:-1]:
            run = at - at % 16
            proof += level[run:at] + level[at + 1 : run + 16]
            node = h(*level[run:at], node, *level[at + 1 : run + 16])
            at //= 16
        return proof, node

    by_source = defaultdict(list)
    for doc, text, source, lang, n in rows:
        leaf = lambda t: h(*map(sized, (doc, source, lang, n, t)))  # noqa: B023, E731
        tampered = doc is not None and text is not None and zlib.crc32(str(doc).encode()) % 5 == 0
        by_source[source].append((doc, leaf(text), leaf(text.translate(small)) if tampered else leaf(text)))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = levels([r[1] for r in by_source[s]])
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for at, (doc, leaf, changed) in enumerate(by_source[s]):
            near, node = climb(trees[s], at, changed)
            far, node = climb(top, k, node)
            out.append((doc, leaf, trees[s][-1][0], top[-1][0], h(*near, *far), node, node == top[-1][0]))
    return Counter(out)


@pytest.mark.parametrize("case", ["mixed", "deep", "one", "same source"])
def test_merkle_manifest_equals_a_plain_tree(spark, case):
    df, rows = table(spark, more=["Capital"] * 20)
    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in rows]
    if case == "deep":  # two stored levels: one source of 4,097 leaves, one of 4,096, and 40 of few
        rows = [(k, f"T{k}", "hot" if k < 4097 else "even" if k < 8193 else f"s{k % 40}", "en", 2) for k in range(8260)]
    elif case == "one":
        rows = rows[:1]
    elif case == "same source":
        rows = [(*r[:2], "s", *r[3:]) for r in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").withColumn("tree", F.lit("x")).withColumn("at", F.lit(3)).withColumn("leaf", F.lit("x"))
    tamper = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = merkle.dataset_manifest(df, "doc_id", "source", ["lang", "n_chars"], "text", tamper).collect()
    assert Counter(map(tuple, got)) == plain_manifest(rows)
    if case == "mixed":
        assert {r["verified"] for r in got} == {True, False}
        assert merkle.dataset_manifest(df.filter("1 = 0"), "doc_id", "source", ["lang", "n_chars"], "text", tamper).count() == 0


def plain_search(rows, items, k):
    small = str.maketrans(lexical.UPPER, lexical.LOWER)
    find = lambda t: re.findall(lexical.TERM, (t or "").translate(small))
    held = [(r[0], Counter(find(r[1]))) for r in rows]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n, words, df = len(held), sum(x for _, _, x in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for doc, c, length in held:
            m = 100 - 50 + (50 * length * n) // words
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(find(text)) if t in c)
            if s > 0:
                scores.append((-s, doc is not None, doc or 0, doc))
        out += [(item, rank + 1, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scores)[:k])]
    return Counter(out)


def test_ranked_search_equals_plain_scores(spark, monkeypatch):
    rnd = random.Random(4)
    vocabulary = [f"w{int(rnd.paretovariate(0.6))}" for _ in range(4000)] + ["Ärger", "éa", "A-b", "日本"]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 80))) for _ in range(500)]
    rows = [*enumerate([*texts, None, "", " - ", "w2 " * 5000, texts[5], texts[5]]), (5, texts[5]), (5, texts[5]), (None, texts[5]), (None, None)]
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(12))) for k in range(30)] + [(30, texts[5]), (30, texts[5]), (30, "w1"), (31, None), (32, ""), (33, "absent words"), (None, "W2 w3"), (35, "w1 " * 300)]
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("x")).withColumn("term", F.lit("x"))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("group", F.lit(1)).withColumn("item", F.lit(1))
    got = lexical.ranked_search(df, "doc_id", "text", asked, "item_id", "text", 10).collect()
    assert Counter(map(tuple, got)) == plain_search(rows, items, 10)
    assert lexical.ranked_search(df.filter("1 = 0"), "doc_id", "text", asked, "item_id", "text").count() == 0
    assert lexical.ranked_search(df, "doc_id", "text", asked.filter("1 = 0"), "item_id", "text").count() == 0


def test_accumulators_are_limited_and_results_whole():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n, k = 300, int(rng.integers(1, 9))
        lists = sorted((np.sort(rng.choice(n, int(rng.integers(1, 250)), replace=False)) for _ in range(6)), key=len)
        gains = [rng.integers(0, 40 // (1 + t), len(d)) for t, d in enumerate(lists)]
        ids = rng.permutation(n)
        whole = np.zeros(n, np.int64)
        for d, g in zip(lists, gains, strict=True):
            np.add.at(whole, d, g)
        want = sorted((-whole[d], ids[d], d) for d in range(n) if whole[d] > 0)[:k]
        best, score = lexical.best_of_block(lists, gains, n, ids, k)
        assert [(-s, ids[d], d) for d, s in zip(best, score, strict=True)] == want


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_TEXTS", 30)
    monkeypatch.setattr(langid, "STEPS", 2)
    rows = [(k, f"word{k % 40} text", f"l{k % 40:02d}") for k in range(80)]
    languages, _ = langid.train_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    assert languages == [f"l{k:02d}" for k in range(40)]


def test_packing_groups_count_pieces(spark):
    # Four documents of many pieces, without ids and equal: the groups hold pieces, not documents.
    df = spark.createDataFrame([(None, "word other " * 3000)] * 4, "doc_id long, text string")
    got = packing.pack_documents(df, "doc_id", "text", queries.BPE, capacity=64, group_pieces=2).collect()
    full = [r for r in got if r["length"] == 64]
    part = [r for r in got if r["length"] < 64]
    assert len({r["sequence_id"] for r in full}) == len(full) > 100 and all(r["offset"] == 0 for r in full)
    assert len(part) == 4 and len({r["sequence_id"] for r in part} & {r["sequence_id"] for r in full}) == 0
    assert Counter(r["piece"] for r in got) == dict.fromkeys(range(max(r["piece"] for r in got) + 1), 4)


def test_arrow_ids_equal_the_plain_way():
    rnd = random.Random(1)
    words = [*WORDS, "'s", "é.", "Ⅻ", "ª", " a", "a,.", "日本", "", ".", ","]
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", " ", "", "\n"]) for _ in range(rnd.randrange(12))) for _ in range(1500)]
    bpe = tokens.ByteBpe(queries.BPE)
    for group in (texts, [t for t in texts if "<|" not in t], [], [""], ["", " ", "x" * 5000 + " " * 9]):
        for start, stop in tokens.slices(pa.array(group, pa.string()), 4000):
            ids, n = bpe.encode_arrow(pa.array(group, pa.string()).slice(start, stop - start))
            want = list(bpe.encode(group[start:stop]))
            assert b"".join(want) == ids.tobytes() and [len(x) // 4 for x in want] == n.tolist()


def test_a_vector_common_to_most_rows(spark):
    rows = [(k, [0.5, 0.25]) for k in range(3000, 0, -1)] + [(k, [0.5, k / 5000]) for k in range(3001, 3200)] + [(7, [0.5, 0.25])] * 20
    got = topk.top_inner_products(spark.createDataFrame(rows, "v long, ids array<double>"), "v", "ids", F.col("id") % 1000 == 0, 4).collect()
    scores = {k: np.floor(np.array(x) * 1024) for k, x in rows}
    for q in (1000, 2000, 3000):
        best = sorted((-int(scores[q] @ scores[k]), k) for k in scores if k != q)[:4]
        assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [(k, -s) for s, k in best]
