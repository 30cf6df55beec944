"""Scoring texts with a gated recurrent language model whose output softmax is factored by classes."""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched, chain, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.storage import stored

#: The token that ends every text.
END = b""
#: Frequent words with an output of their own, the end among them, and words in each of their classes.
HEAD, CLASS_WORDS = 1024, 64
#: Classes of the other words: by first letter, other ASCII, all else.
TAIL = 28
HIDDEN = 16
#: Steps of a window; the state goes on from window to window, gradients do not.
WINDOW = 32
#: Bytes of a block of training texts, about; rounds, each over its share of the blocks; weights averaged in one group.
FIT_BYTES, ROUNDS, AVERAGED = 24_000_000, 2, 64
#: Lanes of a step, at least and at most; steps of a block at least, for which small blocks are passed again; first rate of a round.
FEW_LANES, FIT_LANES, LEAST_STEPS, RATES = 16, 512, 500, (0.02, 0.008)
#: Bytes of text that are scored together, about.
BLOCK_BYTES = 24_000_000
LANES = 1024
#: Bytes of text that are split into words together, about; stretches of so many bytes whose words are looked up together.
SPLIT_BYTES, LOOKED_UP = 1_000_000, 8
#: Symbols whose probabilities are made together, so that these stay in a core's cache.
SCORED = 8192

Weights = dict[str, np.ndarray]


def words_of(text: str) -> list[bytes]:
    """Words between white space (blank, tab, LF, VT, FF, CR), A-Z lower-cased."""
    return text.encode("utf-8").lower().split()


def _stretches(texts: pa.Array | pa.ChunkedArray) -> Iterator[pa.Array]:
    """All texts in order, about ``SPLIT_BYTES`` at a time."""
    for own in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        number = np.cumsum(pc.fill_null(pc.binary_length(own), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // SPLIT_BYTES
        for start, end in pairwise([0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(own)]):
            yield own.slice(start, end - start)


def split_stretches(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The words of all texts as ``words_of`` has them, in order, and their number in each text, a stretch of texts at a time.

    What is made on the way takes several times the texts, so it is not made for a whole block at once.
    """
    for own in _stretches(texts):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(own))
        found, text = lists.flatten(), pc.list_parent_indices(lists)
        full = pc.greater(pc.binary_length(found), 0)  # white space at an end leaves an empty word
        yield found.filter(full).cast(pa.binary()), np.bincount(text.filter(full).to_numpy(zero_copy_only=False), minlength=len(own))


def split_words(texts: pa.Array | pa.ChunkedArray) -> tuple[pa.ChunkedArray, np.ndarray]:
    """``split_stretches`` of all texts together."""
    words, sizes = [], [np.empty(0, np.int64)]
    for own, n in split_stretches(texts):
        words.append(own)
        sizes.append(n)
    return pa.chunked_array(words, pa.binary()), np.concatenate(sizes)


def tail_class(first: int) -> int:
    """The class of a word outside the head, by its first byte."""
    return first - 97 if 97 <= first <= 122 else 26 if first < 128 else 27


@dataclass(frozen=True)
class Model:
    """What scoring needs: head words with their counts, totals of the training tokens, tail masses, weights."""

    head: dict[bytes, int]
    tokens: int
    distinct: int
    mass: np.ndarray
    weights: bytes


def _start(rng: np.random.Generator, classes: int) -> Weights:
    draw = lambda *shape: rng.normal(0, 0.15, shape).astype(np.float32)
    return {
        "x": draw(3 * HIDDEN, HEAD + TAIL), "g": draw(2 * HIDDEN, HIDDEN), "c": draw(HIDDEN, HIDDEN),
        "out": draw(classes + TAIL, HIDDEN), "out_b": np.zeros((classes + TAIL, 1), np.float32),
        "word": draw(classes, CLASS_WORDS, HIDDEN), "word_b": np.zeros((classes, CLASS_WORDS, 1), np.float32),
    }


def _softsign(a: np.ndarray, room: np.ndarray) -> None:
    np.abs(a, out=room)
    room += 1
    a /= room


def _window(w: Weights, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, tape: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """States (hidden, time, lanes) before each symbol of x (time, lanes), and the state after the last.

    A lane starts from zero where ``fresh`` holds, which is at each text's first symbol. A ``tape`` takes
    the gates and the candidates (rows, time, lanes).
    """
    before, lanes = np.empty((HIDDEN, *x.shape), np.float32), x.shape[1]
    pre, room, more = (np.empty((k * HIDDEN, lanes), np.float32) for k in (3, 2, 2))
    zr, c, broken = pre[: 2 * HIDDEN], pre[2 * HIDDEN :], fresh.any(axis=1)
    for t in range(len(x)):
        if broken[t]:
            h = h * ~fresh[t]
        before[:, t] = h
        np.take(w["x"], x[t], axis=1, out=pre, mode="clip")
        zr += np.matmul(w["g"], h, out=more)
        _softsign(zr, room)
        zr *= 0.5
        zr += 0.5
        np.multiply(zr[HIDDEN:], h, out=room[:HIDDEN])
        c += np.matmul(w["c"], room[:HIDDEN], out=more[:HIDDEN])
        _softsign(c, room[:HIDDEN])
        if tape is not None:
            tape[0][:, t], tape[1][:, t] = zr, c
        np.subtract(c, h, out=room[:HIDDEN])
        room[:HIDDEN] *= zr[:HIDDEN]
        h = h + room[:HIDDEN]
    return before, h


def _picked(logits: np.ndarray, rows: np.ndarray, share: float | None) -> np.ndarray:
    """Log probability of one row in each column; with ``share``, logits become their gradients times it, else they are spoilt."""
    at = np.arange(logits.shape[1])
    logits -= logits.max(axis=0)
    got = logits[rows, at]
    total = np.exp(logits, out=logits).sum(axis=0)
    if share is not None:
        logits *= np.float32(share) / total
        logits[rows, at] -= np.float32(share)
    return got - np.log(total)


def _log_probability(w: Weights, states: np.ndarray, places: np.ndarray, symbols: np.ndarray, grads: Weights | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probability of each symbol (a tail symbol stands for its class) after the state (hidden, n) at its place.

    With ``grads``, adds the gradients of their negative mean and returns those of the states as well.
    """
    classes, share = len(w["word"]), None if grads is None else 1 / len(symbols)
    label = np.where(symbols < HEAD, symbols // CLASS_WORDS, symbols - HEAD + classes).astype(np.uint8)
    # Symbols of one class lie side by side, so that each class is a slice.
    order = np.argsort(label, kind="stable")
    label, own = label[order], np.take(states, places[order], axis=1, mode="clip")
    logits = w["out"] @ own
    logits += w["out_b"]
    sorted_ = _picked(logits, label, share)
    d_own = np.empty(0)
    if grads is not None:
        grads["out"] += logits @ own.T
        grads["out_b"] += logits.sum(axis=1, keepdims=True)
        d_own = w["out"].T @ logits
    edges = np.searchsorted(label, np.arange(classes + 1))
    inside = symbols[order] % CLASS_WORDS
    for k in np.flatnonzero(np.diff(edges)):
        rows = slice(edges[k], edges[k + 1])
        mine = own[:, rows]
        logits = w["word"][k] @ mine
        logits += w["word_b"][k]
        sorted_[rows] += _picked(logits, inside[rows], share)
        if grads is not None:
            grads["word"][k] += logits @ mine.T
            grads["word_b"][k] += logits.sum(axis=1, keepdims=True)
            d_own[:, rows] += w["word"][k].T @ logits
    got = np.empty(len(symbols))
    got[order] = sorted_
    if grads is None:
        return got, d_own
    back = np.zeros(states.shape[1], np.int64)
    back[places[order]] = np.arange(len(symbols))
    d_states = np.take(d_own, back, axis=1, mode="clip")
    if len(symbols) < states.shape[1]:
        there = np.zeros(states.shape[1], bool)
        there[places] = True
        d_states *= there
    return got, d_states


def _gradients(w: Weights, x: np.ndarray, fresh: np.ndarray, live: np.ndarray, h: np.ndarray) -> tuple[float, Weights, np.ndarray]:
    """Mean loss of one window, its gradients (truncated at its start), and the state after it."""
    zr, c = np.empty((2 * HIDDEN, *x.shape), np.float32), np.empty((HIDDEN, *x.shape), np.float32)
    before, after = _window(w, x, fresh, h, (zr, c))
    g = {k: np.zeros_like(a) for k, a in w.items()}
    flat, states, places = x.ravel(), before.reshape(HIDDEN, -1), np.flatnonzero(live)
    got, d = _log_probability(w, states, places, flat[places], g)
    d_before = d.reshape(before.shape)
    # What a step's gradient is multiplied by on its way to the candidate, and to the gates.
    to_zr = zr - 0.5
    np.abs(to_zr, out=to_zr)
    np.subtract(0.5, to_zr, out=to_zr)
    np.square(to_zr, out=to_zr)
    to_zr *= 2
    to_zr[:HIDDEN] *= c - before
    to_zr[HIDDEN:] *= before
    to_c = np.abs(c, out=c)
    np.subtract(1, to_c, out=to_c)
    np.square(to_c, out=to_c)
    to_c *= zr[:HIDDEN]
    keep, r = 1 - zr[:HIDDEN], zr[HIDDEN:]
    d_pre = np.empty((3 * HIDDEN, *x.shape), np.float32)
    back_c, back_zr, dh, open_ = np.ascontiguousarray(w["c"].T), np.ascontiguousarray(w["g"].T), np.zeros_like(h), ~fresh
    broken = fresh.any(axis=1)
    d_rh, more = np.empty_like(dh), np.empty_like(dh)
    for t in range(len(x) - 1, -1, -1):
        dzr, dc = d_pre[: 2 * HIDDEN, t], d_pre[2 * HIDDEN :, t]
        np.multiply(dh, to_c[:, t], out=dc)
        np.matmul(back_c, dc, out=d_rh)
        np.multiply(dh, to_zr[:HIDDEN, t], out=dzr[:HIDDEN])
        np.multiply(d_rh, to_zr[HIDDEN:, t], out=dzr[HIDDEN:])
        d_rh *= r[:, t]
        dh *= keep[:, t]
        dh += d_rh
        dh += np.matmul(back_zr, dzr, out=more)
        dh += d_before[:, t]
        if broken[t]:
            dh *= open_[t]
    wide = d_pre.reshape(3 * HIDDEN, -1)
    g["g"] += wide[: 2 * HIDDEN] @ states.T
    g["c"] += wide[2 * HIDDEN :] @ (r * before).reshape(HIDDEN, -1).T
    order = np.argsort(flat.astype(np.int16), kind="stable")
    symbols = flat[order]
    first = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
    g["x"][:, symbols[first]] = np.add.reduceat(np.take(wide, order, axis=1, mode="clip"), first, axis=1)
    return float(-got.mean()), g, after


def _lanes(sizes: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts of these sizes, each one's lane and start in it: the longest first, to the emptiest lane."""
    import heapq

    heap = [(0, k) for k in range(lanes)]
    lane, start = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        at, k = heap[0]
        lane[i], start[i] = k, at
        heapq.heapreplace(heap, (at + int(sizes[i]), k))
    return lane, start


def _laid(texts: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols and text numbers of all texts, lane after lane, and each lane's length; the longest lanes come first."""
    sizes = np.array([len(t) for t in texts])
    lane, start = _lanes(sizes, lanes)
    ends = np.zeros(lanes, np.int64)
    np.maximum.at(ends, lane, start + sizes)
    place = np.empty(lanes, np.int64)
    place[np.argsort(-ends, kind="stable")] = np.arange(lanes)
    order = np.lexsort((start, place[lane])).astype(np.int32)
    return np.concatenate([texts[i] for i in order]), np.repeat(order, sizes[order]), -np.sort(-ends)


def _windows(symbols: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(end, symbols, text numbers (-1: none), fresh) of each window as (time, lanes): only lanes that are not over yet take part.

    Windows are made one by one, as lanes filled up to the longest would take several times the texts.
    """
    begin = np.cumsum(ends) - ends
    for s in range(0, int(ends[0]), WINDOW):
        time, lanes = np.arange(s, min(s + WINDOW, int(ends[0])))[:, None], int((ends > s).sum())
        live = time < ends[:lanes]
        at = np.where(live, begin[:lanes] + time, 0)
        own = np.where(live, owner[at], -1)
        last = owner[begin[:lanes] + s - 1] if s else np.full(lanes, -1, own.dtype)
        yield s + len(time), np.where(live, symbols[at], 0), own, own != np.concatenate([last[None], own[:-1]])


def fit_network(texts: list[np.ndarray], seed: int = 11, start: Weights | None = None, top_rate: float = 0.02) -> Weights:
    """Weights fitted to every window of symbol sequences by truncated backpropagation through time, from ``start`` if given.

    Texts lie end to end in lanes. A step is taken once as many symbols have been seen as a full window holds,
    so the ends of long lanes count by their symbols.
    """
    w = {k: a.copy() for k, a in start.items()} if start else _start(np.random.default_rng(seed), HEAD // CLASS_WORDS)
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    total = sum(map(len, texts))
    symbols, owner, ends = _laid(texts, min(len(texts), max(FEW_LANES, min(FIT_LANES, total // (WINDOW * LEAST_STEPS)))))
    full, step = len(ends) * WINDOW, 0
    each = -(-total // full)
    passes = -(-LEAST_STEPS // each)
    for _ in range(passes):
        h, held, seen = np.zeros((HIDDEN, len(ends)), np.float32), None, 0
        for end, x, own, fresh in _windows(symbols, owner, ends):
            live = own >= 0
            _, g, h = _gradients(w, x, fresh, live, h[:, : x.shape[1]])
            n = int(live.sum())
            held, seen = (g if held is None else {k: (held[k] * seen + a * n) / (seen + n) for k, a in g.items()}), seen + n
            if seen < full // 2 and end < ends[0]:
                continue
            step += 1
            # Plain numbers, so that arrays stay of 32 bits.
            norm = math.sqrt(sum(float(np.vdot(a, a)) for a in held.values()))
            rate = top_rate * max(0.1, 1 - 0.9 * step / (passes * each)) * math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, a in held.items():
                a *= min(1.0, 1.0 / (norm + 1e-9))
                m[k] += 0.1 * (a - m[k])
                v[k] += 0.001 * (a * a - v[k])
                w[k] -= rate * m[k] / (np.sqrt(v[k]) + 1e-8)
            held, seen = None, 0
    return w


def network_scores(w: Weights, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each symbol sequence, the state carried from its first symbol to its last."""
    total, longest = sum(map(len, texts)), max(map(len, texts))
    symbols, owner, ends = _laid(texts, int(min(len(texts), LANES, max(32, 4 * total // longest))))
    h, out = np.zeros((HIDDEN, len(ends)), np.float32), np.zeros(len(texts))
    for _, x, own, fresh in _windows(symbols, owner, ends):
        before, h = _window(w, x, fresh, h[:, : x.shape[1]])
        own, x = own.ravel(), x.ravel()
        places = np.flatnonzero(own >= 0)
        for s in range(0, len(places), SCORED):
            at = places[s : s + SCORED]
            got, _ = _log_probability(w, before.reshape(HIDDEN, -1), at, x[at])
            out += np.bincount(own[at], got, len(texts))
    return out


_TAIL_OF = [HEAD + tail_class(b) for b in range(256)]


def _symbol(word: bytes, head: dict[bytes, int]) -> int:
    k = head.get(word)
    return _TAIL_OF[word[0]] if k is None else k


def _symbols(words: pa.Array | pa.ChunkedArray, head: dict[bytes, int]) -> np.ndarray:
    """The symbols of many words; the head's numbers are those of its words in order."""
    known = pc.fill_null(pc.index_in(words, value_set=pa.array(head, pa.binary())), -1).to_numpy()
    # The empty word is in the head, so its place in this table does not matter.
    first = pc.index_in(pc.binary_slice(words, 0, 1), value_set=pa.array([bytes([b]) for b in range(256)], pa.binary()))
    return np.where(known < 0, np.asarray(_TAIL_OF)[pc.fill_null(first, 0).to_numpy()], known).astype(np.int32)


def _with_ends(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all texts' words with ``end`` after each text, and where each text starts."""
    ends = np.cumsum(sizes) + np.arange(len(sizes))
    out, inside = np.full(len(ids) + len(sizes), end, ids.dtype), np.ones(len(ids) + len(sizes), bool)
    inside[ends] = False
    out[inside] = ids
    return out, ends - sizes


def symbols_of(texts: pa.Array | pa.ChunkedArray, head: dict[bytes, int]) -> list[np.ndarray]:
    """The symbols of each text, its end included; the words are not held."""
    got = [(_symbols(words, head), sizes) for words, sizes in split_stretches(texts)]
    symbols, starts = _with_ends(*map(np.concatenate, zip(*got, strict=True)), 0)
    return np.split(symbols, starts[1:])


def word_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(word binary, n) over all rows; the end of each text is the empty word. Null texts are empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = split_words(b.column(0))[0].value_counts()
            word, n = pa.concat_arrays([c.field(0), pa.array([END], pa.binary())]), pa.concat_arrays([c.field(1), pa.array([len(b)], pa.int64())])
            yield pa.RecordBatch.from_arrays([word, n], names=["word", "n"])

    rows = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def train_model(train: DataFrame, counts: DataFrame, id_col: str, text_col: str) -> Model:
    """Head, totals and masses from the counts of all training texts, and weights fitted to all of them.

    Texts are dealt into blocks of about ``FIT_BYTES`` by a hash, and blocks to rounds. In a round each of
    its blocks is fitted on its own from the last round's weights, whole texts and every window, and the
    blocks' weights are averaged by their tokens. Repeated rows are spread over blocks. Without training
    texts weights are untrained.
    """
    tokens, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.filter(F.col("word") != F.lit(END)).orderBy(F.desc("n"), "word").limit(HEAD - 1).collect()
    head = {END: 0} | {bytes(r["word"]): k + 1 for k, r in enumerate(top)}
    mass = np.ones(TAIL)
    first = F.hex(F.substring("word", 1, 1))
    for byte, weight in counts.filter(F.length("word") > 0).groupBy(first).agg(F.sum(F.col("n") + 1)).collect():
        mass[tail_class(int(byte, 16))] += weight
    for r in top:
        mass[tail_class(r["word"][0])] -= r["n"] + 1
    np.savez(held := io.BytesIO(), **_start(np.random.default_rng(11), HEAD // CLASS_WORDS))
    weights = held.getvalue()
    blocks = int((train.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // FIT_BYTES) + 1
    rounds = min(ROUNDS, blocks)
    blocks = -(-blocks // rounds) * rounds
    # The round follows from id and text alone; rows equal in both fall into several blocks of it, by where they are read.
    own_hash = F.xxhash64(F.col(id_col), F.col(text_col))
    dealt = train.select(
        F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.pmod(own_hash, F.lit(rounds)).alias("round"), F.pmod(own_hash + F.spark_partition_id() * rounds, F.lit(blocks)).alias("block")
    )

    def fitting(start: bytes, rate: float) -> object:
        def fit_block(key: tuple, rows: pa.Table) -> pa.Table:
            own = symbols_of(rows["text"].take(pc.sort_indices(rows["text"])), head)
            np.savez(held := io.BytesIO(), **fit_network(own, start=dict(np.load(io.BytesIO(start))), top_rate=rate))
            return pa.table({"part": [key[0].as_py() // AVERAGED], "n": [sum(map(len, own))], "weights": pa.array([held.getvalue()], pa.binary())})

        return fit_block

    def average(rows: pd.DataFrame) -> pd.DataFrame:
        rows, total = rows.sort_values(["n", "weights"]), rows["n"].sum()
        mean: dict[str, np.ndarray] = {}
        for n, raw in zip(rows["n"], rows["weights"], strict=True):
            for k, a in np.load(io.BytesIO(raw)).items():
                mean[k] = mean.get(k, 0) + a.astype(np.float64) * (n / total)
        np.savez(held := io.BytesIO(), **{k: a.astype(np.float32) for k, a in mean.items()})
        return pd.DataFrame({"part": [int(rows["part"].iloc[0]) // AVERAGED], "n": [total], "weights": [held.getvalue()]})

    schema = "part long, n long, weights binary"
    for number in range(rounds):
        own = dealt.filter(F.col("round") == number)
        fitted = stored(own.groupBy("block").applyInArrow(fitting(weights, RATES[min(number, len(RATES) - 1)]), schema), "weights")
        left = blocks
        while left > 1:
            left = -(-left // AVERAGED)
            fitted = stored(fitted.groupBy("part").applyInPandas(average, schema), "weights")
        got = fitted.first()
        weights = bytes(got["weights"]) if got else weights
    return Model(head, int(tokens), int(distinct), mass, weights)


def score_documents(df: DataFrame, id_col: str, text_col: str, counts: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Adds n_tokens, n_known, base_score and score to (id, ``keep`` columns) for every row, over whole texts.

    Texts are dealt into blocks of about ``BLOCK_BYTES`` by a hash; the counts join each block's distinct
    words, so no task holds the vocabulary of the corpus. Null and empty texts are the end token alone;
    a null id or repeated rows are scored like others; an empty table gives an empty result.
    """
    keep = keep or []
    size = df.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    blocks = int(size // BLOCK_BYTES) + 1
    block = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)) if id_col else F.xxhash64(text_col), F.lit(blocks))
    rows = df.select(F.col(id_col).alias("id"), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("text"), block.alias("block"))

    def vocabulary(key: tuple, part: pa.Table) -> pa.Table:
        distinct = pa.chunked_array([words.unique() for words, _ in split_stretches(part["text"])], pa.binary()).unique()
        seen = pa.concat_arrays([distinct, pa.array([END], pa.binary())])
        return pa.table({"block": pa.repeat(key[0], len(seen)), "word": seen})

    def score(part: pa.Table, known: pa.Table) -> pa.Table:
        w = dict(np.load(io.BytesIO(model.weights)))
        place = known["word"].combine_chunks()
        n = known["n"].to_numpy().astype(np.float64)
        symbol = _symbols(known["word"], model.head)
        base = np.log10(n + 1)
        tail = np.where(symbol >= HEAD, base - np.log10(model.mass[np.maximum(symbol - HEAD, 0)]), 0.0)
        bottom = np.log10(model.tokens + model.distinct + 1)
        symbols, figures = [], []
        for some in batched(split_stretches(part["text"]), LOOKED_UP):
            words, sizes = zip(*some, strict=True)
            sizes = np.concatenate(sizes)
            ids = pc.index_in(pa.chunked_array(words, pa.binary()), value_set=place).to_numpy()
            ids, starts = _with_ends(ids, sizes, place.index(END).as_py())
            symbols.append(np.split(symbol[ids], starts[1:]))
            figures.append((sizes + 1, *(np.add.reduceat(a[ids], starts) for a in ((n > 0).astype(np.int64), base, tail))))
        del words, ids  # the network's arrays take their place
        n_tokens, n_known, base_sums, tail_sums = map(np.concatenate, zip(*figures, strict=True))
        network = network_scores(w, list(chain.from_iterable(symbols))) / np.log(10)
        got = part.drop_columns(["text", "block"])
        for name, value in (("n_tokens", n_tokens), ("n_known", n_known), ("base_score", base_sums - n_tokens * bottom), ("score", tail_sums + network)):
            got = got.append_column(name, pa.array(value))
        return got

    words = rows.groupBy("block").applyInArrow(vocabulary, "block long, word binary")
    known = words.join(counts, "word", "left").select("block", "word", F.coalesce("n", F.lit(0)).alias("n"))
    schema = df.select(F.col(id_col).alias("id"), *keep).schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double")):
        schema.add(name, kind)
    return rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, schema).withColumnRenamed("id", id_col)


def lm_scores(df: DataFrame, id_col: str, text_col: str, folds: int = 7, fold: int = 2) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Texts whose crc32 of the id as text leaves ``fold`` modulo ``folds`` are held out; the counts and
    the network learn from all others (a null id counts among these). Log probabilities are decimal.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), held.alias("held_out"))
    train = rows.filter(~F.col("held_out"))
    counts = stored(word_counts(train, "text"), "words")
    model = train_model(train, counts, "id", "text")
    return score_documents(rows, "id", "text", counts, model, ["held_out"]).select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
