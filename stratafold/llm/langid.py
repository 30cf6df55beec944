"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: Bytes that one window labels, and bytes on each side of these that it reads as well.
WINDOW, CONTEXT = 64, 16
SPAN = WINDOW + 2 * CONTEXT
#: Hidden units of each direction.
HIDDEN = 8
#: Windows that are labelled at once.
LANES = 2048
#: Texts of each language that the network is fitted on, about, and windows taken from each text.
TEXTS_PER_LANGUAGE, WINDOWS_PER_TEXT = 600, 8
#: Labelled texts in the one task that fits, about: beyond 200 languages each has fewer texts, and none is left out.
MOST_TEXTS = 120_000
#: Optimiser steps and windows in each.
STEPS, BATCH = 500, 128
#: Bytes of text that a task holds as windows at once.
SLICE_BYTES = 4_000_000
UNDETERMINED = "und"

Weights = dict[str, np.ndarray]


def _start(languages: int, rng: np.random.Generator) -> Weights:
    draw = lambda *shape: rng.normal(0, 0.2, shape).astype(np.float32)
    w = {f"{d}{n}": draw(*s) for d in "fb" for n, s in (("x", (3 * HIDDEN, 256)), ("g", (2 * HIDDEN, HIDDEN)), ("c", (HIDDEN, HIDDEN)))}
    return w | {"out": draw(languages, 2 * HIDDEN), "bias": np.zeros((languages, 1), np.float32)}


def _softsign(a: np.ndarray) -> None:
    """a / (1 + |a|) in place: the squashing function of gates (then moved to 0..1) and of candidates."""
    a /= np.abs(a) + 1


def _states(w: Weights, d: str, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States (time, hidden, lanes) of one direction over bytes (time, lanes); padding holds the state at zero."""
    steps, lanes = x.shape
    order = range(steps) if d == "f" else range(steps - 1, -1, -1)
    full = mask.all(axis=1)
    h = np.zeros((HIDDEN, lanes), np.float32)
    out = np.empty((steps, HIDDEN, lanes), np.float32)
    pre = np.empty((3 * HIDDEN, lanes), np.float32)
    rh, tape = np.empty_like(h), []
    for t in order:
        np.take(w[d + "x"], x[t], axis=1, out=pre, mode="clip")
        zr, c = pre[: 2 * HIDDEN], pre[2 * HIDDEN :]
        zr += w[d + "g"] @ h
        _softsign(zr)
        zr *= 0.5
        zr += 0.5
        z, r = zr[:HIDDEN], zr[HIDDEN:]
        np.multiply(r, h, out=rh)
        c += w[d + "c"] @ rh
        _softsign(c)
        if keep:
            tape.append((t, z.copy(), r.copy(), c.copy(), h))
        new = out[t]
        np.subtract(c, h, out=new)
        new *= z
        new += h
        if not full[t]:
            new *= mask[t]
        h = new
    return out, tape


def _logits(w: Weights, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    f, b = (_states(w, d, x, mask)[0] for d in "fb")
    return w["out"][:, :HIDDEN] @ f + w["out"][:, HIDDEN:] @ b + w["bias"]


def position_probabilities(w: Weights, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Probabilities (time, language, lanes) at every position; zero at padding."""
    p = _logits(w, x, mask)
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    p *= mask[:, None, :]
    return p


def _gradients(w: Weights, x: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, Weights]:
    """Mean cross entropy over positions and its gradients, by backpropagation through time."""
    runs = {d: _states(w, d, x, mask, keep=True) for d in "fb"}
    both = np.concatenate([runs["f"][0], runs["b"][0]], axis=1)
    p = w["out"] @ both + w["bias"]
    p -= p.max(axis=1, keepdims=True)
    p = np.exp(p)
    p /= p.sum(axis=1, keepdims=True)
    lanes = np.arange(x.shape[1])
    count = max(1.0, float(mask.sum()))
    loss = float(-(np.log(p[:, label, lanes] + 1e-9) * mask).sum() / count)
    p[:, label, lanes] -= 1
    p *= mask[:, None, :] / count
    g: Weights = {"out": np.einsum("tln,thn->lh", p, both), "bias": p.sum(axis=(0, 2))[:, None]}
    d_both = w["out"].T @ p
    for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
        g[d + "g"], g[d + "c"] = np.zeros_like(w[d + "g"]), np.zeros_like(w[d + "c"])
        d_pre = np.zeros((3 * HIDDEN, *x.shape), np.float32)
        dh = np.zeros((HIDDEN, x.shape[1]), np.float32)
        for t, z, r, c, h in reversed(runs[d][1]):
            dh = (dh + d_both[t, part]) * mask[t]
            dc = dh * z * (1 - np.abs(c)) ** 2
            d_rh = w[d + "c"].T @ dc
            slope = [0.5 * (1 - np.abs(2 * gate - 1)) ** 2 for gate in (z, r)]
            dzr = np.concatenate([dh * (c - h) * slope[0], d_rh * h * slope[1]])
            g[d + "g"] += dzr @ h.T
            g[d + "c"] += dc @ (r * h).T
            d_pre[: 2 * HIDDEN, t], d_pre[2 * HIDDEN :, t] = dzr, dc
            dh = dh * (1 - z) + d_rh * r + w[d + "g"].T @ dzr
        flat = x.ravel()
        g[d + "x"] = np.stack([np.bincount(flat, row, 256) for row in d_pre.reshape(3 * HIDDEN, -1)]).astype(np.float32)
    return loss, g


def fit_network(windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, languages: int, seed: int = 7) -> Weights:
    """Weights fitted to byte windows (rows, SPAN) with their lengths and language numbers."""
    rng = np.random.default_rng(seed)
    w = _start(languages, rng)
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    by_label = [np.flatnonzero(labels == k) for k in range(languages)]  # a label without windows would have no text at all
    for step in range(1, STEPS + 1):
        label = rng.integers(0, languages, BATCH)
        rows = np.array([rng.choice(by_label[k]) for k in label])
        mask = (np.arange(SPAN)[:, None] < lengths[rows]).astype(np.float32)
        _, g = _gradients(w, windows[rows].T, mask, label)
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        rate = 0.02 * min(1.0, 2 * (1 - (step - 1) / STEPS)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for k, a in g.items():
            a = a * min(1.0, 1.0 / (norm + 1e-9))
            m[k] += 0.1 * (a - m[k])
            v[k] += 0.001 * (a * a - v[k])
            w[k] = (w[k] - rate * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
    return w


def to_windows(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts one after another, where in each the text begins and ends, and each text's first window.

    Every byte is in the labelled middle of one window. Texts must not be empty.
    """
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    count = -(-size // WINDOW)
    first = np.cumsum(count) - count
    side = bytes(CONTEXT)
    flat = np.frombuffer(b"".join(x for r in raw for x in (side, r, bytes(-len(r) % WINDOW), side)), np.uint8)
    number = np.arange(count.sum()) - np.repeat(first, count)
    starts = np.repeat(first * WINDOW + np.arange(len(raw)) * 2 * CONTEXT, count) + number * WINDOW
    windows = np.lib.stride_tricks.sliding_window_view(flat, SPAN)[starts]
    begin = np.maximum(0, CONTEXT - number * WINDOW)
    end = np.minimum(SPAN, CONTEXT + np.repeat(size, count) - number * WINDOW)
    return windows, begin, end, first


def pooled(w: Weights, raw: list[bytes]) -> np.ndarray:
    """Mean probabilities over every byte of each text: (texts, labels)."""
    x, begin, end, first = to_windows(raw)
    sums = np.empty((len(x), len(w["bias"])))
    at = np.arange(SPAN)[:, None]
    for s in range(0, len(x), LANES):
        own = slice(s, s + LANES)
        mask = ((at >= begin[own]) & (at < end[own])).astype(np.float32)
        sums[own] = position_probabilities(w, np.ascontiguousarray(x[own].T), mask)[CONTEXT : CONTEXT + WINDOW].sum(axis=0).T
    return np.add.reduceat(sums, first, axis=0) / np.fromiter(map(len, raw), np.int64, len(raw))[:, None]


def scrambled(texts: list[str], rng: np.random.Generator) -> list[bytes]:
    """Letters without a language, in turn: a text's characters in any order, and its letters each replaced by any of all texts'."""
    letters = sorted({c for t in texts for c in t if c.isalpha()}) or ["?"]
    out = []
    for k, t in enumerate(texts):
        mixed = rng.permutation(list(t)) if k % 2 else [letters[rng.integers(len(letters))] if c.isalpha() else c for c in t]
        out.append("".join(mixed).encode("utf-8")[:SPAN])
    return out


def train_language_model(df: DataFrame, id_col: str, text_col: str, lang_col: str, noise: bool = False) -> tuple[list[str], bytes]:
    """Languages in order and the fitted weights, from rows whose text and language are not null.

    Of each language about ``TEXTS_PER_LANGUAGE`` texts, and of all ``MOST_TEXTS``, are drawn by a hash of
    the id, and from each ``WINDOWS_PER_TEXT`` windows spread over its whole length. One task fits the
    network on these. With ``noise`` one label more is learned, of the same windows scrambled.
    Without any such row there are no languages and no weights.
    """
    known = df.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    scale = 1 << 30
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), F.lit(scale))
    counts = known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n"), F.min(place).alias("first")).collect()  # one row for each label
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return [], b""
    texts = max(1, min(TEXTS_PER_LANGUAGE, MOST_TEXTS // len(languages)))
    # The first text by hash is always drawn, so that no label is without one.
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(max(r["first"] + 1, min(scale, scale * texts // r["n"] + 1))))])
    drawn = known.filter(place < F.coalesce(share[F.col(lang_col)], F.lit(0)))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, lang in zip(b["text"], b["lang"], strict=True):
                raw = text.encode("utf-8")
                for s in np.unique(np.linspace(0, max(0, len(raw) - SPAN), WINDOWS_PER_TEXT).astype(int)):
                    out.append((raw[s : s + SPAN], lang))
            yield pd.DataFrame(out, columns=["window", "lang"])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["lang", "window"])
        raw = rows["window"].tolist()
        number = {k: i for i, k in enumerate(languages)}
        labels = [number[k] for k in rows["lang"]]
        if noise:
            wild = [r for r in scrambled([r.decode("utf-8", "ignore") for r in raw], np.random.default_rng(3)) if r]
            raw, labels = raw + wild, labels + [len(languages)] * len(wild)
        x = np.frombuffer(b"".join(r.ljust(SPAN, b"\0") for r in raw), np.uint8).reshape(-1, SPAN)
        np.savez(held := io.BytesIO(), **fit_network(x, np.array([len(r) for r in raw]), np.array(labels), max(labels) + 1))
        return pd.DataFrame({"weights": [held.getvalue()]})

    windows = drawn.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInPandas(cut, "window binary, lang string")
    return languages, windows.groupBy().applyInPandas(fit, "weights binary").first()[0]


def identify_language(df: DataFrame, id_col: str, text_col: str, languages: list[str], weights: bytes, keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score and noise to (id, text and ``keep`` columns); every byte of every text is labelled.

    ``und`` with score 0 if the text is null or has no letter, or no language has been learned. The
    score is the predicted language's probability averaged over the text's bytes; ties go to the first
    language by name. noise is the probability of scrambled letters so averaged, 0 unless it has been
    learned. Nothing is shuffled; repeated rows get equal results; an empty table gives none; columns
    named lang_pred, score or noise may not be kept.
    """
    columns = [id_col, text_col, *(keep or [])]
    source = df.select(*columns)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = dict(np.load(io.BytesIO(weights))) if weights else {}
        for b in batches:
            pred, score, wild = [UNDETERMINED] * len(b), [0.0] * len(b), [0.0] * len(b)
            held: list[tuple[int, bytes]] = []

            def flush() -> None:
                p = pooled(w, [r for _, r in held])
                own, other = p[:, : len(languages)], p[:, len(languages) :].sum(axis=1)
                for (i, _), k, s, n in zip(held, own.argmax(axis=1), own.max(axis=1), other, strict=True):
                    pred[i], score[i], wild[i] = languages[k], min(1.0, float(s)), float(n)
                held.clear()

            size = 0
            for i, text in enumerate(b.column(1).to_pylist()):
                if w and text and any(map(str.isalpha, text)):
                    held.append((i, text.encode("utf-8")))
                    size += len(held[-1][1])
                if size >= SLICE_BYTES:
                    flush()
                    size = 0
            if held:
                flush()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(wild, pa.float64())], names=[*b.schema.names, "lang_pred", "score", "noise"])

    schema = StructType([*source.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("noise", DoubleType())])
    return source.mapInArrow(label, schema)
