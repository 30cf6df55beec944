"""Byte-level BPE ids and counts of whole texts, by rank-synchronous array merging."""

from __future__ import annotations

import functools
import gc
import itertools
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.merging import PairTable, merge_ragged

#: Fixed value: the published split pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries that a task's tables of distinct words keep before they start anew.
TABLE_ENTRIES = 200_000
#: Characters of text that are split at once, which bounds a task's memory.
SLICE_CHARS = 2_000_000
#: Chunks of letters that the pattern takes as one word with the space before them, with a comma or a stop or without.
PLAIN = r"^\p{L}+[,.]?$"
#: Stands for a chunk whose text must be split as a whole; no ids have one byte.
WHOLE = b"?"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class ByteBpe:
    """Ids of texts for a byte-level BPE vocabulary file.

    A text falls into chunks at its single spaces. Distinct chunks fall into pre-tokens by the
    pattern, distinct pre-tokens are merged together in one ragged array, and a text's ids are its
    chunks' ids in order. A chunk whose leading white space might belong to a longer run sends its
    text through the pattern as a whole.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.byte_ids = np.array([vocab[c] for c in byte_letters()], np.int64)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.pairs = PairTable([(vocab[a], vocab[b], r, vocab[a + b]) for r, (a, b) in enumerate(pairs)])
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _learn_words(self, words: Iterable[str]) -> None:
        new = list(set(words) - self.words.keys())
        if not new:
            return
        raw = [w.encode("utf-8") for w in new]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        ids, counts = merge_ragged(self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)], lengths, self.pairs)
        packed, ends = ids.astype("<u4").tobytes(), [0, *(np.cumsum(counts) * 4).tolist()]
        self.words.update(zip(new, [packed[s:e] for s, e in itertools.pairwise(ends)], strict=True))

    def _learn_chunks(self, keys: Iterable[str]) -> None:
        """A key without a space stands for a space and itself; one with a space for a text's start."""
        single: dict[str, str] = {}
        split: dict[str, list[str]] = {}
        for key in keys:
            if key.isalpha():
                single[key] = " " + key
            elif key[:1] == " ":
                split[key] = self.pattern.findall(key[1:])
            elif not key or key[0].isspace():
                self.chunks[key] = WHOLE
            elif key[:-1].isalpha() and key[-1] in ",.":
                split[key] = [" " + key[:-1], key[-1]]
            else:
                split[key] = self.pattern.findall(" " + key)
        self._learn_words([*single.values(), *itertools.chain.from_iterable(split.values())])
        word = self.words.__getitem__
        self.chunks.update(zip(single, map(word, single.values())))
        for key, ws in split.items():
            self.chunks[key] = b"".join(map(word, ws))

    def _plain(self, texts: list[str]) -> list[bytes]:
        if len(self.chunks) > TABLE_ENTRIES or len(self.words) > TABLE_ENTRIES:
            self.chunks.clear()
            self.words.clear()
        found, odd, rows = [], [], []
        missing: set[str] = set()
        for t in texts:
            part = t.split(" ")
            part[0] = " " + part[0]
            got = list(map(self.chunks.get, part))
            if None in got:
                at = [i for i, g in enumerate(got) if g is None]
                missing.update([part[i] for i in at])
                rows.append((got, at, [part[i] for i in at]))
            else:
                rows.append((got, (), ()))
        self._learn_chunks(missing)
        for i, (got, at, keys) in enumerate(rows):
            for k, key in zip(at, keys, strict=True):
                got[k] = self.chunks[key]
            if WHOLE in got:
                odd.append(i)
            found.append(b"".join(got))
        for i in odd:
            ws = self.pattern.findall(texts[i])
            self._learn_words(ws)
            found[i] = b"".join(map(self.words.__getitem__, ws))
        return found

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        held: list[str] = []
        size = 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= SLICE_CHARS:
                yield from self._slice(held)
                held, size = [], 0
        yield from self._slice(held)

    def _slice(self, texts: list[str]) -> list[bytes]:
        if not self.special or not any(s in t for t in texts for s in self.specials):
            return self._plain(texts)
        pieces = [self.special.split(t) for t in texts]
        plain = iter(self._plain([x for p in pieces for x in p[::2]]))
        ids = {s: np.array([i], "<u4").tobytes() for s, i in self.specials.items()}
        return [b"".join(ids[x] if k % 2 else next(plain) for k, x in enumerate(p)) for p in pieces]


    def encode_arrow(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, none null, one after the other, and the number of each text's ids, as ``encode`` gives them.

        Distinct chunks are found by Arrow. Those of plain letters, with a comma or a stop behind them or not, are words
        that are merged together; other chunks, and texts that must be split as a whole, go the way of ``encode``.
        """
        if self.special:
            for s in self.specials:
                if pc.any(pc.match_substring(texts, s)).as_py():
                    return self._listed(list(self.encode(texts.to_pylist())))
        lists = pc.split_pattern(texts, " ")
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        begins = np.cumsum(lengths) - lengths
        flat = lists.flatten()
        # A text's first chunk has no space before it, and gets a mark that no other chunk has.
        first = np.zeros(len(flat), bool)
        first[begins] = True
        coded = pc.if_else(pa.array(first), pc.binary_join_element_wise(pa.scalar(" "), flat, pa.scalar("")), flat).dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids, sizes, odd = self._distinct(coded.dictionary)
        rows = np.flatnonzero(np.logical_or.reduceat(odd[which], begins)) if len(begins) else np.empty(0, np.int64)
        if len(rows):
            whole, n = self._listed(self._whole(texts.take(pa.array(rows)).to_pylist()))
            # Such a text is one chunk of its own, behind all others.
            keep = np.ones(len(flat), bool)
            keep[np.repeat(np.isin(np.arange(len(lengths)), rows), lengths)] = False
            keep[begins[rows]] = True
            which[begins[rows]] = len(sizes) + np.arange(len(rows))
            ids, sizes, which = np.concatenate([ids, whole]), np.concatenate([sizes, n]), which[keep]
            lengths[rows] = 1
        before = np.r_[0, np.cumsum(sizes[which])]
        return ragged(ids, sizes, which).astype("<u4"), np.diff(before[np.r_[0, np.cumsum(lengths)]])

    @staticmethod
    def _listed(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(packed), "<u4"), np.fromiter((len(x) // 4 for x in packed), np.int64, len(packed))

    def _whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            if len(self.words) > TABLE_ENTRIES:
                self.words.clear()
            words = self.pattern.findall(t)
            self._learn_words(words)
            out.append(b"".join(map(self.words.__getitem__, words)))
        return out

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and their number for each distinct chunk, and whether it needs its whole text."""
        plain = pc.match_substring_regex(chunks, PLAIN).to_numpy(zero_copy_only=False)
        held = chunks.filter(pa.array(plain))
        stop = np.full(len(held), -1)
        for k, c in enumerate(",."):
            stop[pc.ends_with(held, c).to_numpy(zero_copy_only=False)] = k
        # In the pattern's words the space before a chunk is its first letter.
        words = pc.binary_join_element_wise(pa.scalar(" "), pc.utf8_rtrim(held, ",."), pa.scalar("")).dictionary_encode()
        edges = np.frombuffer(words.dictionary.buffers()[1], np.int32)[: len(words.dictionary) + 1] if len(held) else np.zeros(1, np.int32)
        raw = np.frombuffer(words.dictionary.buffers()[2], np.uint8)[: edges[-1]] if len(held) else np.empty(0, np.uint8)
        ids, counts = merge_ragged(self.byte_ids[raw], np.diff(edges).astype(np.int64), self.pairs)
        self._learn_words([",", "."])
        asked = chunks.filter(pa.array(~plain)).to_pylist()
        if len(self.chunks) > TABLE_ENTRIES or len(self.words) > TABLE_ENTRIES:
            self.chunks.clear()
            self.words.clear()
            self._learn_words([",", "."])
        self._learn_chunks([k for k in asked if k not in self.chunks])
        found = [self.chunks[k] for k in asked]
        other, n = self._listed([self.words[","], self.words["."], *(b"" if x == WHOLE else x for x in found)])
        first, second = np.empty(len(chunks), np.int64), np.full(len(chunks), -1)
        first[plain], first[~plain] = words.indices.to_numpy(zero_copy_only=False), len(counts) + 2 + np.arange(len(asked))
        second[plain] = np.where(stop >= 0, len(counts) + stop, -1)
        order = np.stack([first, second], 1).ravel()
        order, own = order[order >= 0], np.repeat(np.arange(len(chunks)), 1 + (second >= 0))
        sizes = np.concatenate([counts, n]).astype(np.int64)
        odd = np.zeros(len(chunks), bool)
        odd[~plain] = [x == WHOLE for x in found]
        return ragged(np.concatenate([ids, other]), sizes, order), np.bincount(own, sizes[order], len(chunks)).astype(np.int64), odd


def ragged(values: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The rows ``which`` of ragged ``values`` with rows of ``sizes``, one after the other."""
    n = sizes[which]
    starts = (np.cumsum(sizes) - sizes)[which] - (np.cumsum(n) - n)
    return values[np.repeat(starts, n) + np.arange(n.sum())]


def slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Stretches (start, stop) of ``texts``, none null, of about ``size`` bytes; a longer text is one alone or ends one."""
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    edges = np.unique(np.r_[0, np.searchsorted(total, np.arange(size, total[-1] if len(total) else 0, size)), len(texts)])
    return itertools.pairwise(edges.tolist())


@functools.cache
def byte_bpe(path: str) -> ByteBpe:
    """The vocabulary at ``path``, read once by each Python worker.

    The tables hold millions of strings and no cycles, so the collector of cycles is asked to look less often.
    """
    gc.set_threshold(200_000, 20, 100)
    return ByteBpe(path)


def token_counts(df: DataFrame, id_col: str, text_col: str, vocabulary: str, limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row, over whole texts.

    Null and empty texts have 0 bytes and 0 tokens; special strings inside a text count as one token.
    Null ids and repeated rows pass through as they are; other columns are not read; an empty table
    gives an empty result. Nothing is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary)
        for b in batches:
            n = pa.array([len(x) // 4 for x in bpe.encode(b.column(2).to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], names=["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(count, "id long, n_bytes long, n_tokens long").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
