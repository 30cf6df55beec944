"""SentencePiece encoding and decoding through a table of distinct marked words."""

from __future__ import annotations

import functools
import gc
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.merging import PairTable, merge_ragged

#: Fixed value: the marker that stands for a space in pieces.
MARK = "▁"
TABLE_ENTRIES = 200_000
#: Texts on which a table is held against its model once: spaces, marks, wide, joined and odd characters, which other
#: normalisers or prefixes than those that the table takes for granted would change.
PROBES = ["", " ", "  a  b ", "\ta\n", "ﬁ ａ① e\u0301 ½", "▁ ▁▁a", "\u00a0\u3000\u200b", "A.B,c-1234", "\x00<s>", "😀é漢"]
SLICE_CHARS = 2_000_000


class PieceTable:
    """Segments distinct marked words of a BPE model whose pieces do not cross a word's start.

    A marked word is a run of markers with what follows it up to the next marker. As no piece holds
    a marker after another character, the words of a text can be segmented one by one.
    """

    def __init__(self, path: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.names) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        own = {p: i for i, p in enumerate(self.names) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        if any(MARK in p.lstrip(MARK) for p in own):
            raise ValueError("pieces of this model cross the start of a word")
        self.letter_ids = -1 - np.arange(0x110000, dtype=np.int64)
        for p, i in own.items():
            if len(p) == 1:
                self.letter_ids[ord(p)] = i
        self.decimals = [str(i) for i in range(len(self.names))]
        self.texts = [p.replace(MARK, " ") for p in self.names]
        order = {s: r for r, s in enumerate(sorted({-sp.get_score(i) for i in own.values()}))}
        self.pairs = PairTable(
            [(own[p[:k]], own[p[k:]], order[-sp.get_score(i)], i) for p, i in own.items() for k in range(1, len(p)) if p[:k] in own and p[k:] in own]
        )
        self.word = regex.compile(f"{MARK}+[^{MARK}]*")
        self.table: dict[str, tuple[int, str, str]] = {}
        for probe, (_, ids, text) in zip(PROBES, self.encode(PROBES), strict=True):
            own = sp.encode(probe)
            if ids != ",".join(map(str, own)) or text != sp.decode(own):
                raise ValueError("this model changes texts in a way that the table of words does not know")

    def _learn(self, words: Iterable[str]) -> None:
        new = list(words)
        if not new:
            return
        # A letter outside the vocabulary is held as a negative code point and becomes bytes at the end.
        points = np.frombuffer("".join(new).encode("utf-32-le"), "<u4")
        flat = self.letter_ids[points]
        ids, counts = merge_ragged(flat, np.fromiter(map(len, new), np.int64, len(new)), self.pairs)
        decimal, text = self.decimals.__getitem__, self.texts.__getitem__
        odd = bool((ids < 0).any())
        ids, ends = ids.tolist(), [0, *np.cumsum(counts).tolist()]
        for word, s, e in zip(new, ends, ends[1:]):
            got = ids[s:e]
            if odd and min(got) < 0:
                got = [b for i in got for b in ((i,) if i >= 0 else (self.byte_ids[b] for b in chr(-1 - i).encode("utf-8")))]
                self.table[word] = (len(got), ",".join(map(decimal, got)), self.surface(got))
            else:
                self.table[word] = (e - s, ",".join(map(decimal, got)), "".join(map(text, got)))

    def surface(self, ids: Iterable[int]) -> str:
        """The text of ids, markers as spaces."""
        raw = b"".join(bytes((self.byte_of[i],)) if i in self.byte_of else self.names[i].encode("utf-8") for i in ids)
        return raw.decode("utf-8", "replace").replace(MARK, " ")

    def _words(self, text: str) -> list[str]:
        if not text:
            return []
        parts = text.replace(MARK, " ").split(" ")
        if "" not in parts:
            return [MARK + p for p in parts]
        return self.word.findall(MARK + MARK.join(parts))

    def encode(self, texts: Iterable[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, the ids as decimals joined by commas, the text that they decode to)."""
        held: list[str] = []
        size = 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= SLICE_CHARS:
                yield from self._slice(held)
                held, size = [], 0
        yield from self._slice(held)

    def _slice(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        if len(self.table) > TABLE_ENTRIES:
            self.table.clear()
        rows, missing = [], set()
        for t in texts:
            words = self._words(t)
            got = list(map(self.table.get, words))
            at = [i for i, g in enumerate(got) if g is None] if None in got else []
            keys = [words[i] for i in at]
            missing.update(keys)
            rows.append((got, at, keys))
        self._learn(missing)
        for got, at, keys in rows:
            for k, key in zip(at, keys, strict=True):
                got[k] = self.table[key]
            n, ids, text = zip(*got, strict=True) if got else ((), (), ())
            yield sum(n), ",".join(ids), "".join(text)[1:]


@functools.cache
def piece_table(path: str) -> PieceTable:
    """The model at ``path``, read once by each Python worker; its tables hold no cycles to collect."""
    gc.set_threshold(200_000, 20, 100)
    return PieceTable(path)


def piece_digests(df: DataFrame, id_col: str, text_col: str, model: str) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for every row, over whole texts.

    Null texts count as empty ones: no ids, and the digests of an empty string. Null ids and repeated
    rows pass through; other columns are not read; an empty table gives an empty result. The table of
    distinct words lives in each Python worker and is bounded; nothing is shuffled.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model)
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for b in batches:
            rows = [(n, sha(ids), sha(text)) for n, ids, text in table.encode(b.column(1).to_pylist())]
            n, ids, text = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(digest, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def piece_ids(df: DataFrame, id_col: str, text_col: str, model: str) -> DataFrame:
    """(id, ids array<int>, decoded string) for every row: the operator's full output, null texts as empty."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model)
        for b in batches:
            rows = [([int(i) for i in ids.split(",")] if n else [], text) for n, ids, text in table.encode(b.column(1).to_pylist())]
            ids, text = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(text, pa.string())], names=["id", "ids", "decoded"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(encode, "id long, ids array<int>, decoded string").withColumnRenamed("id", id_col)
