"""Packing token sequences into fixed-length sequences by best two fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.storage import stored
from stratafold.llm.tokens import byte_bpe, slices

#: Pieces that one group packs; groups are drawn by hash, so each sees the same mix of lengths.
GROUP_PIECES = 20_000
#: Bytes of text that a task takes apart at once; a longer text is taken whole.
SLICE_BYTES = 1_000_000


def best_two_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each length (1 to ``capacity``), bins numbered from 0.

    A bin takes the longest unpacked length that fits, again and again. Then its shortest length is
    exchanged for the two unpacked ones that fill the gap so expanded best, if they fill it better.
    """
    bins = np.empty(len(lengths), np.int64)
    queues: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, n in enumerate(lengths.tolist()):
        queues[n].append(i)
    open_ = sum(1 << n for n in range(1, capacity + 1) if queues[n])

    def longest(most: int) -> int:
        return (open_ & ((1 << (most + 1)) - 1)).bit_length() - 1

    def take(n: int) -> int:
        nonlocal open_
        i = queues[n].pop()
        if not queues[n]:
            open_ &= ~(1 << n)
        return i

    number = 0
    while open_:
        gap, inside = capacity, []
        while open_ and (n := longest(gap)) > 0:
            inside.append((n, take(n)))
            gap -= n
        if gap and len(inside) > 1 and open_:
            short, item = inside[-1]
            room, best = short + gap, (short, 0, 0)
            first = longest(room - 1)
            while first > 0 and 2 * first > best[0]:
                rest = room - first
                second = longest(min(rest, first if len(queues[first]) > 1 else first - 1))
                if second > 0 and first + second > best[0]:
                    best = (first + second, first, second)
                    if best[0] == room:
                        break
                first = longest(first - 1)
            if best[1]:
                inside.pop()
                inside += [(best[1], take(best[1])), (best[2], take(best[2]))]
                queues[short].append(item)
                open_ |= 1 << short
        for _, i in inside:
            bins[i] = number
        number += 1
    return bins


def token_pieces(df: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and ``end_id``, cut where longer than ``capacity``.

    Pieces of a cut document hold ``capacity`` ids but the first, which takes what is over. A null or
    empty text is the end id alone. Repeated rows give repeated pieces.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, names = byte_bpe(vocabulary), ["id", "piece", "start", "length", "ids_crc32"]
        for b in batches:
            for start, stop in slices(b.column(1), SLICE_BYTES):
                ids, lengths = bpe.encode_arrow(b.column(1).slice(start, stop - start))
                whole = np.empty(len(ids) + len(lengths), "<u4")
                last = np.zeros(len(whole), bool)
                last[np.cumsum(lengths + 1) - 1] = True
                whole[last], whole[~last] = end_id, ids
                # The first piece of a text takes what is over.
                n, number = lengths + 1, lengths // capacity + 1
                doc = np.repeat(np.arange(len(n)), number)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
                head = lengths % capacity + 1
                begin = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                at, view = (np.cumsum(n) - n)[doc] + begin, memoryview(whole.tobytes())
                crc = [zlib.crc32(view[4 * s : 4 * e]) for s, e in zip(at.tolist(), (at + length).tolist(), strict=True)]
                columns = [b.column(0).take(pa.array(doc + start)), pa.array(piece, pa.int32()), pa.array(begin), pa.array(length), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, "id long, piece int, start long, length long, ids_crc32 long")


def pack_pieces(pieces: DataFrame, capacity: int, groups: int) -> DataFrame:
    """Adds sequence_id and offset to rows with id, piece and length, packing each of ``groups`` on its own."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "id", "piece"], ignore_index=True)
        bins = best_two_fit(rows["length"].to_numpy(), capacity)
        rows = rows.assign(sequence_id=bins + (int(key[0]) << 32)).sort_values("sequence_id", kind="stable", ignore_index=True)
        rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
        return rows.drop(columns="part")

    # The row's own number spreads rows of one id, and equal rows, over the groups.
    part = F.pmod(F.xxhash64("id", "piece", F.monotonically_increasing_id()), F.lit(groups))
    # Ids travel as text, for an integer with nulls would turn into a float.
    packed = pieces.withColumn("part", part).withColumn("id", F.col("id").cast("string")).groupBy("part").applyInPandas(pack, PLACED)
    return packed.withColumn("id", F.col("id").cast("long"))


PLACED = "id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack_documents(df: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int = 2, capacity: int = 1024, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Packs every document into sequences of at most ``capacity`` ids; a row for each piece.

    Pieces of ``capacity`` ids are sequences by themselves. The others are dealt by a hash into groups of about
    ``group_pieces`` and packed apart, so one task holds a bounded number of lengths and never a text;
    each group can leave one sequence unfilled. Null texts are packed as their end id; repeated rows are
    packed each; an empty table gives an empty result; other columns are not read.
    """
    pieces = stored(token_pieces(df, id_col, text_col, vocabulary, end_id, capacity), "pieces")
    part = pieces.filter(F.col("length") < capacity)
    full = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    packed = pack_pieces(part, capacity, max(1, -(-part.count() // group_pieces)))
    return packed.unionByName(full).withColumnRenamed("id", id_col)
