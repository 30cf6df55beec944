"""Rank-synchronous merging of many ragged symbol sequences at once."""

from __future__ import annotations

import numpy as np

NEVER = np.iinfo(np.int64).max


class PairTable:
    """Mergeable pairs (left, right, rank, result), found by a hash table of a few slots a bucket."""

    BITS = 19

    def __init__(self, pairs: list[tuple[int, int, int, int]]) -> None:
        a = np.array(pairs, np.int64).reshape(-1, 4)
        self.key = np.append((a[:, 0] << 32) | a[:, 1], -1)
        self.rank = np.append(a[:, 2], NEVER)
        self.result = np.append(a[:, 3], -1)
        home = self._home(self.key[:-1])
        order = np.argsort(home, kind="stable")
        home = home[order]
        first = np.maximum.accumulate(np.where(np.append(True, home[1:] != home[:-1])[: len(home)], np.arange(len(home)), 0))
        place = np.arange(len(home)) - first
        self.slots = [np.full(1 << self.BITS, len(a), np.int32) for _ in range(int(place.max(initial=0)) + 1)]
        for k, slot in enumerate(self.slots):
            slot[home[place == k]] = order[place == k]

    def _home(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in ``rank`` and ``result``; the last place where there is none."""
        key = (left << 32) | (right & 0xFFFFFFFF)
        home, none = self._home(key), len(self.key) - 1
        at = self.slots[0][home]
        rest = np.flatnonzero((self.key[at] != key) & (at != none))
        at[self.key[at] != key] = none
        for slot in self.slots[1:]:
            if not len(rest):
                break
            got = slot[home[rest]]
            hit = self.key[got] == key[rest]
            at[rest[hit]] = got[hit]
            rest = rest[~hit & (got != none)]
        return at


def merge_ragged(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge every sequence to its fixpoint and return (symbols, lengths) in the given order.

    Each round looks up all adjacent pairs, takes every sequence's lowest rank and applies that pair
    at all its places (leftmost first where places overlap). Sequences without a mergeable pair leave
    the arrays, so a few long sequences do not hold up many short ones. Negative symbols never merge.
    """
    total = len(lengths)
    out_len = np.zeros(total, np.int64)
    done_sym, done_seq = [], []
    sym = symbols.astype(np.int64, copy=True)
    seq = np.repeat(np.arange(total), lengths)
    while len(sym):
        joined = seq[1:] == seq[:-1]
        at = table.find(sym[:-1], sym[1:])
        rank = np.append(np.where(joined, table.rank[at], NEVER), NEVER)
        starts = np.flatnonzero(np.append(True, ~joined))
        best = np.minimum.reduceat(rank, starts)
        size = np.diff(np.append(starts, len(sym)))
        active = np.repeat(best < NEVER, size)
        if not active.all():
            done_sym.append(sym[~active])
            done_seq.append(seq[~active])
        pick = active & (rank == np.repeat(best, size))
        index = np.arange(len(sym))
        run = np.maximum.accumulate(np.where(pick & ~np.append(False, pick[:-1]), index, 0))
        pick &= (index - run) % 2 == 0
        chosen = np.flatnonzero(pick)
        sym[chosen] = table.result[at[chosen]]
        keep = active & ~np.append(False, pick[:-1])
        sym, seq = sym[keep], seq[keep]
    if not done_sym:
        return sym, out_len
    all_sym, all_seq = np.concatenate(done_sym), np.concatenate(done_seq)
    out_len += np.bincount(all_seq, minlength=total)
    return all_sym[np.argsort(all_seq, kind="stable")], out_len
