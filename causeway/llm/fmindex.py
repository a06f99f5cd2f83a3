"""An FM-index over numbers, for one shard of text: wavelet ranks and sampled positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8  # every eighth position of a stretch keeps its place in the text


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order. Symbol 0 ends a stretch; the n-th 0 is smaller than the next one,
    so no comparison goes beyond a stretch."""
    n = len(symbols)
    zero = symbols == 0
    ends = int(zero.sum())
    rank = np.where(zero, np.cumsum(zero) - 1, symbols.astype(np.int64) + ends)
    order = np.argsort(rank, kind="stable")
    groups = rank[order]
    heads = np.concatenate([[True], groups[1:] != groups[:-1]])
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    step = 1
    while not heads.all():
        # only members of groups that are still tied are ordered again
        alone = heads & np.concatenate([heads[1:], [True]])
        places = np.flatnonzero(~alone)
        tied = order[places]
        after = np.minimum(tied + step, n - 1)
        key = rank[tied] * np.int64(n) + rank[after]
        moved = np.argsort(key, kind="stable")
        tied, key = tied[moved], key[moved]
        order[places] = tied
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        heads[places] = fresh
        rank[tied] = np.maximum.accumulate(np.where(fresh, places, 0))
        step *= 2
    return order


class Wavelet:
    """Ranks of symbols in a sequence, level by level of their bits."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.size = len(sequence)
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for shift in reversed(range(max(1, (symbols - 1).bit_length()))):
            bits = (sequence >> shift) & 1
            ones = np.zeros(self.size + 1, np.int32)
            np.cumsum(bits, out=ones[1:])
            zeros = self.size - int(ones[-1])
            self.levels.append((shift, ones, zeros))
            sequence = np.concatenate([sequence[bits == 0], sequence[bits == 1]])
        self.base = self._follow(np.arange(symbols), np.zeros(symbols, np.int64))

    def _follow(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for shift, ones, zeros in self.levels:
            before = ones[place]
            place = np.where((symbol >> shift) & 1, zeros + before, place - before)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often the symbol stands before the place."""
        return self._follow(symbol, place) - self.base[symbol]

    def at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at the place, and its rank there."""
        symbol = np.zeros(len(place), np.int64)
        for shift, ones, zeros in self.levels:
            before = ones[place]
            bit = ones[place + 1] - before
            symbol |= bit.astype(np.int64) << shift
            place = np.where(bit, zeros + before, place - before)
        return symbol, place - self.base[symbol]


class FmIndex:
    """Finds phrases in ``symbols``; these end with 0, as does every stretch in them."""

    def __init__(self, symbols: np.ndarray, alphabet: int, sample: int = SAMPLE):
        order = suffix_order(symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet))])
        self.ranks = Wavelet(symbols[order - 1].astype(np.int64), alphabet)
        begins = np.concatenate([[True], symbols[:-1] == 0])
        # A walk back never leaves its stretch: its first position is always sampled.
        kept = (begins | (np.arange(len(symbols)) % sample == 0))[order]
        self.sampled = kept
        self.nth = np.cumsum(kept) - 1
        self.places = order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffix order that begin with each phrase, as ranges.

        ``phrases`` holds a phrase a row, its last word in column 0 and so on backwards.
        """
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.ranks.size, np.int64)
        for column in range(phrases.shape[1] if len(phrases) else 0):
            live = np.flatnonzero((lengths > column) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, column]
            low[live] = self.first[symbol] + self.ranks.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.ranks.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of rows of the suffix order."""
        found = np.zeros(len(rows), np.int64)
        waiting, rows, steps = np.arange(len(rows)), rows.copy(), 0
        while len(waiting):
            known = self.sampled[rows]
            found[waiting[known]] = self.places[self.nth[rows[known]]] + steps
            waiting, rows = waiting[~known], rows[~known]
            if len(waiting):
                symbol, rank = self.ranks.at(rows)
                rows = self.first[symbol] + rank
            steps += 1
        return found
