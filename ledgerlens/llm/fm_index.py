"""A compressed full-text index over word symbols: BWT in a wavelet matrix, searched backward.

Texts stream through it for their matching statistics; all take each step together, as numpy arrays.
"""

from __future__ import annotations

import numpy as np


class BitRank:
    """A bit vector in 64-bit words with a running count: the ones before any place."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.r_[0, np.cumsum(np.bitwise_count(words).astype(np.int64))[:-1]].astype(np.int32)

    def bit(self, place: np.ndarray) -> np.ndarray:
        return (self.words[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def ones(self, place: np.ndarray) -> np.ndarray:
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        below = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """A sequence of symbols, bit by bit from the highest, that counts a symbol before any place."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels: list[tuple[int, BitRank, int]] = []
        own = symbols
        for level in range(max(1, (alphabet - 1).bit_length()) - 1, -1, -1):
            bits = (own >> level & 1).astype(bool)
            self.levels.append((level, BitRank(bits), int(len(own) - bits.sum())))
            own = np.r_[own[~bits], own[bits]]
        every = np.arange(alphabet)
        self.base = self._descend(every, np.zeros(alphabet, np.int64))

    def _descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.levels:
            ones = bits.ones(place)
            place = np.where(symbol >> level & 1, zeros + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self._descend(symbol, place) - self.base[symbol]

    def symbol_rank(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before."""
        symbol = np.zeros(len(place), np.int64)
        for level, bits, zeros in self.levels:
            one, ones = bits.bit(place), bits.ones(place)
            symbol |= one.astype(np.int64) << level
            place = np.where(one, zeros + ones, place - ones)
        return symbol, place - self.base[symbol]


def suffix_ranks(text: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ranks of all suffixes, and their ranks by the first 1, 2, 4, ... symbols up to ``depth``.

    Symbol 0 ends a text; each one counts as a symbol of its own, so no two suffixes are equal
    and equal beginnings never reach beyond a text.
    """
    ends = np.flatnonzero(text == 0)
    rank = text + len(ends)
    rank[ends] = np.arange(len(ends))
    _, rank = np.unique(rank, return_inverse=True)
    levels, k = [rank.astype(np.int32)], 1
    while int(rank.max()) < len(text) - 1 or 2 * k <= depth:
        after = np.zeros(len(text), np.int64)
        after[:-k] = rank[k:] + 1
        _, rank = np.unique(rank * np.int64(len(text) + 1) + after, return_inverse=True)
        k *= 2
        if k <= depth:
            levels.append(rank.astype(np.int32))
    return rank, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], depth: int) -> np.ndarray:
    """Per place in the order, the symbols that its suffix begins with like the one before it, at most ``depth``; 0 at both ends."""
    one, other = order[:-1].copy(), order[1:].copy()
    same = np.zeros(len(one), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        rank, inside = levels[j], np.maximum(one, other) < len(order)
        equal = inside & (rank[np.where(inside, one, 0)] == rank[np.where(inside, other, 0)])
        for part in (same, one, other):
            part[equal] += 1 << j
    return np.r_[0, np.minimum(same, depth), 0].astype(np.min_scalar_type(depth))


class MinTree:
    """Minima over halves of halves: the next value below a bound on either side of a place."""

    def __init__(self, values: np.ndarray):
        size = 1 << max(1, (len(values) - 1).bit_length())
        self.levels = [np.r_[values, np.zeros(size - len(values), values.dtype)]]
        while len(self.levels[-1]) > 1:
            self.levels.append(self.levels[-1].reshape(-1, 2).min(axis=1))

    def nearest_below(self, place: np.ndarray, bound: np.ndarray, step: int) -> np.ndarray:
        """The nearest place from ``place`` on, to the left (step -1) or right (1), whose value is below ``bound``.

        The first value and all from the last on must be below it.
        """
        node, found = place.copy(), np.full(len(place), -1)
        last, side = len(self.levels) - 1, 1 if step > 0 else 0
        for level, minima in enumerate(self.levels):
            # A node on the near side of its parent is judged with its sibling, one level up.
            judged = (found < 0) & (((node & 1) == side) | (level == last))
            here = np.flatnonzero(judged)
            hit = minima[node[here]] < bound[here]
            found[here[hit]] = level
            missed = here[~hit]
            node[missed] += step
            node = np.where(found < 0, node >> 1, node)
        for level in range(last - 1, -1, -1):
            lanes = np.flatnonzero(found > level)
            near = 2 * node[lanes] + (1 - side)
            node[lanes] = np.where(self.levels[level][near] < bound[lanes], near, near ^ 1)
        return node


class FMIndex:
    """Compressed index over texts given as arrays of symbols from 1; they are kept apart by symbol 0.

    Holds the BWT in a wavelet matrix, the common prefixes of neighbours up to ``depth`` in a byte
    or two each, and the position of every ``SAMPLE``-th symbol of a text.  The texts, their full
    suffix order and the ranks exist only while it is built.
    """

    SAMPLE = 16

    def __init__(self, texts: list[np.ndarray], depth: int):
        lengths = np.array([len(t) for t in texts])
        self.starts = np.cumsum(np.r_[0, lengths[:-1] + 1])
        text = np.zeros(lengths.sum() + len(texts), np.int64)
        for start, t in zip(self.starts, texts, strict=True):
            text[start : start + len(t)] = t
        self.size, self.depth = len(text), depth
        self.alphabet = int(text.max()) + 1
        rank, levels = suffix_ranks(text, depth)
        order = np.empty(len(text), np.int64)
        order[rank] = np.arange(len(text))
        self.common = MinTree(common_prefixes(order, levels, depth))
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=self.alphabet))]
        self.bwt = WaveletMatrix(text[order - 1], self.alphabet)
        within = np.arange(len(text)) - np.repeat(self.starts, lengths + 1)
        sampled = (within % self.SAMPLE == 0)[order]
        self.sampled = BitRank(sampled)
        self.positions = order[sampled].astype(np.int32)

    def matches(self, texts: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of texts: per symbol, how many from it on occur ``least`` times in the index, at most ``depth``.

        Also the interval of their places in the suffix order.  ``least`` is 2 for a text that is
        in the index itself, else 1; a symbol the index does not know is above its alphabet.  Texts
        stream through the index from their ends: each step extends a match to the left, or, where
        that occurs too seldom, goes to the next shorter beginning of it that occurs more often.
        """
        lengths = np.array([len(t) for t in texts])
        symbols = np.concatenate(texts)
        begins = np.cumsum(lengths) - lengths
        share = 4 * self.depth
        # A long text is read in several lanes; what a match may need of the next one is read before it.
        parts = -(-lengths // share)
        begin = np.repeat(begins, parts) + share * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        end = np.repeat(begins + lengths, parts)
        own = np.minimum(begin + share, end)
        place = np.minimum(own + self.depth, end) - 1
        length = np.zeros(len(symbols), np.int64)
        low, high = np.zeros(len(symbols), np.int64), np.full(len(symbols), self.size)
        have, lo, hi = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64), np.full(len(begin), self.size)
        while len(place):
            symbol = symbols[place]
            known = np.where(symbol < self.alphabet, symbol, 0)
            at = self.bwt.rank(np.r_[known, known], np.r_[lo, hi])
            new_lo, new_hi = self.first[known] + at[: len(lo)], self.first[known] + at[len(lo) :]
            grown = (symbol < self.alphabet) & (new_hi - new_lo >= least)
            lo, hi, have = np.where(grown, new_lo, lo), np.where(grown, new_hi, hi), have + grown
            # Told, unless what cannot grow may do so when shorter.
            done = grown | (have == 0)
            shorter = np.flatnonzero(np.where(grown, have > self.depth, have > 0))
            if len(shorter):
                left, right = lo[shorter], hi[shorter]
                bound = np.where(grown[shorter], self.depth, np.maximum(self.common.levels[0][left], self.common.levels[0][right]).astype(np.int64))
                have[shorter] = bound
                some = bound > 0
                lo[shorter], hi[shorter] = 0, self.size
                lo[shorter[some]] = self.common.nearest_below(left[some], bound[some], -1)
                hi[shorter[some]] = self.common.nearest_below(right[some], bound[some], 1)
            told = np.flatnonzero(done & (place < own))
            length[place[told]], low[place[told]], high[place[told]] = have[told], lo[told], hi[told]
            place = place - done
            open_ = place >= begin
            if not open_.all():
                place, begin, own, have, lo, hi = (a[open_] for a in (place, begin, own, have, lo, hi))
        return length, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes at places of the order: steps to the left until a sampled one is met."""
        out, steps = np.zeros(len(rows), np.int64), 0
        lanes, row = np.arange(len(rows)), rows
        while len(lanes):
            met = self.sampled.bit(row)
            out[lanes[met]] = self.positions[self.sampled.ones(row[met])] + steps
            lanes, row = lanes[~met], row[~met]
            symbol, within = self.bwt.symbol_rank(row)
            row, steps = self.first[symbol] + within, steps + 1
        return out

    def texts_at(self, positions: np.ndarray) -> np.ndarray:
        """Numbers of the texts that hold the positions."""
        return np.searchsorted(self.starts, positions, "right") - 1
