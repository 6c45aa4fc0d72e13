"""An FM-index over sequences of whole numbers: a wavelet tree over the Burrows-Wheeler transform.

The tree is shaped by code lengths, so it takes about the transform's entropy in bits, and
keeps one row of 64-bit words a level, with counts before each word. Backward search
prepends one symbol to a match by two ranks. Matches are bounded in length, so suffixes are
sorted by their first 2**levels symbols only; an array of common prefixes of neighbours lets
a match that can't be prolonged fall back to its longest prefix that occurs more often.

Every sequence has a weight, the number of times it stands for; an interval of suffixes
weighs as much as the sequences they lie in. All searches of a batch advance in step, one
symbol a turn, as numpy arrays.
"""

from __future__ import annotations

import numpy as np


class WaveletTree:
    """Ranks of symbols in a sequence, by codes of about log2(n / count) bits."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        n, counts = len(sequence), np.bincount(sequence, minlength=symbols)
        lengths = np.maximum(1, np.frexp(-(-n // np.maximum(1, counts)) - 1.0)[1])
        order = np.argsort(lengths, kind="stable")
        self.depth = int(lengths[order[-1]])
        by_code = np.int64(1) << (self.depth - lengths[order]).astype(np.int64)
        codes = np.cumsum(by_code) - by_code
        place = np.empty(symbols, np.int64)
        place[order] = np.arange(symbols)
        self.lengths, self.codes = lengths, codes[place]
        held, sizes = counts[order], lengths[order]
        self.starts, self.ones, self.words, self.before = [], [], [], []
        current = sequence
        start = np.zeros(symbols, np.int64)
        for level in range(self.depth):
            bit = (self.codes[current] >> (self.depth - 1 - level)) & 1
            padded = np.zeros(-(-(len(current) + 1) // 64) * 64, np.uint8)
            padded[: len(current)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
            self.words.append(words)
            self.before.append(before.astype(np.int32))
            # The node of a symbol begins where its prefix does among the symbols still in the tree.
            self.starts.append(start)
            self.ones.append(self.rank_ones(level, np.minimum(start, len(current))))
            if level + 1 == self.depth:
                break
            live = np.where(sizes > level + 1, held, 0)
            prefix = codes >> (self.depth - 1 - level)
            following = np.empty(symbols, np.int64)
            following[order] = (np.cumsum(live) - live)[np.searchsorted(prefix, prefix, "left")]
            stays = np.flatnonzero(self.lengths[current] > level + 1)
            symbol = current[stays]
            ones = self.rank_ones(level, stays) - self.ones[level][symbol]
            target = following[symbol] + np.where(bit[stays] == 1, ones, stays - start[symbol] - ones)
            current = np.empty(len(stays), sequence.dtype)
            current[target] = symbol
            start = following

    def rank_ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol[i] stands before place at[i]."""
        at, lengths, codes = at.copy(), self.lengths[symbol], self.codes[symbol]
        live = np.arange(len(at))
        for level in range(self.depth):
            live = live[lengths[live] > level]
            if not len(live):
                break
            own = symbol[live]
            ones = self.rank_ones(level, self.starts[level][own] + at[live]) - self.ones[level][own]
            at[live] = np.where((codes[live] >> (self.depth - 1 - level)) & 1 == 1, ones, at[live] - ones)
        return at


class FMIndex:
    """Of `text`, whole numbers from 0 with 0 between sequences, and the weight at each place."""

    def __init__(self, text: np.ndarray, weight: np.ndarray, longest: int):
        n, symbols = len(text), int(text.max()) + 1
        levels = longest.bit_length()
        ranks, rank = [text], text
        for level in range(levels):
            pairs = rank * (int(rank.max()) + 1) + np.roll(rank, -(1 << level))
            order = np.argsort(pairs)
            fresh = np.empty(n, np.int64)
            fresh[order] = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.diff(pairs[order]) != 0)])
            rank = fresh
            ranks.append(rank)
        self.n = n
        self.tree = WaveletTree(text[order - 1], symbols)
        self.smaller = np.cumsum(np.bincount(text, minlength=symbols)) - np.bincount(text, minlength=symbols)
        self.weights = np.concatenate([np.zeros(1, np.int64), np.cumsum(weight[order])])
        common = np.zeros(n - 1, np.int64)
        for level in range(levels - 1, -1, -1):
            one, other = (order[:-1] + common) % n, (order[1:] + common) % n
            common += (ranks[level][one] == ranks[level][other]).astype(np.int64) << level
        self.common = np.concatenate([[-1], common, [-1]])
        self.left, self.right = np.zeros(n + 1, np.int32), np.full(n + 1, n, np.int32)
        at = np.arange(n + 1, dtype=np.int32)
        for value in np.unique(common).tolist():
            lower, own = self.common < value, np.flatnonzero(self.common == value)
            self.left[own] = np.maximum.accumulate(np.where(lower, at, 0))[own]
            self.right[own] = np.minimum.accumulate(np.where(lower, at, n)[::-1])[::-1][own]

    def matching(self, queries: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
        """For each place of each query the length of the longest match from there on that weighs `least` or more.

        Queries are queries[starts[i]:ends[i]]. A symbol 0 matches nothing.
        """
        out = np.zeros(len(queries), np.int64)
        at, low, high, length = ends - 1, np.zeros(len(starts), np.int64), np.full(len(starts), self.n, np.int64), np.zeros(len(starts), np.int64)
        live = np.flatnonzero(at >= starts)
        while len(live):
            symbol = queries[at[live]]
            ranks = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]]))
            down, up = self.smaller[symbol] + ranks[: len(live)], self.smaller[symbol] + ranks[len(live) :]
            longer = (symbol > 0) & (self.weights[up] - self.weights[down] >= least)
            alone = ~longer & ((symbol == 0) | (length[live] == 0))
            some, none, short = live[longer], live[alone], live[~longer & ~alone]
            low[some], high[some] = down[longer], up[longer]
            length[some] += 1
            out[at[some]] = length[some]
            at[some] -= 1
            low[none], high[none], length[none] = 0, self.n, 0
            at[none] -= 1
            # Back to the longest prefix that more suffixes begin with.
            below, above = self.common[low[short]], self.common[high[short]]
            length[short] = prefix = np.maximum(below, above)
            low[short] = np.where(below == prefix, self.left[low[short]], low[short])
            high[short] = np.where(above == prefix, self.right[high[short]], high[short])
            live = live[at[live] >= starts[live]]
        return out
