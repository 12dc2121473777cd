"""A compressed full-text index over sequences of integer symbols.

The Burrows-Wheeler transform of the text is held in a wavelet tree whose
shape follows a Shannon code, so a symbol takes about as many bits as its
frequency calls for (the zero-order entropy and at most one bit more) and a
rank costs as many steps.  Queries are answered for whole arrays at a time.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    """Packed bits with the ones before every 64th: ``rank`` in constant time."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        words.view(np.uint8)[:len(packed)] = packed
        self.words = words
        self.before = np.zeros(len(words), np.uint32)
        np.cumsum(np.bitwise_count(words[:-1]), out=self.before[1:], dtype=np.uint32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & low)


class WaveletTree:
    """``rank(symbol, i)``: how often a symbol is among the first ``i``."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        n = len(seq)
        freq = np.bincount(seq, minlength=n_symbols)
        bits = np.ceil(np.log2(n / np.maximum(freq, 1))).astype(np.int64)
        bits = np.where(freq > 0, np.maximum(bits, 1), 62)
        order = np.argsort(bits, kind="stable")
        self.place = np.empty(n_symbols, np.int64)          # symbol -> place in the order of codes
        self.place[order] = np.arange(n_symbols)
        self.bits, freq = bits[order], freq[order]
        used = int(np.count_nonzero(freq))
        self.depth = depth = int(self.bits[:used].max(initial=1))
        # canonical codes, aligned to the left: shorter ones first, so the symbols
        # that go on below a level are the last in this order
        step = np.where(np.arange(n_symbols) < used, np.int64(1) << np.maximum(depth - self.bits, 0), 0)
        code = np.cumsum(step) - step
        upto = np.concatenate([[0], np.cumsum(freq)])
        self.levels = []
        seq = self.place[seq]
        for level in range(depth):
            first = int(np.searchsorted(self.bits[:used], level, side="right"))
            prefix = code[first:used] >> (depth - level)
            node = np.searchsorted(prefix, prefix) + first
            start = np.zeros(n_symbols, np.int64)
            start[first:used] = upto[node] - upto[first]
            bit = np.zeros(n_symbols, bool)
            bit[first:used] = (code[first:used] >> (depth - 1 - level)) & 1
            if level:
                seq = self._descend(seq, self.levels[-1], self.bits, level, start)
            vector = BitVector(bit[seq])
            self.levels.append((vector, start.astype(np.int32), vector.rank(start).astype(np.int32), bit))

    @staticmethod
    def _descend(seq, above, bits, level, start):
        """The sequence one level deeper: each node's zeros, then its ones, in order."""
        vector, node, ones_before, bit = above
        at, b = np.arange(len(seq)), bit[seq]
        ones = vector.rank(at) - ones_before[seq]
        place = np.where(b, ones, at - node[seq] - ones)
        on = bits[seq] > level
        out = np.empty(int(np.count_nonzero(on)), np.int64)
        out[start[seq[on]] + place[on]] = seq[on]
        return out

    def rank(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.ranks(symbols, i, i)[0]

    def ranks(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols' ranks at two places each."""
        c, at = self.place[symbols], np.stack([low, high]).astype(np.int64)
        out, of = np.empty_like(at), np.arange(len(c))
        for level, (vector, start, ones_before, bit) in enumerate(self.levels):
            more = self.bits[c] > level
            if not more.all():
                done = ~more
                out[:, of[done]] = at[:, done]
                c, at, of = c[more], at[:, more], of[more]
            if not len(c):
                return out[0], out[1]
            ones = vector.rank(at + start[c]) - ones_before[c]
            at = np.where(bit[c], ones, at - ones)
        out[:, of] = at
        return out[0], out[1]

    def size_in_bits(self) -> int:
        return sum(64 * len(v.words) for v, *_ in self.levels)


def _after(values: np.ndarray, k: int) -> np.ndarray:
    """What stands k places further on, plus 1; 0 beyond the end."""
    out = np.zeros(len(values), np.int64)
    out[:max(len(values) - k, 0)] = values[k:] + 1
    return out


def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys and their ranks from 0, equal ones alike."""
    order = np.argsort(key)
    ranks = np.empty(len(key), np.int64)
    ranks[order] = np.cumsum(np.concatenate([[False], np.diff(key[order]) != 0]))
    return order, ranks


def suffix_ranks(text: np.ndarray, depth: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Suffix array of a text of symbols below its length whose equal suffixes
    end within ``depth`` symbols, and the ranks by the first 1, 3, 6, 12 ...
    symbols (the first three in one sort while they fit 63 bits, then doubling)."""
    n = len(text)
    by_depth, k, key = {1: text}, 3, None
    if (n + 1) ** 3 < 1 << 63:
        key = (text * (n + 1) + _after(text, 1)) * (n + 1) + _after(text, 2)
    else:
        k, key = 2, text * (n + 1) + _after(text, 1)
    while True:
        order, rank = _dense(key)
        by_depth[k] = rank
        if k >= depth or rank[order[-1]] == n - 1:
            return order, by_depth
        key, k = rank * (n + 1) + _after(rank, k), 2 * k


class FMIndex:
    """Backward search over passages.

    ``words`` holds the passages one after another as symbols 0 .. n_symbols - 1,
    ``lengths`` their lengths.  ``window`` is the match length that is asked for:
    ``windows`` slides over a text with one backward step for every word, giving
    up the last word of a match before it takes in the next on the left.
    """

    def __init__(self, words: np.ndarray, lengths: np.ndarray, n_symbols: int, window: int):
        self.window, p = window, len(lengths)
        n = len(words) + p
        self.ends = np.cumsum(lengths + 1) - 1
        text = np.empty(n, np.int64)
        word_at = np.ones(n, bool)
        word_at[self.ends] = False
        text[word_at], text[self.ends] = words + p, np.arange(p)
        order, ranks = suffix_ranks(text, int(lengths.max(initial=0)) + 1)
        self.passage = np.searchsorted(self.ends, order)
        # one symbol 0 for all separators: none is ever searched for
        symbols = np.where(text < p, 0, text - p + 1)
        self.tree = WaveletTree(symbols[order - 1], n_symbols + 1)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols + 1))])
        self.left, self.right = self._classes(order, ranks, window - 1)

    @staticmethod
    def _classes(order, ranks, depth):
        """For every place of the suffix array the range of suffixes that share
        the first ``depth`` symbols."""
        n = len(order)
        if depth == 0:
            return np.zeros(n, np.int64), np.full(n, n)
        k = max(x for x in ranks if x <= depth)
        if 2 * k < depth:          # the ranks end early where all suffixes differ
            return np.arange(n), np.arange(1, n + 1)
        head = ranks[k][order]
        tail = ranks[k][np.minimum(order + depth - k, n - 1)]
        new = np.ones(n, bool)
        new[1:] = (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])
        starts = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        return starts[of], np.append(starts[1:], n)[of]

    def step(self, symbols, low, high):
        """Ranges of the matches with one more symbol on their left."""
        c = symbols + 1
        low, high = self.tree.ranks(c, low, high)
        return self.smaller[c] + low, self.smaller[c] + high

    def windows(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of the suffix array for every window of these passages, in
        order; a window that the index hasn't got has an empty one."""
        w = self.window
        per = np.maximum(lengths - w + 1, 0)
        out_at = np.cumsum(per) - per
        low, high = np.zeros(int(per.sum()), np.int64), np.zeros(int(per.sum()), np.int64)
        some = np.flatnonzero(per)
        some = some[np.argsort(-per[some], kind="stable")]          # those with most windows first
        end = np.cumsum(lengths)[some]
        lo, hi = np.zeros(len(some), np.int64), np.full(len(some), len(self.passage))
        for j in range(1, int(lengths[some].max(initial=0)) + 1):
            if j > w:
                n = int(np.count_nonzero(per[some] > j - w))
                some, end, lo, hi = some[:n], end[:n], lo[:n], hi[:n]
                hit = hi > lo
                lo, hi = np.where(hit, self.left[np.minimum(lo, len(self.left) - 1)], 0), np.where(
                    hit, self.right[np.minimum(lo, len(self.left) - 1)], 0)
                again = np.flatnonzero(~hit)
                if len(again):          # a missing match: search the shorter one from its end
                    a, b = np.zeros(len(again), np.int64), np.full(len(again), len(self.passage))
                    for t in range(w - 1):
                        a, b = self.step(words[end[again] - j + w - 1 - t], a, b)
                    lo[again], hi[again] = a, b
            lo, hi = self.step(words[end - j], lo, hi)
            if j >= w:
                at = out_at[some] + per[some] - 1 - (j - w)
                low[at], high[at] = lo, hi
        return low, high

    def least(self, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least of the passages' ``values`` in each non-empty range; the
        ranges are equal or disjoint, as those of one window length are."""
        starts, first, of = np.unique(low, return_index=True, return_inverse=True)
        cuts = np.column_stack([starts, high[first]]).ravel()
        by_place = values[self.passage]
        if len(cuts) and cuts[-1] == len(by_place):
            cuts = cuts[:-1]
        return np.minimum.reduceat(by_place, cuts)[::2][of] if len(cuts) else values[:0]
