"""FM-index over a sequence of small integers, with vectorised backward search.

The suffix array is built by prefix doubling that re-sorts only suffixes still tied, the Burrows-Wheeler
transform is stored in a wavelet matrix whose bit planes carry rank counts per 64-bit word, and every
``SAMPLE``-th text position keeps its suffix position, so occurrences are located by walking backwards.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 4


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative integers below 2**31; a suffix that is a prefix of another comes first."""
    n = len(text)
    bits = (int(text.max(initial=0)) + 1).bit_length()
    step = max(1, min(3, 63 // bits))  # symbols that fit into one key
    x = np.zeros(n + step, np.int64)
    x[:n] = text + 1
    key = x[:n].copy()
    for i in range(1, step):
        key = (key << bits) | x[i : n + i]
    sa = np.argsort(key, kind="stable")
    head = np.r_[True, key[sa[1:]] != key[sa[:-1]]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    begin = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[sa] = begin
    tied = np.flatnonzero(~(head & np.r_[head[1:], True]))
    while len(tied) and step < n:
        rows = sa[tied]
        nxt = rank[np.minimum(rows + step, n)]
        group = begin[tied]
        order = np.lexsort((nxt, group))
        sa[tied] = rows[order]
        nxt, group = nxt[order], group[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])]
        begin[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        rank[sa[tied]] = begin[tied]
        single = new & np.r_[new[1:], True]
        tied = tied[~single]
        step *= 2
    return sa


class Wavelet:
    """Wavelet matrix: rank of a symbol in a prefix of the sequence, for arrays of symbols and positions."""

    def __init__(self, seq: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.n = len(seq)
        self.words: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.zeros: list[int] = []
        cur = seq
        for level in range(self.levels - 1, -1, -1):
            bit = ((cur >> level) & 1).astype(bool)
            packed = np.packbits(np.r_[bit, np.zeros((-len(bit)) % 64 + 64, bool)], bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)][:-1])
            self.zeros.append(int(len(bit) - np.count_nonzero(bit)))
            cur = np.concatenate([cur[~bit], cur[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        w = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][w] + np.bitwise_count(self.words[level][w] & mask)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands in the first ``at`` places."""
        low, high = np.zeros_like(at), at.copy()
        for k in range(self.levels):
            bit = (symbol >> (self.levels - 1 - k)) & 1
            a, b = self._ones(k, low), self._ones(k, high)
            low = np.where(bit, self.zeros[k] + a, low - a)
            high = np.where(bit, self.zeros[k] + b, high - b)
        return high - low

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and how often it stands before that place."""
        symbol = np.zeros_like(at)
        low, pos = np.zeros_like(at), at.copy()
        for k in range(self.levels):
            bit = ((self.words[k][pos >> 6] >> (pos & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            a, b = self._ones(k, low), self._ones(k, pos)
            low = np.where(bit, self.zeros[k] + a, low - a)
            pos = np.where(bit, self.zeros[k] + b, pos - b)
            symbol = (symbol << 1) | bit
        return symbol, pos - low


class FMIndex:
    """Index of ``text``, symbols 1 to ``top``; symbols above ``top`` are separators, each different from all others."""

    def __init__(self, text: np.ndarray, top: int):
        if not len(text) or text[-1] <= top:  # the empty suffix has no row, so no phrase may end the text
            text = np.r_[text, max(top, int(text.max(initial=0))) + 1]
        self.n, self.top = len(text), top
        sa = suffix_array(text)
        bwt = np.where(sa > 0, text[sa - 1], top + 1)
        bwt = np.where(bwt > top, 0, bwt)  # separators are never searched and share one sign
        self.wavelet = Wavelet(bwt.astype(np.int64), top)
        # suffixes that begin with a smaller searchable symbol; separators sort after all of them
        self.first = np.r_[0, np.cumsum(np.bincount(text[text <= top], minlength=top + 1))]
        self.marked = (sa % SAMPLE == 0) | (bwt == 0)
        self.mark_rank = np.cumsum(self.marked) - 1
        self.samples = sa[self.marked]

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the phrases of ``[low, high)`` with ``symbol`` put before them."""
        both = self.wavelet.rank(np.r_[symbol, symbol], np.r_[low, high])
        base = self.first[symbol]
        return base + both[: len(low)], base + both[len(low) :]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix array rows, by walking back to a sampled row."""
        out = np.zeros(len(rows), np.int64)
        left, walked, at = np.arange(len(rows)), 0, rows.copy()
        while len(left):
            hit = self.marked[at]
            out[left[hit]] = self.samples[self.mark_rank[at[hit]]] + walked
            left, at = left[~hit], at[~hit]
            if len(left):
                symbol, r = self.wavelet.access_rank(at)
                at = self.first[symbol] + r
                walked += 1
        return out
