"""A compressed FM-index over sequences of symbols: a wavelet matrix of the Burrows-Wheeler transform.

Everything works on many queries at once: a step of backward search takes arrays of intervals and symbols.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = 0


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling ranks until they differ. Separators differ by their place."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    rank = np.unique(np.where(text == SEPARATOR, np.arange(n) - n, text.astype(np.int64)), return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + follow
        # equal keys get one rank, so their order is of no matter, and the fastest sort will do
        order = np.argsort(key)
        ranked = key[order]
        fresh = np.r_[0, np.cumsum(ranked[1:] != ranked[:-1])]
        rank[order] = fresh
        step *= 2
        if fresh[-1] == n - 1 or step >= n:
            return order


class WaveletMatrix:
    """Rank queries over a sequence: per bit of the symbols one packed bit vector with counts each 64 bits."""

    def __init__(self, values: np.ndarray, sigma: int) -> None:
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            packed = np.packbits(np.r_[bit, np.zeros(64 + (-len(bit)) % 64, bool)], bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]].astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])
        self.first = self.trace(np.arange(sigma), np.zeros(sigma, np.int64))

    def trace(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[k][word] + np.bitwise_count(self.bits[k][word] & below).astype(np.int64)
            bit = (symbols >> (self.levels - 1 - k)) & 1
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the place."""
        return self.trace(symbols, at) - self.first[symbols]


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int) -> None:
        """text: symbols under sigma, SEPARATOR between sequences and at the end."""
        self.n = len(text)
        self.order = suffix_array(text)
        self.matrix = WaveletMatrix(text[self.order - 1] if self.n else text, sigma)
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))[:-1]]

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + pattern, from those of the patterns."""
        both = self.before[np.r_[symbols, symbols]] + self.matrix.rank(np.r_[symbols, symbols], np.r_[low, high])
        return both[: len(symbols)], both[len(symbols) :]


class RangeMinimum:
    """Least value of any range: a table per power of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.tables = [values]
        while len(self.tables[-1]) > 1 << (len(self.tables) - 1):
            t, step = self.tables[-1], 1 << (len(self.tables) - 1)
            self.tables.append(np.minimum(t[:-step], t[step:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima over [low, high), none of them empty."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.tables[0].dtype)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.tables[k][low[at]], self.tables[k][high[at] - (1 << k)])
        return out


def matched_windows(index: FMIndex, owners: np.ndarray, text: np.ndarray, lanes: list[tuple[int, int]], readers: np.ndarray, window: int) -> np.ndarray:
    """Marks starts in text of windows that the index holds in a document with a smaller number than the reader.

    Matching statistics by backward search, all lanes in step: a lane walks its windows right to left and keeps
    extending its match as long as it can; when that fails the window in question is searched by itself.
    owners: the document of each suffix, in suffix order; the least owner of an interval decides.
    A lane (first, last) covers the windows that start in [first, last).
    """
    out = np.zeros(len(text), bool)
    if not lanes or not index.n:
        return out
    least = RangeMinimum(owners)
    first = np.array([a for a, _ in lanes])
    target = np.array([b for _, b in lanes]) - 1
    at = target + window - 1
    low, high = np.zeros(len(lanes), np.int64), np.full(len(lanes), index.n)
    length = np.zeros(len(lanes), np.int64)
    alone = np.ones(len(lanes), bool)
    live = np.flatnonzero(target >= first)
    while len(live):
        c = text[at[live]]
        lo, hi = index.extend(c, low[live], high[live])
        good = (hi > lo) & (c != SEPARATOR)
        g = live[good]
        low[g], high[g] = lo[good], hi[good]
        length[g] += 1
        at[g] -= 1
        done = g[at[g] + 1 == target[g]]
        done = done[length[done] >= window]
        if len(done):
            hit = least.least(low[done], high[done]) < readers[done]
            # a longer match may lie in later documents only: search that window by itself
            again = ~hit & ~alone[done]
            out[target[done[hit]]] = True
            settled = done[~again]
            target[settled] -= 1
            alone[settled] = False
            restart = done[again]
            at[restart] = target[restart] + window - 1
            low[restart], high[restart], length[restart], alone[restart] = 0, index.n, 0, True
        b = live[~good]
        if len(b):
            # a symbol the index lacks rules out every window over it; else only a window searched by itself fails
            absent = c[~good] == SEPARATOR
            target[b[absent]] = at[b[absent]] - window
            target[b[~absent & alone[b]]] -= 1
            at[b] = target[b] + window - 1
            low[b], high[b], length[b], alone[b] = 0, index.n, 0, True
        live = live[target[live] >= first[live]]
    return out
