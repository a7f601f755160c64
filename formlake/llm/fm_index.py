"""A compressed full-text index over words: the Burrows-Wheeler transform in a wavelet matrix of bit vectors with popcount ranks."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffixes in order, by doubling the length that ranks stand for. Each 0 is an end of its own, the first the least, so no comparison goes beyond one.

    depth: suffixes that agree in so many symbols may stand in any order, which is enough to search for patterns of that length.
    """
    n = len(text)
    ends = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - width] = rank[width:] if width < n else after[: n - width]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        rank, width = new, 2 * width
        if rank[order[-1]] == n - 1 or width > n or (depth and width >= depth):
            return order


class BitRank:
    """Bits packed 64 to a word, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros((len(bits) >> 6) + 1, np.uint64)
        raw = np.packbits(bits, bitorder="little")
        packed.view(np.uint8)[: len(raw)] = raw
        self.words = packed
        self.before = np.concatenate([np.zeros(1, np.int32), np.cumsum(np.bitwise_count(packed), dtype=np.int32)[:-1]])
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        low = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


class FMIndex:
    """Backward search over a text of symbols 0..sigma-1, one value (such as a document) for each place."""

    def __init__(self, text: np.ndarray, values: np.ndarray, depth: int | None = None):
        n = len(text)
        self.n, self.sigma = n, int(text.max()) + 1
        order = suffix_array(text, depth)
        bwt = text[order - 1]
        self.levels: list[BitRank] = []
        self.height = max(1, (self.sigma - 1).bit_length())
        rows = bwt
        for k in range(self.height - 1, -1, -1):
            bits = (rows >> k & 1).astype(bool)
            self.levels.append(BitRank(bits))
            rows = np.concatenate([rows[~bits], rows[bits]])
        symbols = np.arange(self.sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        self.base = self.first[:-1] - self._descend(symbols, np.zeros(self.sigma, np.int64))
        # Least value over any interval of suffixes: minima over spans of powers of two.
        self.least = [values[order]]
        while 2 ** len(self.least) <= n:
            x, half = self.least[-1], 2 ** (len(self.least) - 1)
            self.least.append(np.minimum(x[:-half], x[half:]))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(self.levels):
            ones = level.ones(at)
            at = np.where(symbol >> (self.height - 1 - k) & 1, level.zeros + ones, at - ones)
        return at

    def matches(self, queries: np.ndarray, ends: np.ndarray, longest: int, own: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics: for each place `ends` of `queries`, the length of the longest match that ends there, `longest` at most (a symbol below 1 stops it), and its interval of suffixes.

        own: the queries are the indexed text and no end is nearer than `longest` to a 0, so an interval of one suffix is the query's own place: the rest of its match is known and not searched for.
        """
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        length = np.zeros(len(ends), np.int64)
        # The first step starts from all suffixes: its interval is the symbol's own.
        symbol = queries[ends]
        live = np.flatnonzero((symbol > 0) & (symbol < self.sigma)) if longest else np.zeros(0, np.int64)
        low[live], high[live] = self.first[symbol[live]], self.first[symbol[live] + 1]
        live = live[high[live] > low[live]]
        length[live] = 1
        low[length == 0], high[length == 0] = 0, self.n
        for j in range(1, longest):
            live = live[ends[live] - j >= 0]
            symbol = queries[ends[live] - j]
            ok = (symbol > 0) & (symbol < self.sigma)
            live, symbol = live[ok], symbol[ok]
            both = self._descend(np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]])) + np.concatenate([self.base[symbol]] * 2)
            a, b = both[: len(live)], both[len(live) :]
            found = b > a
            live = live[found]
            low[live], high[live] = a[found], b[found]
            length[live] += 1
            if own:
                alone = b[found] - a[found] == 1
                length[live[alone]] = longest
                # Its place in the order of suffixes moves on with each symbol, but the value there is that of one text.
                live = live[~alone]
            if not len(live):
                break
        return length, low, high

    def least_value(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value of the places in each interval (none may be empty)."""
        size = high - low
        level = np.frexp(size.astype(float))[1] - 1
        out = np.empty(len(low), self.least[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - 2**k])
        return out
