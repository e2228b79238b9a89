"""An FM-index over integer words: wavelet matrix with packed bits, LCP intervals, matching statistics in lock-step."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector in 64-bit words with a count before each word."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros((self.n // 64 + 1) * 64, dtype=np.uint8)
        padded[: self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)].astype(np.int32)
        self.zeros = self.n - int(self.before[-1])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits before i."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))


class Wavelet:
    """Wavelet matrix of a sequence over 0 .. 2**bits - 1."""

    def __init__(self, s: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for b in range(bits - 1, -1, -1):
            one = (s >> b) & 1
            self.levels.append(Bits(one.astype(np.uint8)))
            s = np.concatenate([s[one == 0], s[one == 1]])
        symbols = np.arange(1 << bits, dtype=np.int64)
        self.start = self._down(symbols, np.zeros(len(symbols), dtype=np.int64))

    def _down(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(self.levels):
            ones = level.ones(at)
            at = np.where((c >> (self.bits - 1 - k)) & 1, level.zeros + ones, at - ones)
        return at

    def rank(self, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often c is found in [0, i), and in [0, j)."""
        at = self._down(np.concatenate([c, c]), np.concatenate([i, j])) - np.tile(self.start[c], 2)
        return at[: len(c)], at[len(c) :]


class Least:
    """Range minima over a sparse table."""

    def __init__(self, x: np.ndarray):
        self.rows = [x]
        while 2 << (len(self.rows) - 1) <= len(x):
            last, step = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-step], last[step:]))
        width = max(len(r) for r in self.rows)
        self.flat = np.concatenate([np.pad(r, (0, width - len(r)), mode="edge") for r in self.rows])
        self.width = width

    def over(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Minimum of [i, j), which must not be empty."""
        k = np.frexp((j - i).astype(np.float64))[1].astype(np.int64) - 1
        at = k * self.width
        return np.minimum(self.flat[at + i], self.flat[at + j - (1 << k)])


class FMIndex:
    """Over pieces (arrays of words > 0) that carry an owner each; a 0 ends every piece.

    `earlier` gives matching statistics: for each position of a query, the length of the longest match that starts
    there and is also found in a piece whose owner is smaller than the query's own.
    """

    def __init__(self, words: np.ndarray, starts: np.ndarray, owners: np.ndarray):
        """words: all pieces one after another, each ended by a 0; starts: where each begins; owners: of each."""
        n = len(words)
        self.n = n
        longest = int(np.diff(np.r_[starts, n]).max(initial=1))
        rank, ranks, step = words.astype(np.int64), [], 1
        rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
        while True:  # prefix doubling; ranks[k] compares 2**k words, and runs on over the ends of pieces
            ranks.append(rank.astype(np.int32))
            if step >= longest or (len(rank) and rank.max() == n - 1):
                break
            key = rank * (n + 1)
            key[: n - step] += rank[step:] + 1
            order = np.argsort(key)
            new = np.empty(n, dtype=np.int64)
            new[order] = np.cumsum(np.r_[0, np.diff(key[order]) != 0])
            rank, step = new, step * 2
        sa = np.argsort(rank, kind="stable")
        self.lcp = np.zeros(n + 1, dtype=np.int64)
        a, b = sa[:-1].copy(), sa[1:].copy()
        length = np.zeros(max(0, n - 1), dtype=np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            inside = np.flatnonzero(b < n) if k == len(ranks) - 1 else np.flatnonzero((a < n) & (b < n))
            same = inside[ranks[k][a[inside]] == ranks[k][b[inside]]]
            a[same] += 1 << k
            b[same] += 1 << k
            length[same] += 1 << k
        # matches end at the ends of pieces
        end = np.r_[starts[1:], n] - 1
        piece = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
        left = (end[piece] - np.arange(n))[sa]
        self.lcp[1:n] = np.minimum(length, np.minimum(left[:-1], left[1:]))
        self.down, self.up = self._nearest_smaller(self.lcp)
        bits = max(1, int(words.max(initial=1)).bit_length())
        self.bwt = Wavelet(words[sa - 1].astype(np.int64), bits)
        self.first = np.zeros((1 << bits) + 1, dtype=np.int64)
        self.first[1:] = np.cumsum(np.bincount(words, minlength=1 << bits))
        self.owner = Least(owners[piece][sa])

    @staticmethod
    def _nearest_smaller(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place, the nearest place before and after it with a smaller value (itself where there is none)."""
        out = []
        for way in (-1, 1):
            at = np.clip(np.arange(len(x)) + way, 0, len(x) - 1)
            open_ = np.flatnonzero(x[at] >= x)
            while len(open_):
                to = at[at[open_]]
                moved = to != at[open_]
                at[open_] = to
                open_ = open_[moved & (x[to] >= x[open_])]
            out.append(at)
        return out[0], out[1]

    def earlier(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """Matching statistics of queries words[starts[k]:ends[k]], all searched backward together."""
        out = np.zeros(len(words), dtype=np.int32)
        q = np.arange(len(starts))
        at = ends.astype(np.int64) - 1
        lo, hi = np.zeros(len(q), dtype=np.int64), np.full(len(q), self.n, dtype=np.int64)
        depth = np.zeros(len(q), dtype=np.int64)
        own = owners
        while True:
            going = at >= starts[q]
            if not going.all():
                q, at, lo, hi, depth, own = q[going], at[going], lo[going], hi[going], depth[going], own[going]
            if not len(q):
                return out
            c = words[at].astype(np.int64)
            a, b = self.bwt.rank(c, lo, hi)
            a, b = a + self.first[c], b + self.first[c]
            good = a < b
            some = np.flatnonzero(good)
            good[some] = self.owner.over(a[some], b[some]) < own[some]
            out[at[good]] = depth[good] + 1
            lo, hi = np.where(good, a, lo), np.where(good, b, hi)
            stuck = ~good & (depth == 0)
            at = np.where(good | stuck, at - 1, at)
            shrink = ~good & ~stuck
            depth = depth + good
            if shrink.any():
                s = np.flatnonzero(shrink)
                edge = np.where(self.lcp[lo[s]] >= self.lcp[hi[s]], lo[s], hi[s])
                to = self.lcp[edge]
                root = to == 0
                lo[s] = np.where(root, 0, self.down[edge])
                hi[s] = np.where(root, self.n, self.up[edge])
                depth[s] = to
