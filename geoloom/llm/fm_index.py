"""A compressed FM-index over word sequences: a wavelet matrix of the Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


def ranked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of the pairs (a[i], b[i])."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


class BitVector:
    """Bits, 64 to a word, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        self.words = np.packbits(np.append(bits, np.zeros(-len(bits) % 64 + 64, bool)), bitorder="little").view(np.uint64)
        self.counts = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before the place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[word] + np.bitwise_count(self.words[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the one that k ones stand before."""
        word = np.searchsorted(self.counts, k, "right") - 1
        left, bits, at = k - self.counts[word], self.words[word], word << 6
        for half in (32, 16, 8, 4, 2, 1):
            low = bits & np.uint64((1 << half) - 1)
            ones = np.bitwise_count(low)
            beyond = left >= ones
            left = np.where(beyond, left - ones, left)
            bits = np.where(beyond, bits >> np.uint64(half), low)
            at = np.where(beyond, at + half, at)
        return at


class WaveletMatrix:
    """Rank queries on a sequence of numbers, in a bit for each number and level."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bit = (values >> level & 1).astype(bool)
            self.bits.append(BitVector(bit))
            self.zeros.append(len(values) - int(bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])
        self.starts = np.zeros(sigma, np.int64)
        self.starts = self.walk(np.arange(sigma), self.starts)

    def walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the position at goes on the way down to the symbol."""
        for i, level in enumerate(reversed(range(self.levels))):
            ones = self.bits[i].rank(at)
            at = np.where(symbols >> level & 1, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often the symbol occurs before the position."""
        return self.walk(symbols, at) - self.starts[symbols]


class FMIndex:
    """Backward search over texts, each ended by the symbol 0; symbols of texts are 1 and more.

    Suffixes are sorted by their first ``length`` symbols only, which is all
    that a search for patterns up to that length needs. What is kept is
    compressed: the wavelet matrix of the Burrows-Wheeler transform, a bit for
    each suffix that tells where another ``length`` symbols begin, the same for
    one symbol less, and of each such interval the smallest owner. The order of
    the suffixes is not kept.
    """

    def __init__(self, symbols: np.ndarray, sigma: int, length: int, owner: np.ndarray):
        """owner: a number for each symbol, such as that of its document."""
        self.length, self.size = length, len(symbols)
        ahead = lambda r, k: np.append(r[k:], np.zeros(min(k, len(r)), r.dtype))
        rank, reach, steps = symbols.astype(np.int64), 1, {}
        while reach < length:
            steps[reach] = rank
            more = min(reach, length - reach)
            if more < reach:
                rank = ranked(rank, ahead(rank, length - reach))
                reach = length
            else:
                rank, reach = ranked(rank, ahead(rank, reach)), 2 * reach
        order = np.argsort(rank, kind="stable")
        # A context of one symbol less: the longest doubled prefix twice, overlapping.
        half = max(steps, default=1)
        part = steps.get(half, rank)
        new = self.begins(rank[order], rank[order])
        self.intervals = BitVector(new)
        self.smallest = np.minimum.reduceat(owner[order], np.flatnonzero(new)) if len(order) else owner
        if length - 1 >= half:
            self.shorter = BitVector(self.begins(part[order], ahead(part, max(0, length - 1 - half))[order]))
        else:
            self.shorter = BitVector(self.begins(part * 0, part * 0))
        self.n_shorter = int(self.shorter.counts[-1])
        self.bwt = WaveletMatrix(symbols[order - 1].astype(np.int64), sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])

    @staticmethod
    def begins(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a run of equal pairs begins at each place."""
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return new

    def owners(self, low: np.ndarray) -> np.ndarray:
        """The smallest owner in the interval of the length symbols that begins at low."""
        return self.smallest[self.intervals.rank(low + 1) - 1]

    def step(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From the intervals of patterns to those of the patterns with a symbol put before."""
        return self.first[symbols] + self.bwt.rank(symbols, low), self.first[symbols] + self.bwt.rank(symbols, high)

    def widened(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first length - 1 symbols of the suffixes at low."""
        group = self.shorter.rank(low + 1)
        last = group == self.n_shorter
        return self.shorter.select(group - 1), np.where(last, self.size, self.shorter.select(np.where(last, 0, group)))

    def matching(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each position of the streamed texts the start of the interval of the length symbols there, or -1.

        Each text is read from its end. Its last length symbols are searched;
        then the interval is widened to one symbol less and the next symbol put
        before. Where that does not occur, the reading begins anew with the new
        symbol, and the windows that hold it and end beyond it, but before the
        end of what was lost, are searched each for itself.
        """
        out = np.full(len(symbols), -1, np.int64)
        order = np.argsort(-sizes, kind="stable")
        ends = (starts + sizes)[order]
        sizes = sizes[order]
        low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.first[-1], np.int64)
        matched = np.zeros(len(sizes), np.int64)
        begins, apart = starts[order], []
        for t in range(1, int(sizes.max(initial=0)) + 1):
            active = int(np.searchsorted(-sizes, -t, "right"))
            a, b, m = low[:active], high[:active], matched[:active]
            full = m == self.length
            if full.any():
                a[full], b[full] = self.widened(a[full])
                m[full] -= 1
            symbol = symbols[ends[:active] - t]
            a[:], b[:] = self.step(symbol, a, b)
            m += 1
            lost = a >= b
            if lost.any():
                at = ends[:active][lost] - t
                window = at[:, None] - np.arange(self.length)
                apart.append(window[(window >= begins[:active][lost][:, None]) & (window + self.length < (at + m[lost])[:, None]) & (window + self.length > at[:, None] + 1)])
                a[lost], b[lost] = self.first[symbol[lost]], self.first[symbol[lost] + 1]
                m[lost] = 1
            done = m == self.length
            out[(ends[:active] - t)[done]] = a[done]
        if apart:
            at = np.unique(np.concatenate(apart))
            low, high = np.zeros(len(at), np.int64), np.full(len(at), self.first[-1], np.int64)
            for k in reversed(range(self.length)):
                low, high = self.step(symbols[at + k], low, high)
                at, low, high = (x[low < high] for x in (at, low, high))
            out[at] = low
        return out
