"""An FM-index over short word sequences, in numpy: suffix array, wavelet matrix with packed bits, matching statistics.

Each sequence ends in a separator of its own, so suffixes are ordered within as many steps as the longest sequence has words
and no match crosses an end. Sequences carry weights (how often each occurs), so one of many equal copies stands for all.

Only the packed wavelet levels with their ranks, the weights' prefix sums and the bounds of common prefixes are kept; suffixes
and ranks are dropped when these are made. Callers pass at least one sequence, and none is empty.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with rank."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.concatenate((np.zeros(1, np.int32), np.cumsum(counts, dtype=np.int32)[:-1]))
        self.ones = int(counts.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)


class Wavelet:
    """A wavelet matrix: the symbols' bits from the highest down, each level stably parted by the bit above."""

    def __init__(self, symbols: np.ndarray, most: int) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        n = len(symbols)
        for bit in range(max(1, int(most).bit_length()) - 1, -1, -1):
            on = (symbols >> bit) & 1
            bits = Bits(on.astype(np.uint8))
            self.levels.append((bit, bits, n - bits.ones))
            symbols = np.concatenate((symbols[on == 0], symbols[on == 1]))
        self.start = self.descend(np.zeros(most + 1, np.int64), np.arange(most + 1))

    def descend(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where((symbol >> bit) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often `symbol` occurs before `at`."""
        return self.descend(at, symbol) - self.start[symbol]


class Index:
    """Sequences (symbols from 1 on, concatenated; lengths; weights) ready for backward search."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, weights: np.ndarray) -> None:
        k, most = len(lengths), int(symbols.max(initial=0))
        ends = np.cumsum(lengths + 1) - 1  # places of the separators
        n = int(ends[-1]) + 1
        text = np.zeros(n, np.int64)
        inner = np.ones(n, bool)
        inner[ends] = False
        text[inner] = symbols
        ranks = np.empty(n, np.int64)
        ranks[inner] = symbols + k - 1
        ranks[ends] = np.arange(k)
        levels, h, longest = [ranks], 1, int(lengths.max()) + 1
        while h < longest:
            ahead = np.zeros(n, np.int64)
            ahead[: n - h] = ranks[h:] + 1
            key = ranks * (max(n, most + k) + 1) + ahead
            order = np.argsort(key, kind="stable")
            step = np.empty(n, np.int64)
            step[0], step[1:] = 0, np.diff(key[order]) != 0
            ranks = np.empty(n, np.int64)
            ranks[order] = np.cumsum(step)
            levels.append(ranks)
            h *= 2
        suffixes = np.empty(n, np.int64)
        suffixes[ranks] = np.arange(n)
        self.n, self.symbols, self.lengths = n, symbols, lengths
        # common prefixes of neighbours, from the ranks of the doubling
        a, b = suffixes[:-1].copy(), suffixes[1:].copy()
        common = np.zeros(n - 1, np.int64)
        for level in range(len(levels) - 2, -1, -1):
            rank, size = levels[level], 1 << level
            ok = (a < n) & (b < n)
            same = np.zeros(n - 1, bool)
            same[ok] = rank[a[ok]] == rank[b[ok]]
            for x in (a, b, common):
                x[same] += size
        self.lcp = np.concatenate((np.zeros(1, np.int64), common, np.zeros(1, np.int64))).astype(np.int32)
        self.left, self.right = self._bounds()
        self.wavelet = Wavelet(text[suffixes - 1], most)
        self.first = k + np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bincount(symbols, minlength=most + 1))))
        owner = np.repeat(np.arange(k), lengths + 1)
        self.weight = np.concatenate((np.zeros(1, np.int64), np.cumsum(weights[owner[suffixes]])))

    def _bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """For each boundary the nearest boundaries on both sides with a shorter common prefix."""
        size = len(self.lcp)
        left, right = np.zeros(size, np.int32), np.full(size, size - 1, np.int32)
        at, depth = np.flatnonzero(self.lcp >= 1), 1
        while len(at):
            cut = np.flatnonzero(np.diff(at) > 1) + 1
            starts, ends = np.r_[0, cut], np.r_[cut, len(at)]
            run = np.repeat(np.arange(len(starts)), ends - starts)
            own = self.lcp[at] == depth
            left[at[own]] = (at[starts] - 1)[run[own]]
            right[at[own]] = (at[ends - 1] + 1)[run[own]]
            depth += 1
            at = at[~own]
        return left, right

    def statistics(self, least: int = 2) -> np.ndarray:
        """For each place of the sequences the length of the longest match, starting there, of weight `least` or more.

        All sequences are streamed at once, from their ends backward: a match is extended by the word before it while its
        interval weighs enough, and otherwise shortened at its far end to the enclosing interval.
        """
        k = len(self.lengths)
        starts = np.cumsum(self.lengths) - self.lengths
        out = np.zeros(len(self.symbols), np.int64)
        active = np.arange(k)
        at = starts + self.lengths - 1
        low, high, depth = np.zeros(k, np.int64), np.full(k, self.n), np.zeros(k, np.int64)
        while len(active):
            c = self.symbols[at]
            m = len(active)
            both = self.first[np.r_[c, c]] + self.wavelet.rank(np.r_[c, c], np.r_[low, high])
            new_low, new_high = both[:m], both[m:]
            ok = self.weight[new_high] - self.weight[new_low] >= least
            root = ~ok & (depth == 0)
            near, far = self.lcp[low], self.lcp[high]
            pivot = np.where(near >= far, low, high)
            short = np.maximum(near, far)
            up = ~ok & ~root
            to_root = root | (up & (short == 0))
            low = np.where(ok, new_low, np.where(to_root, 0, self.left[pivot]))
            high = np.where(ok, new_high, np.where(to_root, self.n, self.right[pivot]))
            depth = np.where(ok, depth + 1, np.where(root, 0, short))
            moved = ok | root
            out[at[moved]] = depth[moved]
            at = at - moved
            live = at >= starts[active]
            if not live.all():
                active, at, low, high, depth = (x[live] for x in (active, at, low, high, depth))
        return out
