"""A compressed FM-index over numbers: bounded suffix order, wavelet tree, backward search for many patterns at once.

The text is a list of segments of words (64-bit numbers), an end mark after each. Suffixes are sorted by their first
``depth`` words, ties by position, which is all that backward search for patterns of up to ``depth`` words needs: the
counts that an interval of a shorter pattern takes from the transformed text don't depend on the order within it.

Only the index is kept: the alphabet, the wavelet tree of the transformed text, a bit for each row that begins a group with
equal ``depth - 1`` words, and positions sampled where a group of several rows with equal ``depth`` words begins. The text and
the suffix order are dropped once it is built; documents are streamed through it.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with rank in constant time."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)
        self.ones = int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletTree:
    """Rank of any symbol in a sequence, stored level by level from the highest bit down."""

    def __init__(self, symbols: np.ndarray, most: int):
        self.levels = max(1, int(most).bit_length())
        self.bits, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(np.uint8)
            self.bits.append(Bits(bit))
            self.zeros.append(len(symbols) - self.bits[-1].ones)
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray, base: np.ndarray | None = None) -> np.ndarray:
        """How often each symbol comes before place i; base: the same at place 0 (see bases), which spares half the work."""
        for level in range(self.levels):
            one = ((symbol >> (self.levels - 1 - level)) & 1).astype(bool)
            ones = self.bits[level].rank(i)
            i = np.where(one, self.zeros[level] + ones, i - ones)
        return i - base[symbol] if base is not None else i

    def bases(self, most: int) -> np.ndarray:
        """Where each symbol's rows begin on the level below the last."""
        symbol = np.arange(most + 1)
        return self.rank(symbol, np.zeros(most + 1, dtype=np.int64))


def _ranked(first: np.ndarray, second: np.ndarray, shift: int) -> np.ndarray:
    """Dense ranks of the pairs (first[i], second[i + shift]); past the end second counts as 0."""
    late = np.zeros_like(second)
    late[: max(0, len(second) - shift)] = second[shift:]
    return np.unique(first * (int(second.max(initial=0)) + 1) + late, return_inverse=True)[1]


def _heads(ranks: np.ndarray) -> np.ndarray:
    """Whether each row of sorted ranks begins a group."""
    return np.concatenate([[True], ranks[1:] != ranks[:-1]]) if len(ranks) else np.zeros(0, dtype=bool)


class FMIndex:
    """Index of segments of words for patterns of up to depth words (at least 4)."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, depth: int):
        self.depth, self.rows = depth, int((sizes + 1).sum())
        self.symbols, ids = np.unique(words, return_inverse=True)
        most = len(self.symbols)
        text = np.zeros(self.rows, dtype=np.int64)
        text[np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)] = ids + 1
        ranks = {1: text}
        p = 1
        while 2 * p <= depth:
            ranks[2 * p] = _ranked(ranks[p], ranks[p], p)
            p *= 2

        def upto(m: int) -> np.ndarray:
            have = max(x for x in ranks if x <= m)
            got = ranks[have]
            while have < m:
                more = max(x for x in ranks if x <= m - have)
                got = _ranked(got, ranks[more], have)
                have += more
            return got

        less, whole = upto(depth - 1), upto(depth)
        ranks.clear()
        suffixes = np.argsort(whole, kind="stable")
        group = _heads(less[suffixes])
        self.group = Bits(group)
        self.group_edges = np.append(np.flatnonzero(group), self.rows).astype(np.int32)
        head = _heads(whole[suffixes])
        several = head & ~np.append(head[1:], True)
        self.several, self.earliest = Bits(several), suffixes[several].astype(np.int32)
        self.tree = WaveletTree(text[suffixes - 1].astype(np.int32), most)
        self.base = self.tree.bases(most).astype(np.int32)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=most + 1))])[:-1].astype(np.int32)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: the intervals of symbol + pattern."""
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]), self.base)
        return self.before[symbol] + both[: len(low)], self.before[symbol] + both[len(low) :]

    def shorten(self, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the first depth - 1 words of a pattern whose interval begins at low."""
        g = self.group.rank(low + 1) - 1
        return self.group_edges[g], self.group_edges[g + 1]

    def repeats(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Streams the indexed segments through it, backwards: (segment, offset) of each depth-word window that also starts earlier in the text.

        Keeps for each segment the interval of its longest match of at most depth words, which is its matching statistic
        cut at the threshold, and reports where it reaches the threshold with an earlier place in the interval.
        """
        starts = np.cumsum(sizes) - sizes  # in the stream; in the text there is an end mark after each
        symbol = (np.searchsorted(self.symbols, words) + 1).astype(np.int32)
        active = np.argsort(-sizes, kind="stable")
        active = active[sizes[active] >= self.depth]
        low, high = np.zeros(len(active), np.int32), np.full(len(active), self.rows, np.int32)
        seg, off = [], []
        for step in range(int(sizes[active].max(initial=0))):
            live = int(np.searchsorted(-sizes[active], -step, "left"))  # sizes above step
            active, low, high = active[:live], low[:live], high[:live]
            at = starts[active] + sizes[active] - 1 - step
            if step >= self.depth:
                low, high = self.shorten(low)
            low, high = self.extend(symbol[at], low, high)
            if step >= self.depth - 1:
                shared = np.flatnonzero(self.several.get(low))
                first = self.earliest[self.several.rank(low[shared])]
                shared = shared[first < at[shared] + active[shared]]
                seg.append(active[shared])
                off.append(at[shared] - starts[active[shared]])
        if not seg:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(seg), np.concatenate(off)
