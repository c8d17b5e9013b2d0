"""Byte-pair merges of many words at once, replayed over an index from token pairs to word positions.

The words of a whole block lie in one array, and an index holds, for every place, the rank of the pair
that starts there. Words never interact, so the rank order matters within a word only: one sweep over
the index applies, for every word, the entry of its lowest rank (the leftmost of equals), and then only
the pairs with the touched neighbours are looked up anew. Sweeps repeat until no word has an entry;
words without one leave the arrays. That equals taking the ranks one by one over the whole block, and
needs as many sweeps as the longest word has merges instead of one step for each of 50,000 ranks.

A word of more than ``LONG`` symbols would need as many sweeps as it has merges; it is replayed by itself
instead, from an index of ranks and places in rank order (a heap), where each merge touches two neighbours.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np

#: Symbols of a word from which on it is replayed by itself.
LONG = 64

#: The entry of a pair that doesn't merge.
NONE = np.int64(1 << 62)


class Merges:
    """``pairs``: (left id, right id) to (rank, id of the two together)."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        keys = np.fromiter((a << 32 | b for a, b in pairs), np.int64, len(pairs))
        values = np.fromiter((rank << 32 | made for rank, made in pairs.values()), np.int64, len(pairs))
        by = np.argsort(keys)
        self.keys, self.values = keys[by], values[by]
        self.table: dict[int, int] = {}

    def entries(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 32 | id for each pair, or NONE."""
        if not len(self.keys):
            return np.full(len(left), NONE)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def long(self, symbols: np.ndarray) -> list[int]:
        """Ids of one word: always the lowest rank, the leftmost of equals, by a heap of (rank, place)."""
        if not self.table:
            self.table = dict(zip(self.keys.tolist(), self.values.tolist(), strict=True))
        get, none, low = self.table.get, int(NONE), 0xFFFFFFFF
        n = len(symbols)
        index = self.entries(symbols[:-1], symbols[1:])
        at = np.flatnonzero(index != NONE)
        heap = ((index[at] >> 32 << 32) | at).tolist()
        heapify(heap)
        found, entry = symbols.tolist(), [*index.tolist(), none]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = heappop(heap)
            i = top & low
            if entry[i] >> 32 != top >> 32:
                continue  # merged away, or another pair by now
            made = found[i] = entry[i] & low
            j = after[i]
            k = after[i] = after[j]
            entry[i] = entry[j] = none
            if k < n:
                before[k] = i
                entry[i] = get(made << 32 | found[k], none)
                if entry[i] != none:
                    heappush(heap, entry[i] >> 32 << 32 | i)
            p = before[i]
            if p >= 0:
                entry[p] = get(found[p] << 32 | made, none)
                if entry[p] != none:
                    heappush(heap, entry[p] >> 32 << 32 | p)
        out, i = [], 0
        while i < n:
            out.append(found[i])
            i = after[i]
        return out

    def replay(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has; from their first symbols and how many those are."""
        symbols = symbols.astype(np.int64)
        large = np.flatnonzero(sizes > LONG)
        if not len(large):
            return self._sweeps(symbols, sizes)
        ends = np.cumsum(sizes)
        alone = [self.long(symbols[ends[i] - sizes[i] : ends[i]]) for i in large.tolist()]
        small = sizes <= LONG
        ids, counts = self._sweeps(symbols[np.repeat(small, sizes)], sizes[small])
        total = np.zeros(len(sizes), np.int64)
        total[small], total[large] = counts, [len(a) for a in alone]
        out, of_small = np.empty(int(total.sum()), np.uint32), np.repeat(small, total)
        out[of_small] = ids
        out[~of_small] = np.concatenate([np.array(a, np.uint32) for a in alone])
        return out, total

    def _sweeps(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros(len(sizes), np.int64)
        word = np.flatnonzero(sizes)  # numbers of the words that are still worked on
        sizes = sizes[word]
        index = np.full(len(symbols), NONE)
        if len(symbols) > 1:
            index[:-1] = self.entries(symbols[:-1], symbols[1:])
            index[np.cumsum(sizes) - 1] = NONE
        done: list[np.ndarray] = []
        order: list[np.ndarray] = []
        while len(word):
            starts = np.cumsum(sizes) - sizes
            least = np.minimum.reduceat(index, starts)
            over = least == NONE
            if over.any():
                ready = np.repeat(over, sizes)
                done.append(symbols[ready].astype(np.uint32))
                order.append(np.repeat(word[over], sizes[over]))
                counts[word[over]] = sizes[over]
                symbols, index = symbols[~ready], index[~ready]
                word, sizes, least = word[~over], sizes[~over], least[~over]
                if not len(word):
                    break
                starts = np.cumsum(sizes) - sizes
            hits = np.flatnonzero(index == np.repeat(least, sizes))
            owner = np.searchsorted(starts, hits, side="right") - 1
            first = np.ones(len(hits), bool)
            first[1:] = owner[1:] != owner[:-1]
            place = hits[first]
            symbols[place] = least & np.int64(0xFFFFFFFF)
            stay = np.ones(len(symbols), bool)
            stay[place + 1] = False
            symbols, index = symbols[stay], index[stay]
            place -= np.arange(len(place))
            sizes = sizes - 1
            starts = np.cumsum(sizes) - sizes
            # only the touched neighbours: the pair that starts here, and the one that ends here
            index[place] = NONE
            right = place[place < starts + sizes - 1]
            index[right] = self.entries(symbols[right], symbols[right + 1])
            left = place[place > starts] - 1
            index[left] = self.entries(symbols[left], symbols[left + 1])
        if not done:
            return np.zeros(0, np.uint32), counts
        return np.concatenate(done)[np.argsort(np.concatenate(order), kind="stable")], counts


def cut(ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The ids of each word as little-endian 32-bit numbers."""
    flat, ends = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]
