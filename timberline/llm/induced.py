"""Suffix arrays of integer sequences by induced sorting, and permuted common prefixes, in numpy.

Suffixes are of type S (smaller than the next one) or L (larger). The leftmost S-suffixes of runs are sorted first: their
substrings by one round of induction, their order, where substrings repeat, by the suffix array of the
sequence of their names (recursively). Everything else follows by two scans, left to right for L, right to left
for S: an entry of the array places its left neighbour at the next free place of that one's bucket.

A scan is taken in stretches: all places up to the first free one are final, so that their left neighbours
can be placed at once. A stretch is about the square root of what has been scanned, or a whole bucket.
"""

from __future__ import annotations

import numpy as np


def types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S. The last value must be the only smallest one."""
    up = np.diff(text.astype(np.int64))
    turns = np.flatnonzero(up)
    return np.append(np.repeat(up[turns] > 0, np.diff(turns, prepend=-1)), True)


def _placed(array: np.ndarray, text: np.ndarray, wanted: np.ndarray, free: np.ndarray, step: int) -> None:
    """Scans ``array`` (free places are -1) in the direction of ``step``: the left neighbour of every entry, where
    it is wanted, goes to the free place of its bucket, which then moves by ``step``."""
    at, end, reach = (0, len(array), 64) if step > 0 else (len(array), 0, 64)
    while at != end:
        stop = at
        while stop != end:  # up to the first free place
            look = array[stop : stop + reach] if step > 0 else array[max(0, stop - reach) : stop][::-1]
            gaps = look < 0
            gap = int(gaps.argmax())
            if gaps[gap]:
                stop += step * gap
                break
            stop += step * len(look)
            reach *= 2
        before = (array[at:stop] if step > 0 else array[stop:at][::-1]) - 1
        reach = max(64, 2 * len(before))
        at = stop
        before = before[before >= 0]
        before = before[wanted[before]]
        if not len(before):
            continue
        bucket = text[before]
        if len(before) == 1:
            array[free[bucket[0]]] = before[0]
            free[bucket[0]] += step
            continue
        by = bucket.argsort(kind="stable")
        bucket = bucket[by]
        edges = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
        first, size = np.empty(len(edges) + 1, np.int64), np.empty(len(edges) + 1, np.int64)
        first[0], first[1:] = 0, edges
        size[:-1], size[-1] = first[1:] - first[:-1], len(bucket) - first[-1]
        own = bucket[first]
        array[np.repeat(free[own] - step * first, size) + step * np.arange(len(bucket))] = before[by]
        free[own] += step * size


def _induced(text: np.ndarray, small: np.ndarray, order: np.ndarray, buckets: int) -> np.ndarray:
    """The suffix array that follows from ``order``, the leftmost S-suffixes, grouped by bucket."""
    n_large = np.bincount(text[~small], minlength=buckets)
    n_small = np.bincount(text[small], minlength=buckets)
    # left to right: buckets hold their L-suffixes, then the leftmost S-suffixes
    n_left = np.bincount(text[order], minlength=buckets)
    start = np.cumsum(n_large + n_left) - n_large - n_left
    array = np.full(int((n_large + n_left).sum()), -1, np.int64)
    is_left = np.repeat(np.tile([False, True], buckets), np.stack([n_large, n_left], 1).ravel())
    array[is_left] = order
    _placed(array, text, ~small, start.copy(), 1)
    large = array[~is_left]
    # right to left: buckets hold their L-suffixes, then all S-suffixes
    whole = np.full(len(text), -1, np.int64)
    is_small = np.repeat(np.tile([False, True], buckets), np.stack([n_large, n_small], 1).ravel())
    whole[~is_small] = large
    whole[0] = len(text) - 1
    _placed(whole, text, small, np.cumsum(n_large + n_small) - 1, -1)
    return whole


def _names(text: np.ndarray, left: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Names of the leftmost S-substrings, by place in the text: equal ones share theirs, smaller ones have smaller."""
    length = np.diff(left, append=left[-1]) + 1
    place = np.searchsorted(left, order)
    a, b, size = order[:-1], order[1:], length[place]
    pending = np.flatnonzero(size[:-1] == size[1:])
    same = np.zeros(len(order), bool)
    k = 0
    while len(pending):
        pending = pending[text[a[pending] + k] == text[b[pending] + k]]
        k += 1
        done = size[pending] == k
        same[pending[done] + 1] = True
        pending = pending[~done]
    out = np.empty(len(left), np.int64)
    out[place] = np.cumsum(~same) - 1
    return out


def suffix_array(text: np.ndarray, buckets: int | None = None) -> np.ndarray:
    """Places of the suffixes of ``text`` in their order. Its last value must be the only smallest one."""
    if len(text) < 3:
        return np.arange(len(text))[::-1]
    buckets = int(text.max()) + 1 if buckets is None else buckets
    small = types(text)
    left = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    order = left[np.argsort(text[left], kind="stable")]
    if len(left) > 1:
        found = _induced(text, small, order, buckets)
        is_left = np.zeros(len(text), bool)
        is_left[left] = True
        order = found[is_left[found]]
        names = _names(text, left, order)
        if names.max() + 1 < len(names):
            order = left[suffix_array(names)]
    return _induced(text, small, order, buckets)


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The common prefix of the suffixes at ``a`` and ``b``: compared by 8 bytes at once, the rest by single values."""
    n, per = len(text), 8 // text.itemsize
    padded = np.concatenate([text, np.zeros(per, text.dtype)])
    words = np.lib.stride_tricks.as_strided(padded, (n + 1, per), (text.itemsize, text.itemsize)).copy().view(np.uint64).ravel()
    out = np.zeros(len(a), np.int64)
    for values, step, rounds in ((words, per, n), (text, 1, per)):
        live = np.arange(len(a))
        while len(live) and rounds:
            x, y = a[live] + out[live], b[live] + out[live]
            inside = np.maximum(x, y) + step <= n
            live, x, y = live[inside], x[inside], y[inside]
            live = live[values[x] == values[y]]
            out[live] += step
            rounds -= 1
    return out


def common_prefixes(text: np.ndarray, array: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By place in the text: how long a prefix its suffix shares with the one before it in ``array``, and with the one after it.

    Only where the values left of a suffix and of its neighbour differ are they compared; elsewhere the
    prefix is that of the suffix one place to the left, less one."""
    n = len(text)
    before = np.empty(n, np.int64)
    before[array[1:]], before[array[0]] = array[:-1], -1
    place = np.arange(n)
    known = before > 0
    fresh = np.ones(n, bool)
    inner = known & (place > 0)
    fresh[inner] = text[place[inner] - 1] != text[before[inner] - 1]
    at = np.flatnonzero(fresh)
    value = np.zeros(len(at), np.int64)
    has = before[at] >= 0
    value[has] = _common(text, at[has], before[at[has]])
    run = np.cumsum(fresh) - 1
    prefixes = value[run] - (place - at[run])
    after = np.zeros(n, np.int64)
    after[array[:-1]] = prefixes[array[1:]]
    return prefixes, after
