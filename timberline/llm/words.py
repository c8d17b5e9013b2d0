"""Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 texts and hashes of runs of them, by numpy on whole blocks.

Hashes are sums of table values times powers of an odd number, modulo 2**64, so that the hash of any
span comes from two prefix sums; a finaliser then mixes the bits. Where equality must hold, two lanes
(128 bits) are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at once; longer texts are cut at white space.
SEGMENT = 1 << 20

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = (0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the lane's base, and of its inverse, modulo 2**64."""
    held = _POWERS.get(lane)
    if held is None or len(held[0]) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        out = []
        for base in (_BASE[lane], pow(_BASE[lane], -1, 1 << 64)):
            table = np.full(size + 1, base, np.uint64)
            table[0] = 1
            out.append(np.multiply.accumulate(table))
        held = _POWERS[lane] = (out[0], out[1])
    return held


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """Mixed hash of values[start:end] for each span."""
    up, down = powers(lane, len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a block of bytes."""
    inside = np.zeros(len(buf) + 2, bool)
    np.logical_not(_SPACES[buf], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def _segments(buf: np.ndarray) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(buf):
        end = min(len(buf), at + SEGMENT)
        if end < len(buf):
            block = _SPACES[buf[at:end]]
            back = int(np.argmax(block[::-1]))
            if block[len(block) - 1 - back]:
                end -= back
            else:
                size = SEGMENT
                while end < len(buf) and not _SPACES[buf[end - 1]]:
                    more = np.flatnonzero(_SPACES[buf[end : end + size]])
                    end = end + int(more[0]) + 1 if len(more) else min(len(buf), end + size)
        yield at, end
        at = end


def hashes(buf: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends and 64-bit hashes of a block of bytes; ``lower``: A-Z count as a-z."""
    firsts, lasts, found = [], [], []
    for at, end in _segments(buf):
        part = buf[at:end]
        starts, ends = bounds(part)
        found.append(spans(_TABLE[_LOWER[part] if lower else part], starts, ends))
        firsts.append(starts + at)
        lasts.append(ends + at)
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(found)


def blocks(texts: list[bytes | None], most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of up to ``most`` bytes, or one longer text."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or b"") + 1
        if i > first and size + n > most:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def text_blocks(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int, list]]:
    """The same runs of an Arrow column of texts, with their values: only one run is a Python list at a time."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64) + 1)
    first = 0
    while first < len(ends):
        start = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, start + most, side="right")))
        yield first, last, column.slice(first, last - first).to_pylist()
        first = last


def hashed_texts(texts: list[bytes | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of several texts, and where each text's words start (one entry more than texts)."""
    joined = np.frombuffer(b" ".join(t or b"" for t in texts), np.uint8)
    starts, _, found = hashes(joined, lower)
    ends = np.cumsum([len(t or b"") + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    return found, np.concatenate([[0], np.searchsorted(starts, ends)]).astype(np.int64)
