"""Packing into windows by minimum bin slack.

A document's ids, and then its end id, are cut into whole windows from its start; what remains is its
last piece. The lengths of these remainders form a multiset. Windows are filled one pattern at a time:
the longest length left is set, and a bitset dynamic programme over the others' counts finds the
multiset whose sum comes closest to the capacity (the lightest slack), with the counts found by going
back through the bitsets. A pattern serves as many windows as the counts allow, so there are no more
patterns than lengths.

Only the counts by length (at most ``capacity``) reach the driver; places are given by ranks that are
counted within (length, salt) groups, so that no length needs to be in one task.

Cases: a null or empty text is the end id alone; rows that repeat a document are packed each for
itself; a text longer than a window takes several; extra columns are ignored; no rows, no sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import released, staged
from .tokens import word_vocabulary
from .words import text_blocks

#: Rows of one length that a task ranks, about.
RANKED = 200_000


def best_filling(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length sum up to ``capacity`` or as closely below it as can be."""
    mask = (1 << (capacity + 1)) - 1
    reached, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, unit = min(counts[length], capacity // length), 1
        while left:
            n = min(unit, left)
            steps.append((length, n, reached))
            reached |= (reached << (length * n)) & mask
            left -= n
            unit *= 2
        if reached >> capacity & 1:
            break
    total, used = reached.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> total & 1:
            total -= length * n
            used[length] = used.get(length, 0) + n
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths with their counts, windows so filled) until all lengths are used up."""
    left = {k: n for k, n in counts.items() if n and k < capacity}
    out = [({capacity: 1}, counts[capacity])] if counts.get(capacity) else []
    while left:
        longest = max(left)
        others = {k: n - (k == longest) for k, n in left.items() if n > (k == longest) and k <= capacity - longest}
        pattern = best_filling(others, capacity - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        out.append((pattern, times))
        for k, n in pattern.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def _ranges(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length, by rank: (first rank, count in a window, first sequence, offset of the first)."""
    out: dict[int, list] = {}
    seen: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            n = pattern[length]
            out.setdefault(length, []).append((seen.get(length, 0), n, sequence, offset))
            seen[length] = seen.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def _cutter(path: str, end_id: int, capacity: int):
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = word_vocabulary(path)
        for batch in batches:
            docs = batch.column(0)
            owner, start, length, crc, total = [], [], [], [], []
            for first, _, texts in text_blocks(batch.column(1), 4 << 20):
                for i, ids in enumerate(vocabulary.encode([t or "" for t in texts]), first):
                    ids += end
                    n = len(ids) // 4
                    for at in range(0, n, capacity):
                        part = ids[4 * at : 4 * (at + capacity)]
                        owner.append(i)
                        start.append(at)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        total.append(n)
            yield pa.RecordBatch.from_arrays(
                [docs.take(pa.array(owner, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    return released(cut)


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """One row for each piece of each document."""
    return docs.select("doc_id", "text").mapInArrow(_cutter(path, end_id, capacity), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with a gapless rank among the pieces of equal length, from 0."""
    size = rows.count()
    salts = max(16, size // RANKED)
    # whole windows are one length, so the salt alone deals them out
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    sums = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sums.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32"))
    own = salted.withColumn("rank", within - 1)
    return own.join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before")).drop("salt", "before")


def _placer(ranges: dict[int, np.ndarray]):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                table = ranges[length]
                row = table[np.searchsorted(table[:, 0], ranks[at], side="right") - 1]
                k = ranks[at] - row[:, 0]
                sequence[at] = row[:, 2] + k // row[:, 1]
                offset[at] = row[:, 3] + k % row[:, 1] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], batch.column(0), pa.array(sequence), pa.array(offset)], [*batch.schema.names[2:], "length", "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 4096) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset for every piece."""
    rows = staged(pieces(docs, path, end_id, capacity), "pieces")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # capacity rows at most
    ranges = _ranges(plan(counts, capacity))
    placed = ranked(rows).select("length", "rank", "doc_id", "start", "ids_crc32", "doc_tokens")
    out = placed.mapInArrow(_placer(ranges), "doc_id bigint, start bigint, ids_crc32 bigint, doc_tokens bigint, length bigint, sequence_id bigint, offset bigint")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
