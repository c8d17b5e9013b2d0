"""A Merkle tree over a table, with an inclusion proof for every row.

A row's leaf is the digest of its columns. Leaves of a group (language) in the order of their ids are hashed by runs of
``FANOUT`` until one node is left, the group's root; the groups' roots, in order, are hashed likewise to the
table's root. All digests are lowercase hex text, and what is hashed is such text put together.

Leaves are numbered within their group (a range partitioning and one count for each partition and group), then
gathered in aligned blocks of ``FANOUT ** depth`` leaves: one row of the staged table holds a block's leaves as a
contiguous matrix of 64 bytes a leaf. Within a block numpy reshapes the matrix by the fanout and hashes its rows, level by level;
node ``i``'s parent is ``i // FANOUT``, its siblings are the rest of the parent's row. Roots of blocks are leaves of
the next, much smaller table (one row for 4,096), up to one root for each group. Paths then go down by joins: a
block needs only its own path (siblings left and right of it on each level), from which its leaves' proofs follow.

Cases: null columns and nulls in them count as ``-``; a null id comes first and is never tampered with; null group
is a group of its own, the first; rows with equal ids are ordered by their leaves, so that repeated rows get
the same leaves at neighbouring places; texts are read once, whole; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, released, staged

#: Nodes of a run, and levels that are hashed within one block of ``FANOUT ** DEPTH`` leaves.
FANOUT, DEPTH = 8, 4

#: The columns of a leaf, in order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _field(value: bytes | int | None) -> bytes:
    if value is None:
        return b"-"
    raw = value if isinstance(value, bytes) else str(value).encode()
    return b"%d:%s" % (len(raw), raw)


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, source, lang, n_chars, text) to (doc_id, lang, leaf, changed): the leaf of the tampered row where a row is tampered with."""
    for batch in batches:
        out = ([], [], [], [])
        for at in range(0, len(batch), 512):
            for doc, source, lang, chars, text in zip(*(c.slice(at, 512).to_pylist() for c in batch.columns), strict=True):
                head = hashlib.sha256(b"".join(map(_field, (doc, source, lang, chars))))
                leaf = head.copy()
                leaf.update(_field(text))
                changed = None
                if doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0:
                    head.update(_field(text and text.translate(_LOWER)))
                    changed = head.hexdigest().encode()
                for values, value in zip(out, (doc, lang, leaf.hexdigest().encode(), changed), strict=True):
                    values.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(v, pa.binary()) for v in out[1:])], ["doc_id", "lang", "leaf", "changed"])


def levels(n: int) -> int:
    """How often ``n`` nodes are hashed by runs until one is left."""
    found = 0
    while n > 1:
        n, found = -(-n // FANOUT), found + 1
    return found


def _grown(matrix: np.ndarray, count: int) -> list[np.ndarray]:
    """The node matrices (rows of 64 bytes) of ``count`` more levels; each run of ``FANOUT`` rows becomes one."""
    out = [np.ascontiguousarray(matrix)]
    for _ in range(count):
        below = out[-1].tobytes()
        step = 64 * FANOUT
        made = b"".join([hashlib.sha256(below[at : at + step]).hexdigest().encode() for at in range(0, len(below), step)])
        out.append(np.frombuffer(made, np.uint8).reshape(-1, 64))
    return out


def _siblings(matrix: np.ndarray, i: int) -> tuple[bytes, bytes]:
    """The siblings left and right of node ``i`` in its run."""
    first = i // FANOUT * FANOUT
    return matrix[first:i].tobytes(), matrix[i + 1 : first + FANOUT].tobytes()


def _numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, gapless from 0 in their group, and ``n``, the rows of the group.

    A group may be all rows: it is cut by ranges, and each partition's rows of a group get one offset."""
    part = F.shiftright("_place", 33)
    placed = staged(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_place", F.monotonically_increasing_id()), "placed")
    counts = placed.groupBy(F.col(group).alias("_group"), part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    # one row for each partition and group: a window over a group holds no more rows than there are partitions
    counts = counts.selectExpr("_group", "_part", "_first", "sum(_n) over (partition by _group order by _part) - _n as _before", "sum(_n) over (partition by _group) as n")
    joined = placed.join(counts, (F.col(group) == F.col("_group")) & (part == F.col("_part")))
    return joined.withColumn("pos", F.col("_before") + F.col("_place") - F.col("_first")).drop("_place", "_group", "_part", "_first", "_before")


def _gathered(nodes: DataFrame, depth: int, *more: str) -> DataFrame:
    """(key, block, n, digests, ...): the nodes of each aligned block in order; ``more`` columns as arrays beside the digests."""
    kept = F.array_sort(F.collect_list(F.struct("pos", "digest", *more)))
    rows = nodes.groupBy("key", F.expr(f"pos div {FANOUT**depth}").alias("block")).agg(F.first("n").alias("n"), kept.alias("nodes"))
    return rows.select("key", "block", "n", *(F.col(f"nodes.{c}").alias(c) for c in ("digest", *more)))


def _roots(depth: int):
    """(key, block, n, digests) to (key, pos, n, digest): a block's root is node ``block`` of the next table."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, blocks, ns, digests = (c.to_pylist() for c in batch.columns)
            made = []
            for n, own in zip(ns, digests, strict=True):
                matrix = np.frombuffer(b"".join(own), np.uint8).reshape(-1, 64)
                made.append(_grown(matrix, min(depth, levels(n)))[-1].tobytes())
            above = [-(-n // FANOUT**depth) for n in ns]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(blocks, pa.int64()), pa.array(above, pa.int64()), pa.array(made, pa.binary())], ["key", "pos", "n", "digest"])

    return released(hashed)


_PATH = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
_PATH_SQL = "array<struct<left: binary, right: binary>>"


def _paths(depth: int):
    """(key, block, n, digests, path of the block, root) to the path of each of its nodes: (key, pos, path, root)."""

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, block, n, own, path, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                grown = _grown(np.frombuffer(b"".join(own), np.uint8).reshape(-1, 64), min(depth, levels(n)))
                made = []
                for i in range(len(own)):
                    pairs = [_siblings(m, i // FANOUT**k) for k, m in enumerate(grown[:-1])]
                    made.append([{"left": a, "right": b} for a, b in pairs] + path)
                pos = np.arange(len(own)) + block * FANOUT**depth
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(own), pa.binary()), pa.array(pos, pa.int64()), pa.array(made, _PATH), pa.array([root] * len(own), pa.binary())], ["key", "pos", "path", "root"])

    return released(down)


def tree(nodes: DataFrame, depth: int = DEPTH) -> tuple[DataFrame, list[DataFrame]]:
    """(key, digest) of each key's root, and the tables of blocks from the lowest up, for :func:`descend`.

    ``nodes``: (key, pos, n, digest). Each round has ``FANOUT ** depth`` times fewer nodes; the driver asks only whether any key has several."""
    tables = []
    while True:
        tables.append(staged(_gathered(nodes, depth), "blocks"))
        nodes = staged(tables[-1].mapInArrow(_roots(depth), "key binary, pos bigint, n bigint, digest binary"), "roots")
        if nodes.where("n > 1").isEmpty():
            return nodes.select("key", "digest"), tables


def descend(tables: list[DataFrame], tops: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, pos, path, root) of the lowest table's nodes: ``tops`` is (key, path, root) of each key's root."""
    paths = tops.withColumn("pos", F.lit(0).cast("bigint"))
    for blocks in reversed(tables):
        paths = _under(blocks, paths).mapInArrow(_paths(depth), f"key binary, pos bigint, path {_PATH_SQL}, root binary")
    return paths


def _under(blocks: DataFrame, paths: DataFrame, *more: str) -> DataFrame:
    above = paths.select(F.col("key").alias("_key"), F.col("pos").alias("_pos"), "path", "root")
    joined = blocks.join(above, (F.col("key") == F.col("_key")) & (F.col("block") == F.col("_pos")))
    return joined.select("key", "block", "n", "digest", "path", "root", *more)


def _prover(depth: int):
    """Leaves with their proofs, and what the tampered ones fold to, from a block and its path."""

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, own, path, root, docs, changed, subroot in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                inside = min(depth, levels(n))
                grown = _grown(np.frombuffer(b"".join(own), np.uint8).reshape(-1, 64), inside)
                above = [(p["left"], p["right"]) for p in path]
                rest = b"".join(a + b for a, b in above)
                # what follows the proof of a node, from the top level down: 8 nodes share their parent's
                after = [[rest] * len(m) for m in grown]
                pairs = [[_siblings(m, i) for i in range(len(m))] for m in grown[:-1]]
                for k in range(inside - 1, 0, -1):
                    after[k] = [a + b + after[k + 1][i // FANOUT] for i, (a, b) in enumerate(pairs[k])]
                proofs, folded = [], []
                for i, leaf in enumerate(own):
                    first = (b"".join(pairs[0][i]) + after[1][i // FANOUT]) if inside else rest
                    proofs.append(hashlib.sha256(first).hexdigest())
                    now = changed[i] or leaf
                    for k in range(inside):
                        a, b = pairs[k][i // FANOUT**k]
                        now = hashlib.sha256(a + now + b).hexdigest().encode()
                    for a, b in above:
                        now = hashlib.sha256(a + now + b).hexdigest().encode()
                    folded.append(now)
                size, verified = len(own), [f == root for f in folded]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), *(pa.array([x.decode() for x in v], pa.string()) for v in (own, [subroot] * size, [root] * size)), pa.array(proofs, pa.string()), pa.array([x.decode() for x in folded], pa.string()), pa.array(verified)],
                    ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                )

    return released(prove)


def manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    text = {"source", "lang", "text"}
    rows = docs.select(*(F.col(c).cast("string").cast("binary").alias(c) if c in text else F.col(c).cast("bigint").alias(c) for c in COLUMNS))
    made = staged(rows.mapInArrow(released(_leaves), "doc_id bigint, lang binary, leaf binary, changed binary"), "leaves")
    # a null language comes before all others, which begin with a byte
    keyed = made.select(F.when(F.col("lang").isNull(), F.lit(b"")).otherwise(F.concat(F.lit(b"="), "lang")).alias("key"), "doc_id", F.col("leaf").alias("digest"), F.col("changed"))
    blocks = staged(_gathered(_numbered(keyed, "key", ["doc_id", "digest"]), depth, "doc_id", "changed"), "blocks")
    discard(made)
    roots = staged(blocks.select("key", "block", "n", "digest").mapInArrow(_roots(depth), "key binary, pos bigint, n bigint, digest binary"), "roots")
    found, tables = (roots.select("key", "digest"), []) if roots.where("n > 1").isEmpty() else tree(roots, depth)
    subroots = staged(found.select(F.col("key").alias("lang"), F.col("digest")), "subroots")
    tops = staged(_numbered(subroots.select(F.lit(b"").alias("key"), "lang", "digest"), "key", ["lang"]), "tops")
    top, above = tree(tops.select("key", "pos", "n", "digest"), depth)
    to_root = top.select("key", F.expr(f"cast(array() as {_PATH_SQL})").alias("path"), F.col("digest").alias("root"))
    of_langs = descend(above, to_root, depth).select(F.col("pos").alias("_pos"), "path", "root")
    of_langs = tops.join(of_langs, F.col("pos") == F.col("_pos")).select(F.col("lang").alias("key"), "path", "root")
    of_blocks = descend(tables, of_langs, depth)
    named = subroots.select(F.col("lang").alias("_lang"), F.col("digest").alias("subroot"))
    under = _under(blocks, of_blocks, "doc_id", "changed").join(named, F.col("key") == F.col("_lang"))
    proved = under.select("n", "digest", "path", "root", "doc_id", "changed", "subroot")
    return proved.mapInArrow(_prover(depth), "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
