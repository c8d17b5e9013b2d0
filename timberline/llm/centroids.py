"""Clusters of vectors around integer centroids, by rounds of exact assignment.

Vectors are quantised to integers, ``floor(scale * x)`` for each component, and packed into blocks: a row of the
staged table is a matrix. A round is one ``treeAggregate`` over the blocks: each task finds the nearest centroid of
every vector of a block through ``|x|^2 - 2 x.c + |c|^2``, whose middle term is one matrix product in float64, and
adds up its vectors by cluster; the sums (one row for each centroid) meet in a tree of executors. Only these sums
reach the driver, so what it holds depends on ``k`` and the vectors' length alone.

float64 is exact while every intermediate value stays below 2**53. :func:`distances` bounds the magnitudes of a
block and of the centroids first; beyond the bound it computes in 64-bit integers, and beyond 2**63 in integers
of any size. Sums are integers of any size where 64 bits could overflow.

Cases: vectors that are null, of another length, or with a null or non-finite component are left out; repeated
rows each count and each get a row; null ids are the last to become centroids; rows with one id and several
vectors become centroids in the order of their components; with fewer vectors than ``k`` there are fewer
centroids; ties go to the smaller number; a distance or sum beyond a 64-bit integer is null; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import discard, released, staged

#: Vectors of a block; one block's float64 matrix of 64 components is 4 MB.
BLOCK = 8192

#: Values up to this are exact in float64, and in a 64-bit integer.
EXACT, LONG = 1 << 53, (1 << 63) - 1

_BLOCKS_SQL = "ids array<bigint>, kind string, data binary"


def _quantised(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, as the smallest integer type that holds them, or as Python integers."""
    y = np.floor(x * scale) if not len(x) or np.abs(x).max() < 2.0**62 / scale else None
    if y is None:
        return np.array([math.floor(Fraction(v) * scale) for v in x.ravel().tolist()], object).reshape(x.shape)
    most = np.abs(y).max(initial=0)
    return y.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def _packer(size: int, scale: int):
    """(id, vector) to blocks. Blocks beyond 64 bits keep the doubles, as ``wide``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            fits = np.asarray(lists.value_lengths().fill_null(-1)) == size
            rows = np.flatnonzero(fits)
            values = lists.take(pa.array(rows)).flatten().cast(pa.float64())
            x = values.to_numpy(zero_copy_only=False).reshape(-1, size)  # nulls become NaN
            good = np.isfinite(x).all(axis=1)
            x, ids = x[good], batch.column(0).take(pa.array(rows[good]))
            wide = (np.abs(x) >= 2.0**62 / scale).any(axis=1)
            for part in (np.flatnonzero(~wide), np.flatnonzero(wide)):
                for at in range(0, len(part), BLOCK):
                    own = part[at : at + BLOCK]
                    q = x[own] if wide[own[0]] else _quantised(x[own], scale)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids.take(pa.array(own)).to_pylist()], pa.list_(pa.int64())), pa.array(["wide" if q.dtype == np.float64 else q.dtype.str]), pa.array([q.tobytes()], pa.binary())],
                        ["ids", "kind", "data"],
                    )

    return released(pack)


def _matrix(kind: str, data: bytes, size: int, scale: int) -> np.ndarray:
    """A block's integers: of 64 bits, or of any size where it is wide."""
    if kind == "wide":
        return _quantised(np.frombuffer(data, np.float64).reshape(-1, size), scale).astype(object)
    return np.frombuffer(data, np.dtype(kind)).reshape(-1, size).astype(np.int64)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of every row of ``x`` to every centroid, exactly.

    With ``m`` the largest magnitude and ``d`` components, no value of the expansion passes ``4 d m^2``."""
    most = 4 * x.shape[1] * max(_largest(x), _largest(centroids), 1) ** 2
    kind = np.float64 if most < EXACT else np.int64 if most < LONG else object
    a, c = x.astype(kind), centroids.astype(kind)
    out = np.einsum("ij,ij->i", a, a)[:, None] if kind is not object else (a * a).sum(axis=1)[:, None]
    return out - 2 * (a @ c.T) + (c * c).sum(axis=1)[None, :]


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid (the smaller of equals) and the distance to it, by row."""
    found = distances(x, centroids)
    best = np.argmin(found, axis=1)
    return best, found[np.arange(len(x)), best]


def _added(x: np.ndarray, best: np.ndarray, k: int) -> np.ndarray:
    """Sums of the rows of ``x`` by cluster, with their count as one more column, as integers of any size."""
    out = np.zeros((k, x.shape[1] + 1), object)
    by = np.argsort(best, kind="stable")
    first = np.flatnonzero(np.diff(best[by], prepend=-1))
    kind = np.int64 if _largest(x) * len(x) < LONG else object
    sums = np.add.reduceat(x[by].astype(kind), first, axis=0).astype(object)
    out[best[by][first], :-1] = sums
    out[best[by][first], -1] = np.diff(np.append(first, len(by))).astype(object)
    return out


def _round(blocks: DataFrame, size: int, scale: int, centroids: np.ndarray) -> np.ndarray:
    """Of every cluster: the sums of its vectors' components, and their count."""

    def add(total: np.ndarray | None, row) -> np.ndarray:
        x = _matrix(row.kind, bytes(row.data), size, scale)
        found = _added(x, _nearest(x, centroids)[0], len(centroids))
        return found if total is None else total + found

    found = blocks.select("kind", "data").rdd.treeAggregate(None, add, _merged)
    return np.zeros((len(centroids), size + 1), object) if found is None else found


def _merged(a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
    return b if a is None else a if b is None else a + b


def _inertia(blocks: DataFrame, size: int, scale: int, centroids: np.ndarray) -> list[int]:
    """The distances summed by cluster."""

    def add(total: np.ndarray | None, row) -> np.ndarray:
        x = _matrix(row.kind, bytes(row.data), size, scale)
        best, far = _nearest(x, centroids)
        out = np.zeros(len(centroids), object)
        np.add.at(out, best, np.array([int(v) for v in far.tolist()], object))
        return _merged(total, out)

    found = blocks.select("kind", "data").rdd.treeAggregate(None, add, _merged)
    return [0] * len(centroids) if found is None else found.tolist()


def starts(blocks: DataFrame, size: int, scale: int, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest digests, in their order: at most ``k`` rows reach the driver."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rank = [hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "~" for i in ids]
                x = _matrix(kind, data, size, scale)
                least = sorted(range(len(ids)), key=lambda j: (rank[j], x[j].tolist()))[:k]
                made = [" ".join(map(str, x[j].tolist())) for j in least]
                yield pa.RecordBatch.from_arrays([pa.array([rank[j] for j in least], pa.string()), pa.array(made, pa.string())], ["rank", "vector"])

    found = blocks.mapInArrow(released(spread), "rank string, vector string")
    order = F.transform(F.split("vector", " "), lambda v: v.cast("decimal(38,0)"))
    rows = found.orderBy("rank", order).limit(k).collect()
    return np.array([[int(v) for v in r.vector.split()] for r in rows], object).reshape(-1, size)


def _long(value: int) -> int | None:
    return int(value) if -LONG <= value <= LONG else None


def clustered(vectors: DataFrame, size: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, seed: int = 2, vec_id: str = "vec_id", vector: str | Column = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept."""
    spark = vectors.sparkSession
    packed = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>") if isinstance(vector, str) else vector)
    blocks = staged(packed.mapInArrow(_packer(size, scale), _BLOCKS_SQL), "vectors")
    centroids = starts(blocks, size, scale, k, seed)
    if not len(centroids):
        discard(blocks)
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    for _ in range(rounds):
        sums = _round(blocks, size, scale, centroids)
        centroids = np.array([[s // n for s in row] if n else old.tolist() for (*row, n), old in zip(sums.tolist(), centroids, strict=True)], object)
    inertia = _inertia(blocks, size, scale, centroids)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    by_cluster, total = [_long(v) for v in inertia], _long(sum(inertia))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                best, far = _nearest(_matrix(kind, data, size, scale), centroids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(best.astype(np.int32)), pa.array([_long(int(v)) for v in far.tolist()], pa.int64()), pa.array([by_cluster[c] for c in best.tolist()], pa.int64()), pa.array([total] * len(ids), pa.int64()), pa.array([digests[c] for c in best.tolist()])],
                    ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return blocks.mapInArrow(released(assigned), "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
