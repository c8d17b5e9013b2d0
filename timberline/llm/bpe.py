"""Byte-level encoding and decoding of whole texts by corpus-level merge replay.

A task takes its texts in blocks. The distinct parts of a block are split by the pattern, the distinct
matches become rows of symbols, and the merges are replayed over all of them at once (:mod:`.merges`).
Texts are then put together from the ids of their parts.

Cases: a null text counts as empty and has no ids; texts of any length are whole, one word of a megabyte
too; equal texts have equal ids; repeated rows each get a row; an empty table gives an empty result; other
columns pass through, but columns named ``ids`` (in :func:`encode`) and ``decoded`` (in :func:`decode`)
give way to the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import released, widened
from .tokens import rank_vocabulary
from .words import text_blocks


def _encoder(path: str, pattern: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = rank_vocabulary(path, pattern)
        for batch in batches:
            for first, last, texts in text_blocks(batch.column(batch.num_columns - 1), 4 << 20):
                found = vocabulary.encode([t or "" for t in texts])
                offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in found])]).astype(np.int64)
                ids = np.frombuffer(b"".join(found), "<i4")
                lists = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(ids)).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(c.slice(first, last - first) for c in batch.columns[:-1]), lists], [*batch.schema.names[:-1], "ids"])

    return encode


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``ids`` (array of int)."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "ids")]
    rows = docs.select(*others, F.col(f"`{text}`"))
    return rows.mapInArrow(released(_encoder(path, pattern)), widened(docs.select(*others).schema, "ids array<int>"))


def _decoder(path: str, pattern: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = rank_vocabulary(path, pattern)
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            flat, at = ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy())])
            raw = [vocabulary.decode(flat[a:b].tolist()) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(raw, pa.binary())], [*batch.schema.names[:-1], "decoded"])

    return decode


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``encoded`` without its ids, with ``decoded`` (the bytes)."""
    others = [F.col(f"`{c}`") for c in encoded.columns if c not in (ids, "decoded")]
    rows = encoded.select(*others, F.col(f"`{ids}`"))
    return rows.mapInArrow(_decoder(path, pattern), widened(encoded.select(*others).schema, "decoded binary"))


def _digester(path: str, pattern: str):
    encoded, decoded = _encoder(path, pattern), _decoder(path, pattern)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([str(i) for i in range(len(rank_vocabulary(path, pattern).bytes_of))], object)
        for batch in encoded(batches):
            back = next(decoded(iter([batch]))).column(1)
            ids = batch.column(1)
            flat, at = ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])
            spelt = [hashlib.sha256(" ".join(names[flat[a:b]].tolist()).encode()).hexdigest() for a, b in zip(at, at[1:])]
            raw = [hashlib.sha256(b).hexdigest() for b in back.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), pa.int64()), pa.array(spelt, pa.string()), pa.array(raw, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """n_tokens and digests of the ids and of what they decode to, for every row, in one pass of the
    encoder and the decoder above: no ids leave the task."""
    return docs.select("doc_id", "text").mapInArrow(released(_digester(path, pattern)), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
