"""Media columns: content-addressed payloads in tar shards, with header-only range reads.

A text becomes a payload (its UTF-8 bytes, filled with spaces up to a positive multiple of ``ROW``), the
payload a greyscale PNG of 8-bit samples, and the PNG a member of a tar shard, named by the payload's
digest. A task writes one shard to the shared folder and stores equal payloads once; the shard's name
holds the attempt, so a task that runs again writes another shard and its rows point to that one. Rows
carry digest, shard, offset and length. A second step opens the shards again: a range read of a
header's bytes fills the metadata columns, and a range read of the whole member gives the payload back,
whose digest must be the row's. The rows are written before they are read, so that the shards are written
once whatever is asked of the result.

No texts are exchanged between tasks.

Cases: a null or empty text is one row of spaces; texts of any length are whole; equal texts have equal
digests and features (and, within a shard, one member); repeated rows each get a row; rows of several
shards may be mixed in any order; extra columns are ignored; an empty table writes no shard.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import new_path, released, staged, widened
from .words import text_blocks

#: Samples in a row of the picture.
ROW = 192

#: Bytes at the start of a member that hold its header: signature and first chunk.
HEADER = 33

_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(text: bytes | None) -> bytes:
    text = text or b""
    return text.ljust(max(1, -(-len(text) // ROW)) * ROW)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """A lossless greyscale picture, ROW samples wide, of 8-bit samples; every row unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.data, 1)) + _chunk(b"IEND", b"")


def header_of(start: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample, from the first HEADER bytes."""
    if start[:8] != _SIGNATURE or start[12:16] != b"IHDR":
        raise ValueError("not a picture of this kind")
    return struct.unpack(">IIB", start[16:25])


def from_png(stored: bytes) -> bytes:
    """The samples, in order."""
    width, height, _ = header_of(stored)
    at, packed = 8, []
    while at < len(stored):
        n = struct.unpack(">I", stored[at : at + 4])[0]
        if stored[at + 4 : at + 8] == b"IDAT":
            packed.append(stored[at + 8 : at + 8 + n])
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Height, mean and deviation of the samples, and the most frequent one."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    values = np.arange(256)
    mean = counts @ values / len(payload)
    spread = max(0.0, counts @ (values * values) / len(payload) - mean * mean) ** 0.5
    return f"h={len(payload) // ROW};mean={mean:.4f};sd={spread:.4f};mode={int(counts.argmax())}"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = _store(folder)
        out, name, at, members = None, "", 0, {}
        rows: list[tuple] = []
        for batch in batches:
            for doc, text in ((d, t) for a, b, texts in text_blocks(batch.column(1)) for d, t in zip(batch.column(0)[a:b].to_pylist(), texts, strict=True)):
                payload = padded(text)
                digest = hashlib.sha256(payload).digest()
                if digest not in members:
                    if out is None:
                        name = f"shard-{uuid.uuid4().hex}.tar"
                        store.create_dir(place, recursive=True)
                        out = store.open_output_stream(f"{place}/{name}")
                    stored = to_png(payload)
                    info = tarfile.TarInfo(f"{digest.hex()}.png")
                    info.size = len(stored)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    out.write(head + stored + bytes(-len(stored) % 512))
                    members[digest] = (at + len(head), len(stored))
                    at += len(head) + len(stored) + -len(stored) % 512
                rows.append((doc, len(text or b""), digest))
        if out is not None:
            out.write(bytes(1024))
            out.close()
        for first in range(0, len(rows), 4000):
            part = rows[first : first + 4000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.binary()),
                    pa.array([name] * len(part), pa.string()), *(pa.array([members[r[2]][k] for r in part], pa.int64()) for k in (0, 1)),
                ],
                ["doc_id", "n_bytes", "digest", "shard", "offset", "length"],
            )

    return released(write)


def write_shards(docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, n_bytes, digest, shard, offset and length for every row; the shards lie in ``folder``."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_writer(folder), "doc_id bigint, n_bytes bigint, digest binary, shard string, offset bigint, length bigint")


class _Ranges:
    """Range reads from shards, of which the one read last stays open."""

    def __init__(self, folder: str):
        self.store, self.place = _store(folder)
        self.name, self.file = "", None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            self.close()
            self.name, self.file = shard, self.store.open_input_file(f"{self.place}/{shard}")
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


def _header_reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = _Ranges(folder)
        for batch in batches:
            shards, offsets = batch.column("shard").to_pylist(), batch.column("offset").to_pylist()
            found = [header_of(ranges.read(s, o, HEADER)) for s, o in zip(shards, offsets, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([f[k] for f in found], pa.int32()) for k in range(3))], [*batch.schema.names, "width", "height", "bits"])
        ranges.close()

    return read


def read_headers(index: DataFrame, folder: str) -> DataFrame:
    """Adds width, height and bits, from range reads of HEADER bytes."""
    return index.mapInArrow(_header_reader(folder), widened(index.schema, "width int, height int, bits int"))


def _payload_reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = _Ranges(folder)
        for batch in batches:
            found, known = [], {}
            for shard, offset, length, digest in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length", "digest")), strict=True):
                if (shard, offset) not in known:
                    stored = ranges.read(shard, offset, length)
                    payload = from_png(stored)
                    known[shard, offset] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(payload))
                if known[shard, offset][1] != digest.hex():
                    raise ValueError(f"{shard} at {offset} holds another payload than its row says")
                found.append(known[shard, offset])
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds))], [*batch.schema.names, *names])
        ranges.close()

    return released(read)


def read_payloads(index: DataFrame, folder: str) -> DataFrame:
    """Adds size, digests, checksum and feature of each payload, read back from its shard."""
    added = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return index.mapInArrow(_payload_reader(folder), widened(index.schema, added))


def stored(docs: DataFrame) -> DataFrame:
    """Writes all payloads to new shards, once, and reads headers and payloads back by the index."""
    folder = new_path(docs.sparkSession, "shards")
    return read_payloads(read_headers(staged(write_shards(docs, folder), "index"), folder), folder)
