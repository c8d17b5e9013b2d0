"""N-grams of texts, counted and found again, by columns of a batch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .clean import WILDCARD

#: Bytes of texts whose n-grams are made at once.
PIECE = 8 << 20

#: Frequent n-grams up to this number are sent to all tasks, 9 bytes each; more are joined by a shuffle.
SENT = 16_000_000

#: Hashes of n-grams fall into 2^32 slots, which are counted by ranges of 2^24 in so many tasks.
SLOTS, RANGE, TASKS = 32, 24, 64

#: The largest bitmap of slots has 2^30 bits.
BITS = 30


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch["text"]), 0), np.int64))
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
            yield batch.slice(at, to - at)
            at = to


def _grams(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, place, gram) of texts split by spaces: a gram is its width and its tokens, joined by spaces. Pairs are
    circular: the last token is followed by the first."""
    lists = pc.split_pattern(texts, " ")
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
    tokens, row = lists.flatten(), np.repeat(np.arange(len(sizes)), sizes)
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at, size = np.arange(len(row)), sizes[row]
    place = at - begin
    if width == 2:
        parts = [tokens, tokens.take(pa.array(np.where(place + 1 < size, at + 1, begin)))]
    else:
        at = at[place + width <= size]
        parts = [tokens.take(pa.array(at + k)) for k in range(width)]
        row, place = row[at], place[at]
    return row, place, pc.binary_join_element_wise(pa.scalar(str(width)), *parts, " ")


def _hashes(tokens: pa.Array, sizes: np.ndarray, of: np.ndarray, width: int, by: str = "0123456789123456") -> tuple[np.ndarray, np.ndarray]:
    """(at, hash) of the grams of rows with ``sizes`` tokens each: the token where a gram begins, and 64 bits of its tokens,
    its width and what ``of`` has for its row."""
    coded = tokens.dictionary_encode()
    known = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), hash_key=by, categorize=False)
    token = known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.uint64)
    size, begin = np.repeat(sizes, sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(len(token))
    if width == 2:
        parts = [token, token[np.where(at + 1 < begin + size, at + 1, begin)]]
    else:
        at = at[at - begin + width <= size]
        parts = [token[at + k] for k in range(width)]
    found = np.repeat(of.astype(np.uint64), sizes)[at] + np.uint64(width)
    for part in parts:
        found = (found ^ part) * np.uint64(0x9E3779B97F4A7C15)
        found ^= found >> np.uint64(31)
    return at, found


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Tokens of all texts, and how many each has."""
    lists = pc.split_pattern(texts, " ")
    return lists.flatten(), np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOTS)).astype(np.int64)


def _packed(places: np.ndarray) -> bytes:
    """Ascending places in a range, which may repeat, as the bytes of their distances: low ones, then middle and high ones."""
    return np.diff(places, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T[:3].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    low, middle, high = np.frombuffer(data, np.uint8).reshape(3, -1).astype(np.int64)
    return np.cumsum(low + (middle << 8) + (high << 16))


def _key(key: Sequence[str]) -> Column:
    return (F.xxhash64(*key) if key else F.lit(0).cast("bigint")).alias("_of")


def bitmap(texts: DataFrame, widths: Sequence[int], least: int, key: Sequence[str] = ()) -> np.ndarray:
    """Packed bits, a power of two, by the first bits of hashes: set are those of all grams of (key, text) that occur ``least`` times
    or more, and those of few others. Rare grams, which most are, leave their task as two bytes of a distance between slots."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            tokens, sizes = _split(piece["text"])
            of = piece["_of"].to_numpy(zero_copy_only=False)
            all_ = np.sort(np.concatenate([_slots(_hashes(tokens, sizes, of, width)[1]) for width in widths]))
            ends = np.searchsorted(all_, np.arange(1, (1 << SLOTS - RANGE) + 1) << RANGE)
            chunks = [(k, _packed(c & (1 << RANGE) - 1)) for k, c in enumerate(np.split(all_, ends[:-1])) if len(c)]
            if chunks:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in chunks], pa.int32()), pa.array([c for _, c in chunks], pa.binary())], ["part", "data"])

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.iinfo(np.uint16).max
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch["part"].to_pylist(), batch["data"], strict=True):
                own = seen.setdefault(part, np.zeros(1 << RANGE, np.uint16))
                places = _unpacked(data.as_buffer())
                first = np.flatnonzero(np.diff(places, prepend=-1))
                times = np.diff(first, append=len(places))
                own[places[first]] = np.minimum(own[places[first]] + times, top)
        for part, own in seen.items():
            held = np.flatnonzero(own >= min(least, top))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_packed(held)], pa.binary())], ["part", "data"])

    rows = texts.select(_key(key), "text").mapInArrow(slots, "part int, data binary")
    found = rows.repartition(TASKS, "part").mapInArrow(often, "part int, data binary").checkpoint()
    n = (found.agg(F.sum(F.octet_length("data"))).first()[0] or 0) // 3
    power = min(BITS, max(16, (64 * n).bit_length()))
    bits = np.zeros(1 << power - 3, np.uint8)
    for row in found.toLocalIterator():
        places = (_unpacked(row["data"]) + (row["part"] << RANGE)) >> SLOTS - power
        np.bitwise_or.at(bits, places >> 3, (1 << (places & 7)).astype(np.uint8))
    return bits


def _may(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit."""
    places = (hashes >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)).astype(np.int64)
    return bits[places >> 3] >> (places & 7).astype(np.uint8) & 1 == 1


def _parts(tokens: pa.Array, sizes: np.ndarray, at: np.ndarray, width: int) -> pa.Array:
    """The grams that begin at tokens ``at``, as :func:`_grams` has them."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    begin = ends - np.repeat(sizes, sizes)
    places = [at + k for k in range(width)]
    if width == 2:
        places[1] = np.where(places[1] < ends[at], places[1], begin[at])
    return pc.binary_join_element_wise(pa.scalar(str(width)), *[tokens.take(pa.array(p)) for p in places], " ")


def often(texts: DataFrame, widths: Sequence[int], least: int, key: Sequence[str] = ()) -> tuple[DataFrame, Broadcast]:
    """(hash, key, gram, freq) of all grams that occur ``least`` times or more, and of few others; the :func:`bitmap` that says which
    may be among them. All grams of one hash that the texts hold are in the table, or none."""
    key = list(key)
    sent = texts.sparkSession.sparkContext.broadcast(bitmap(texts, widths, least, key))
    rows = texts.select(*key, _key(key), "text")
    schema = ", ".join([*(f"{c} {t}" for c, t in rows.dtypes if c not in ("text", "_of")), "hash bigint", "gram string", "n bigint"])
    names = [*key, "hash", "gram"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            tokens, sizes = _split(piece["text"])
            row, of = np.repeat(np.arange(len(sizes)), sizes), piece["_of"].to_numpy(zero_copy_only=False)
            for width in widths:
                at, found = _hashes(tokens, sizes, of, width)
                own = _may(sent.value, found)
                at, found = at[own], found[own]
                columns = {**{c: piece[c].take(pa.array(row[at])) for c in key}, "hash": pa.array(found.view(np.int64)), "gram": _parts(tokens, sizes, at, width)}
                yield from pa.table(columns).group_by(names).aggregate([([], "count_all")]).rename_columns([*names, "n"]).select([*names, "n"]).to_batches()

    return rows.mapInArrow(run, schema).groupBy("hash", *key, "gram").agg(F.sum("n").alias("freq")), sent


def _added(hashes: np.ndarray, checks: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts by hash and check, ascending by hash."""
    order = np.argsort(hashes, kind="stable")
    hashes, checks, n = hashes[order], checks[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])])[: len(hashes)])
    return hashes[first], checks[first], np.add.reduceat(n, first) if len(first) else n


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def _values(data: bytes, kind: str, at: int, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width, at * n).reshape(width, n).T).view(kind).ravel()


def told(texts: DataFrame, sent: Broadcast, pair: int, triple: int, key: Sequence[str] = ()) -> DataFrame:
    """(hash, kind, n) of pairs and triples at or above their threshold, as of :func:`often`'s table; ``n``: 2 where a hash has several
    grams. Grams travel as a hash and 31 bits of another one, counted by task, some eleven bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64))

        def parts(held: tuple) -> pa.RecordBatch:
            hashes, checks, n = held
            ends = np.searchsorted(hashes, np.arange(1, TASKS, dtype=np.uint64) * np.uint64(2**64 // TASKS))
            rows = [(k, *x) for k, x in enumerate(zip(*(np.split(c, ends) for c in (hashes, checks, n)), strict=True)) if len(x[0])]
            data = [_planes(np.diff(h, prepend=np.uint64(0))) + _planes(c) + _planes(np.minimum(m, 2**32 - 1).astype(np.uint32)) for _, h, c, m in rows]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array(data, pa.binary())], ["part", "data"])

        for piece in _pieces(batches):
            tokens, sizes = _split(piece["text"])
            of = piece["_of"].to_numpy(zero_copy_only=False)
            new = [held]
            for width in (2, 3):
                found = _hashes(tokens, sizes, of, width)[1]
                own = _may(sent.value, found)
                checks = _hashes(tokens, sizes, of, width, "timberline-check")[1][own]
                checks = (checks >> np.uint64(32)).astype(np.uint32) & np.uint32(2**32 - 2) | np.uint32(width == 3)
                new.append((found[own], checks, np.ones(len(checks), np.int64)))
            held = _added(*(np.concatenate([x[k] for x in new]) for k in range(3)))
            if len(held[0]) > PIECE // 2:
                yield parts(held)
                held = tuple(x[:0] for x in held)
        if len(held[0]):
            yield parts(held)

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64)), []
        for batch in batches:
            for data in batch["data"].to_pylist():
                n = len(data) // 16
                waiting.append((np.cumsum(_values(data, "<u8", 0, n), dtype=np.uint64), _values(data, "<u4", 8, n), _values(data, "<u4", 12, n).astype(np.int64)))
            if sum(len(w[0]) for w in waiting) > max(PIECE // 4, len(held[0])):
                held, waiting = _added(*(np.concatenate([x[k] for x in (held, *waiting)]) for k in range(3))), []
        hashes, checks, n = _added(*(np.concatenate([x[k] for x in (held, *waiting)]) for k in range(3)))
        meets = np.concatenate([[False], hashes[1:] == hashes[:-1], [False]])[: len(hashes) + 1]
        several = meets[:-1] | meets[1:] if len(hashes) else np.zeros(0, bool)
        is_triple = checks & 1 == 1
        # where hashes meet, counts may be in parts: all of them are told
        own = (n >= np.where(is_triple, triple, pair)) | several
        kinds = np.where(is_triple, TRIPLE, np.where(n > pair, ABOVE, AT))[own].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(hashes[own].view(np.int64)), pa.array(kinds), pa.array(several[own].astype(np.int64) + 1)], ["hash", "kind", "n"])

    rows = texts.select(_key(key), "text").mapInArrow(run, "part int, data binary")
    return rows.repartition(TASKS, "part").mapInArrow(often, "hash bigint, kind int, n bigint")


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of each batch of (hash, kind) as bytes."""
    for batch in batches:
        data = (np.asarray(batch["hash"], np.int64).tobytes(), np.asarray(batch["kind"], np.int8).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in data], ["hash", "kind"])


def in_place(texts: DataFrame, held: DataFrame, sent: Broadcast, key: Sequence[str] = ()) -> DataFrame:
    """(key, line_id, template) of (key, line_id, text) by pairs and triples whose (hash, kind) ``held`` has; each line stays in its task.
    ``sent``: the bitmap of :func:`often`."""
    key = list(key)
    parts = held.mapInArrow(_columns, "hash binary, kind binary").toLocalIterator()
    parts = [(np.frombuffer(r["hash"], np.uint64), np.frombuffer(r["kind"], np.int8)) for r in parts]
    hashes, kinds = (np.concatenate([np.zeros(0, t), *(p[k] for p in parts)]) for k, t in enumerate((np.uint64, np.int8)))
    order = np.argsort(hashes)
    hashes, kinds = hashes[order], kinds[order]
    table = texts.sparkSession.sparkContext.broadcast((hashes, kinds))
    rows = texts.select(*key, "line_id", _key(key), "text")
    kinds_of = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {kinds_of[c]}" for c in (*key, "line_id")), "template string"])

    def looked_up(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes in the table, and their kinds."""
        hashes, kinds = table.value
        own = np.flatnonzero(_may(sent.value, found)) if len(hashes) else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(hashes, found[own]), len(hashes) - 1)
        same = hashes[at] == found[own]
        return own[same], kinds[at[same]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            tokens, sizes = _split(piece["text"])
            of = piece["_of"].to_numpy(zero_copy_only=False)
            rare, pair = np.zeros(len(tokens) + 2, bool), np.zeros(len(tokens), np.int8)
            at, found = _hashes(tokens, sizes, of, 3)
            rare[at] = True
            rare[at[looked_up(found)[0]]] = False
            starts = rare.copy()
            rare[1:] |= starts[:-1]
            rare[2:] |= starts[:-2]
            at, found = _hashes(tokens, sizes, of, 2)
            own, kind = looked_up(found)
            pair[at[own]] = kind
            kept = pair >= AT
            kept[1:] |= pair[:-1] >= AT
            first = (np.cumsum(sizes) - sizes)[sizes > 0]
            kept[first] = pair[first] == ABOVE
            out = pc.if_else(pa.array(rare[: len(tokens)] & ~kept), WILDCARD, tokens)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), out)
            joined = pc.replace_substring(pc.binary_join(lists, " "), ",", "")
            joined = pc.if_else(pc.is_null(piece["text"]), pa.scalar(None, joined.type), joined)
            yield pa.RecordBatch.from_arrays([*(piece[c] for c in (*key, "line_id")), joined], [*key, "line_id", "template"])

    return rows.mapInArrow(run, schema)


def counts(texts: DataFrame, widths: Sequence[int], key: Sequence[str] = ()) -> DataFrame:
    """(key, gram, freq) over (key, text): how often each gram of ``widths`` occurs. Grams are added up by batch first, so that a
    frequent one is a row of a batch; most are rare, and adding up by task as well would only fill its memory."""
    key = list(key)
    rows = texts.select(*key, "text")
    schema = ", ".join([*(f"{c} {t}" for c, t in rows.dtypes if c != "text"), "gram string", "n bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            for width in widths:
                row, _, gram = _grams(piece["text"], width)
                table = pa.table({**{c: piece[c].take(pa.array(row)) for c in key}, "gram": gram})
                yield from table.group_by([*key, "gram"]).aggregate([([], "count_all")]).rename_columns([*key, "gram", "n"]).select([*key, "gram", "n"]).to_batches()

    return rows.mapInArrow(run, schema).repartition(*key, "gram").groupBy(*key, "gram").agg(F.sum("n").alias("freq"))


def found(texts: DataFrame, frequent: DataFrame, widths: Sequence[int], sent: Broadcast, key: Sequence[str] = ()) -> DataFrame:
    """(key, id, place, gram, freq) of (key, id, text): where the ``frequent`` grams (key, gram, freq) stand. Only those that the bitmap
    of :func:`often` has leave their task."""
    key = list(key)
    rows = texts.select(*key, "id", _key(key), "text")
    schema = ", ".join([*(f"{c} {t}" for c, t in rows.dtypes if c not in ("text", "_of")), "place int", "gram string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            tokens, sizes = _split(piece["text"])
            row, begin = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)
            for width in widths:
                at, hashes = _hashes(tokens, sizes, piece["_of"].to_numpy(zero_copy_only=False), width)
                at = at[_may(sent.value, hashes)]
                names = [*key, "id"]
                columns = [piece[c].take(pa.array(row[at])) for c in names] + [pa.array((at - begin[at]).astype(np.int32)), _parts(tokens, sizes, at, width)]
                yield from pa.table(columns, [*names, "place", "gram"]).to_batches()

    return rows.mapInArrow(run, schema).join(frequent, [*key, "gram"])


#: What is known of a place: a frequent trigram begins there, a pair that is at or above the threshold.
TRIPLE, AT, ABOVE = 0, 1, 2


def kind(threshold: Column) -> Column:
    """What is known of the places of a frequent gram."""
    return F.when(F.col("gram").startswith("3 "), TRIPLE).when(F.col("freq") > threshold, ABOVE).otherwise(AT)


def mark(threshold: Column) -> Column:
    """A place and what is known of it, as a number."""
    return F.col("place").cast("bigint") * 3 + kind(threshold)


@F.pandas_udf(StringType())
def templates(texts: pd.Series, marks: pd.Series) -> pd.Series:
    """Texts with wildcards for tokens of rare trigrams, except those that have a frequent pair with a neighbour."""
    out = []
    for text, known in zip(texts, marks, strict=True):
        tokens = text.split(" ")
        rare, pair = np.zeros(len(tokens) + 2, bool), np.zeros(len(tokens), np.int8)
        rare[: max(0, len(tokens) - 2)] = True
        place, kind = np.divmod(np.asarray([] if known is None else known, np.int64), 3)
        rare[place[kind == TRIPLE]] = False
        pair[place[kind != TRIPLE]] = kind[kind != TRIPLE]
        starts = rare.copy()
        rare[1:] |= starts[:-1]
        rare[2:] |= starts[:-2]
        kept = pair >= AT
        kept[1:] |= pair[:-1] >= AT
        kept[0] = pair[0] == ABOVE
        for k in np.flatnonzero(rare[: len(tokens)] & ~kept):
            tokens[k] = WILDCARD
        out.append(" ".join(tokens).replace(",", ""))
    return pd.Series(out, dtype=object)
