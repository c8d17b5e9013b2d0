"""Long repeated byte strings by suffix arrays, one for each shard of the candidate text.

1. Every string of ``window`` bytes goes by its least gram (the smallest hash of ``GRAM`` bytes inside): equal strings have
   equal ones. Consecutive strings of a document with the same least gram are a piece. Grams are counted over the
   whole corpus: a piece whose gram occurs in no other piece holds nothing that repeats, and its text is not moved.
2. The texts of all other pieces are sorted by gram and cut into shards of ``SHARD`` bytes between two grams, so that equal strings
   meet in one shard. Each shard's suffix array is made by induced sorting (:mod:`.induced`); a string is repeated if
   its suffix shares a prefix of ``window`` or more bytes with a neighbour in the array (permuted common
   prefixes). Equal pieces stand in the array once with their number: a piece that there is twice shares all of itself;
   where a gram has no other piece, there is nothing to sort.
3. The repeated spans of a piece go back to all its occurrences by joins.

Skew: a task tells about each gram once and sends each piece once, however often it holds them. A gram in
more than ``HOT`` of the pieces sent (a line that very many documents share, each with other text around) would be
a shard that grows with the corpus: such pieces are cut again by a further gram of another hash, whose pieces
are judged in the same way, until no gram is hot.

Cases: null and empty texts have no bytes and lose nothing, as do texts shorter than a window; long texts are
hashed in segments that overlap by a window, so that memory doesn't grow with a text's length; rows that
repeat a document (same id and text) repeat each other and share their verdicts; rows with one id and
several texts are judged apart; null ids are kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .induced import common_prefixes, suffix_array
from .store import bucket_count, released, staged
from .substring import _dealt, _packed, _runs, version
from .words import _TABLE, mixed, spans, text_blocks

#: Bytes of a gram, at most half a window.
GRAM = 48

#: Strings of a piece at most; longer ones (periodic text) are cut.
LONGEST = 4096

#: Bytes of a text that are hashed at once.
SEGMENT = 2 << 20

#: Bytes of a shard: where this is reached, it ends with its gram.
SHARD = 1 << 20

#: Pieces with one gram above which they are cut again, and how often at most.
HOT, ROUNDS = 4096, 12

#: Records, and bytes of pieces, that a task holds before it sends them.
HELD, HELD_BYTES = 300_000, 16 << 20

_PIECE = np.dtype([("key", "<u8"), ("doc", "<i8"), ("version", "<i4"), ("start", "<i4"), ("size", "<i4"), ("n", "u1"), ("kind", "u1")])
_LIVE = np.dtype([("key", "<u8"), ("start", "<i4"), ("size", "<i4")])
#: ``n`` of a record that tells that a task holds a gram more than once; ``kind`` of a record that is a verdict.
SEVERAL, VERDICT = 2, 1

_NO_ID = -(1 << 62)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each run of ``width`` values."""
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        values = np.minimum(values[:-step], values[step:])
        reach += step
    return values


def pieces(buf: np.ndarray, at: np.ndarray, window: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(part, start, strings, gram, times) of the pieces of several parts of a block of bytes; ``at``: where parts start, and the end.

    ``times``: 1, or 2 where the gram stands in the piece more than once, as in periodic text, which can repeat itself."""
    gram = min(GRAM, window // 2)
    none = np.zeros(0, np.int64)
    if len(buf) < window:
        return none, none, none, np.zeros(0, np.uint64), none
    starts = np.arange(len(buf) - gram + 1)
    grams = spans(_TABLE[buf], starts, starts + gram)
    if seed:
        grams = mixed(grams + np.uint64(seed))
    least = _least(grams, window - gram + 1)
    n = len(least)
    edge = np.zeros(n + 1, np.int64)
    long = np.diff(at) >= window
    np.add.at(edge, at[:-1][long], 1)
    np.add.at(edge, at[1:][long] - window + 1, -1)
    inside = np.cumsum(edge[:-1]) > 0
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
    new[at[:-1][long]] = True
    first = np.flatnonzero(new)
    last = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
    size = last - first + 1
    cuts = -(-size // LONGEST)
    if len(cuts) and cuts.max() > 1:
        k = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        first, size = np.repeat(first, cuts) + k * LONGEST, np.minimum(np.repeat(size, cuts) - k * LONGEST, LONGEST)
    part = np.searchsorted(at, first, side="right") - 1
    key = least[first]
    # places of grams that are the least of a string; few stand in a piece
    reach = window - gram
    most = ~_least(~np.concatenate([np.zeros(reach, np.uint64), least, np.zeros(reach, np.uint64)]), reach + 1)
    marked = np.flatnonzero(most == grams)
    low, high = np.searchsorted(marked, first), np.searchsorted(marked, first + size + reach)
    count = high - low
    before = np.cumsum(count) - count
    same = grams[marked[np.arange(count.sum()) + np.repeat(low - before, count)]] == np.repeat(key, count)
    times = np.minimum(np.add.reduceat(same.astype(np.int64), before), 2) if len(count) else none
    return part, first - at[part], size, key, times


def _segments(texts: list[bytes | None], window: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(text, offset, bytes) of segments that together hold each string of ``window`` bytes once, in blocks."""
    owner, offset, parts, size = [], [], [], 0
    for i, text in enumerate(texts):
        for s in range(0, max(len(text or b"") - window + 1, 0), SEGMENT):
            part = text[s : s + SEGMENT + window - 1]
            owner.append(i), offset.append(s), parts.append(part)
            size += len(part)
            if size >= SEGMENT:
                yield owner, offset, parts
                owner, offset, parts, size = [], [], [], 0
    if parts:
        yield owner, offset, parts


def _told(held: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """What a task sends: one record for each gram, verdicts on pieces whose gram it holds more than once; and their buckets."""
    held = held[np.lexsort((held["start"], held["version"], held["doc"], held["key"]))]
    first, of = _runs(held["key"])
    times = np.add.reduceat(held["n"].astype(np.int64), first)
    sent = held[first].copy()
    sent["n"] = np.minimum(times, SEVERAL)
    known = held[times[of] > 1].copy()
    if len(known):  # repeated rows tell once
        known = known[_runs(known["key"], known["doc"], known["version"], known["start"])[0]]
    known["kind"] = VERDICT
    mask = np.uint64(buckets - 1)
    place = np.concatenate([(sent["key"] >> np.uint64(13)) & mask, mixed(known["doc"].view(np.uint64) + known["start"].astype(np.uint64)) & mask])
    return np.concatenate([sent, known]), place.astype(np.int32)


def _dealer(window: int, buckets: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flushed() -> pa.RecordBatch:
            place, parts = _dealt(*_told(np.concatenate(held), buckets))
            return pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(parts, pa.binary())], ["bucket", "block"])

        for batch in batches:
            docs, versions = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for first, _, texts in text_blocks(batch.column(2)):
                for owner, offset, parts in _segments(texts, window):
                    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                    part, start, size, key, times = pieces(np.frombuffer(b"".join(parts), np.uint8), at, window)
                    found = np.zeros(len(part), _PIECE)
                    row = np.array(owner)[part] + first
                    found["key"], found["doc"], found["version"] = key, docs[row], versions[row]
                    found["start"], found["size"] = start + np.array(offset)[part], size + window - 1
                    found["n"] = times
                    held.append(found)
                    rows += len(found)
                    if rows >= HELD:
                        yield flushed()
                        held, rows = [], 0
        if rows:
            yield flushed()

    return released(deal)


def _live(table: pa.Table) -> pa.Table:
    """The pieces of a bucket whose gram occurs more than once."""
    records = np.frombuffer(b"".join(table.column("block").to_pylist()), _PIECE)
    sent = records[records["kind"] != VERDICT]
    sent = sent[np.argsort(sent["key"], kind="stable")]
    found = records[records["kind"] == VERDICT]
    if len(sent):
        first, of = _runs(sent["key"])
        many = np.add.reduceat(sent["n"].astype(np.int64), first)[of] > 1
        found = np.concatenate([found, sent[many & (sent["n"] < SEVERAL)]])
    return _packed(found, _LIVE)


_STAGE = pa.schema([("doc_id", pa.int64()), ("version", pa.int32()), ("text", pa.binary()), ("key", pa.int64()), ("digest", pa.binary()), ("piece", pa.binary()), ("n", pa.int64()), ("start", pa.int32()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
_STAGE_SQL = "doc_id bigint, version int, text binary, key bigint, digest binary, piece binary, n bigint, start int, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
_RESULT = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def _row(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _STAGE], schema=_STAGE)


def _digest(piece: bytes) -> bytes:
    return hashlib.blake2b(piece, digest_size=16).digest()


def _sent(held: dict) -> pa.RecordBatch:
    """Each piece that a task holds, with how often: 1, or 2 for more."""
    keys, found = zip(*held, strict=True)
    return _row(key=np.array(keys, np.uint64).view(np.int64), piece=list(found), digest=[_digest(p) for p in found], n=[min(n, 2) for n in held.values()])


def _reader(text: bool):
    """Finishes the documents without live pieces; of the others, sends their texts, pieces and where these stand."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], int] = {}
        size = 0
        for batch in batches:
            docs, versions = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for first, last, texts in text_blocks(batch.column(2)):
                marks = batch.column(3).slice(first, last - first).to_pylist()
                ready, waiting, where = [], [], []
                for i, (raw, own) in enumerate(zip(texts, marks, strict=True), first):
                    if not own:
                        ready.append((docs[i], versions[i], *_cut(raw, (), text)))
                        continue
                    waiting.append((docs[i], versions[i], raw or b""))
                    found = np.frombuffer(b"".join(own), _LIVE)
                    found = found[np.unique(found["start"], return_index=True)[1]]  # repeated rows have equal pieces
                    for key, start, n in found.tolist():
                        piece = raw[start : start + n]
                        if (key, piece) not in held:
                            size += n
                        held[key, piece] = held.get((key, piece), 0) + 1
                        where.append((docs[i], versions[i], start, _digest(piece)))
                if ready:
                    yield _row(**dict(zip(("doc_id", "version", *_RESULT), zip(*ready, strict=True), strict=True)))
                if waiting:
                    yield _row(**dict(zip(("doc_id", "version", "text"), zip(*waiting, strict=True), strict=True)))
                    yield _row(**dict(zip(("doc_id", "version", "start", "digest"), zip(*where, strict=True), strict=True)))
                if size >= HELD_BYTES:
                    yield _sent(held)
                    held, size = {}, 0
        if held:
            yield _sent(held)

    return released(read)


def repeated_spans(found: list[bytes], counts: list[int], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start, end) of the bytes in a shard's pieces that are covered by repeated strings of ``window`` bytes."""
    length = np.array([len(p) for p in found])
    # symbols: 0 ends the shard, 1 a piece, bytes follow
    text = np.frombuffer(b"\0".join(found) + b"\0", np.uint8).astype(np.int16) + 2
    ends = np.cumsum(length + 1) - 1
    text[ends], text[-1] = 1, 0
    array = suffix_array(text)
    before, after = common_prefixes(text, array)
    piece = np.repeat(np.arange(len(found)), length + 1)
    left = ends[piece] - np.arange(len(text))
    shared = np.maximum(before, after)
    shared = np.where(np.array(counts)[piece] > 1, np.maximum(shared, left), shared)
    at = np.flatnonzero((left >= window) & (shared >= window))
    if not len(at):
        return at, at, at
    new = np.append(True, (np.diff(at) > window) | (np.diff(piece[at]) > 0))
    first, last = at[new], at[np.append(new[1:], True)]
    own = piece[first]
    begin = ends[own] - length[own]
    return own, first - begin, last + window - begin


def _sorted_shards(window: int):
    """Rows (key, digest, piece, n), in the order of key and digest, to the repeated spans of the pieces: (digest, start, end).

    A gram all of whose pieces are equal has nothing to sort: its text is there twice as a whole."""

    def judged(held: list[list], whole: list[list]) -> pa.RecordBatch:
        own, start, end = repeated_spans([p for _, p, _ in held], [n for _, _, n in held], window) if held else ([], [], [])
        digests = [held[i][0] for i in own] + [d for d, _, _ in whole]
        start, end = [*start, *[0] * len(whole)], [*end, *(len(p) for _, p, _ in whole)]
        return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["digest", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, whole, group, size, now = [], [], [], 0, None

        def closed() -> int:
            """Puts the pieces of a gram to those that are sorted, and tells their bytes."""
            alike = len(group) == 1 and group[0][2] > 1
            (whole if alike else held).extend(group)
            added = 0 if alike else sum(len(p) for _, p, _ in group)
            group.clear()
            return added

        for batch in batches:
            for at in range(0, len(batch), 1024):
                for key, digest, piece, n in zip(*(c.slice(at, 1024).to_pylist() for c in batch.columns), strict=True):
                    if key != now:
                        size += closed()
                        if size >= SHARD or len(whole) >= HELD // 10:
                            yield judged(held, whole)
                            held, whole, size = [], [], 0
                    if group and group[-1][0] == digest:
                        group[-1][2] += n
                    else:
                        group.append([digest, piece, n])
                    now = key
        closed()
        if held or whole:
            yield judged(held, whole)

    return released(run)


def _recut(window: int, seed: int):
    """(key, piece, n, parent) to smaller pieces of the same strings: (key, digest, piece, n, parent, at)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 1024):
                keys, found, counts, parents = (c.slice(first, 1024).to_pylist() for c in batch.columns)
                at = np.concatenate([[0], np.cumsum([len(p) for p in found])])
                part, start, size, gram, _ = pieces(np.frombuffer(b"".join(found), np.uint8), at, window, seed)
                key = mixed(gram ^ np.array(keys, np.int64).view(np.uint64)[part])
                made = [found[p][s : s + n + window - 1] for p, s, n in zip(part.tolist(), start.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array([_digest(m) for m in made], pa.binary()), pa.array(made, pa.binary()), pa.array(np.array(counts, np.int64)[part]), pa.array([parents[p] for p in part.tolist()], pa.binary()), pa.array(start, pa.int32())],
                    ["key", "digest", "piece", "n", "parent", "at"],
                )

    return released(cut)


def judged(found: DataFrame, window: int, hot: int = HOT, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """(digest, start, end): the repeated spans of the pieces in ``found`` (key, digest, piece, n)."""
    spans_sql = "digest binary, start int, end int"
    often = staged(found.groupBy("key").count().where(F.col("count") > hot).select("key", F.lit(True).alias("is_hot")), "hot") if rounds else None
    if often is None or often.isEmpty():
        ordered = found.select("key", "digest", "piece", "n").repartition("key").sortWithinPartitions("key", "digest")
        return ordered.mapInArrow(_sorted_shards(window), spans_sql)
    cold = found.join(often, "key", "left_anti")
    # equal pieces meet by digest, so that a hot gram's pieces stay spread out
    apart = found.join(often, "key").groupBy("key", "digest").agg(F.first("piece").alias("piece"), F.sum("n").alias("n"))
    parts = staged(apart.select("key", "piece", "n", F.col("digest").alias("parent")).mapInArrow(_recut(window, seed), "key bigint, digest binary, piece binary, n bigint, parent binary, at int"), "parts")
    within = staged(judged(parts.groupBy("key", "digest").agg(F.first("piece").alias("piece"), F.sum("n").alias("n")), window, hot, rounds - 1, seed + 1), "within")
    back = parts.select("digest", "parent", "at").join(within, "digest").select(F.col("parent").alias("digest"), (F.col("start") + F.col("at")).alias("start"), (F.col("end") + F.col("at")).alias("end"))
    return judged(cold, window, hot, 0, seed).unionByName(back)


def _cut(text: bytes | None, marks, with_text: bool) -> tuple[int, int, int, str, bytes | None]:
    """n_bytes, n_removed, n_spans, digest of the kept bytes; and these bytes, if asked for."""
    text = text or b""
    removed, spans_, at, kept = 0, 0, 0, []
    for start, end in sorted(marks):
        if start > at or not spans_:  # spans that touch are one
            spans_ += 1
            kept.append(text[at:start])
            at = start
        if end > at:
            removed += end - at
            at = end
    kept.append(text[at:])
    left = b"".join(kept)
    return len(text), removed, spans_, hashlib.sha256(left).hexdigest(), left if with_text else None


def _finisher(text: bool):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in text_blocks(batch.column(2)):
                marks = batch.column(3).slice(first, last - first).to_pylist()
                made = [_cut(t, [(m["start"], m["end"]) for m in own or ()], text) for t, own in zip(texts, marks, strict=True)]
                columns = zip(*made, strict=True)
                kinds = [_STAGE.field(c).type for c in _RESULT]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:last], batch.column(1)[first:last], *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True))], ["doc_id", "version", *_RESULT]
                )

    return released(finish)


def mark(docs: DataFrame, window: int = 200, text: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, version, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes, for every row."""
    key = ["doc_id", "version"]
    rows = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), version().alias("version"), F.col("text").cast("string").cast("binary").alias("text"))
    dealt = rows.mapInArrow(_dealer(window, bucket_count(docs)), "bucket int, block binary")
    live = dealt.groupBy("bucket").applyInArrow(_live, "doc_id bigint, version int, marks binary")
    by_doc = live.groupBy(*key).agg(F.collect_list("marks").alias("marks"))
    stage = staged(rows.join(by_doc, key, "left").select(*key, "text", "marks").mapInArrow(_reader(text), _STAGE_SQL), "pieces")
    found = staged(judged(stage.where("piece is not null").select("key", "digest", "piece", "n"), window, hot), "spans")
    # both sides are dealt out by digest, so that a very common piece can be split
    places = stage.where("start is not null").select(*key, F.col("start").alias("at"), "digest").join(found, "digest")
    marks = places.select(*key, F.struct((F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end")).alias("span"))
    more = marks.groupBy(*key).agg(F.collect_set("span").alias("spans"))
    waiting = stage.where("text is not null").select(*key, "text").join(more, key, "left")
    finished = waiting.mapInArrow(_finisher(text), "doc_id bigint, version int, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    out = stage.where("n_bytes is not null").select(*key, *_RESULT).unionByName(finished)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")))
