"""Long repeated passages by a compacted de Bruijn graph of words.

The edges of the graph are the windows of ``window`` consecutive words (k-mers); an edge leads from its first
``window`` - 1 words to its last ones. The graph is built in parts, as is usual for graphs that no machine
holds: consecutive edges of a document that have the same minimizer (the smallest hash of ``GRAM`` words
inside) form a piece, and pieces meet in the part of their minimizer. Equal windows have equal minimizers, so:

* a minimizer that occurs once in the corpus has no repeated edge;
* one whose pieces all have equal content doesn't branch inside: its edges are repeated as a whole;
* only where pieces with one minimizer differ, their single edges are compared.

Repeated pieces are then compacted across parts through joins: a table of successors and predecessors tells
which piece always follows which, and pointer doubling along these nonbranching links names each path by its
first piece and adds up its edges. Wherever the first piece occurs the whole path does, so that one row for
each occurrence (document, place, edges) is left. These are verified at their source coordinates: every
occurrence reads its words again and digests them, and only spans whose words occur twice or more count.
Single edges of branching pieces are verified in the same way.

A task tells the others about each of its minimizers, and later of its spans, once, however often it holds
them, so no group holds more records than there are tasks. Joins on the document bring the verdicts back to
the words.

Cases: null and empty texts have no words; texts shorter than a window lose nothing; rows that repeat
a document (same id and text) share their verdicts and each get a row; rows with one id and several
texts are judged apart; extra columns are ignored by :func:`mark`; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import bucket_count, discard, released, staged
from .words import bounds, hashed_texts, mixed, spans, text_blocks

#: Words of a minimizer, at most half a window.
GRAM = 10

#: Verdicts on a piece: all its edges are repeated; its edges must be compared one by one.
SOLID, OPEN = 1, 2

#: Records that a task holds before it deals them out.
HELD = 300_000

_PIECE = np.dtype([("node", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("version", "<i4"), ("start", "<i4"), ("edges", "u1"), ("n", "u1"), ("kind", "u1")])
_JUDGED = np.dtype([("content", "<i8"), ("start", "<i4"), ("edges", "u1"), ("kind", "u1")])
#: A span of edges, by the digest of its words.
_SPAN = np.dtype([("one", "<u8"), ("two", "<u8"), ("doc", "<i8"), ("version", "<i4"), ("start", "<i4"), ("edges", "<i4"), ("n", "u1")])
_MARK = np.dtype([("start", "<i4"), ("edges", "<i4")])
#: ``n`` of a record that only tells that something branches, or repeats, in its task.
BEACON = 9


def _minimizers(hashed: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values, the place of its smallest, the first of equals."""
    place = np.arange(len(hashed))
    step, reach = 1, 1
    while reach < width:
        step = min(reach, width - reach)
        a, b = place[:-step], place[step:]
        place = np.where(hashed[b] < hashed[a], b, a)
        reach += step
    return place


def _pieces(found: np.ndarray, at: np.ndarray, docs: np.ndarray, versions: np.ndarray, window: int) -> np.ndarray:
    """The pieces of all documents of a block: ``found`` are word hashes, ``at`` where documents start."""
    half = min(GRAM, window // 2 + 1)
    if len(found) < window:
        return np.zeros(0, _PIECE)
    starts = np.arange(len(found) - half + 1)
    grams = spans(found, starts, starts + half)
    place = _minimizers(grams, window - half + 1)
    doc = np.repeat(np.arange(len(docs)), np.diff(at))
    n = len(found) - window + 1
    inside = doc[:n] == doc[window - 1 :]
    edge = np.flatnonzero(inside)
    if not len(edge):
        return np.zeros(0, _PIECE)
    node = place[edge]
    new = np.ones(len(edge), bool)
    new[1:] = (node[1:] != node[:-1]) | (edge[1:] != edge[:-1] + 1)
    first = np.flatnonzero(new)
    size = np.diff(np.concatenate([first, [len(edge)]]))
    start = edge[first]
    out = np.empty(len(first), _PIECE)
    out["node"] = grams[node[first]]
    out["content"] = spans(found, start, start + size + window - 1, lane=1)
    owner = doc[start]
    out["doc"], out["version"] = docs[owner], versions[owner]
    out["start"] = start - at[owner]
    out["edges"], out["n"], out["kind"] = size, 1, 0
    return out


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: where each run of equal ones starts, and the run of each place."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new), np.cumsum(new) - 1


def _dealt(records: np.ndarray, place: np.ndarray) -> tuple[list[int], list[bytes]]:
    by = np.argsort(place, kind="stable")
    records, place = records[by], place[by]
    cuts = np.flatnonzero(np.diff(place)) + 1
    parts = [part.tobytes() for part in np.split(records, cuts)] if len(records) else []
    return place[np.concatenate([[0], cuts]).astype(int)].tolist() if len(records) else [], parts


def _known_here(pieces: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """What one task sends: its nodes once each, and the verdicts it can give by itself; and their buckets."""
    pieces = pieces[np.lexsort((pieces["start"], pieces["doc"], pieces["content"], pieces["node"]))]
    same, of_same = _runs(pieces["node"], pieces["content"])
    size = np.diff(np.concatenate([same, [len(pieces)]]))
    node_first, of_node = _runs(pieces["node"][same])
    contents = np.diff(np.concatenate([node_first, [len(same)]]))
    branching = contents[of_node] > 1  # by run of equal pieces
    lead = np.zeros(len(pieces), bool)
    lead[same] = True
    kind = np.where(size[of_same] > 1, SOLID, 0).astype(np.uint8)
    kind[lead & branching[of_same]] |= OPEN
    own = ~lead | branching[of_same]
    verdicts = pieces[own]
    verdicts["kind"] = kind[own]
    sent = pieces[same[~branching]]
    sent["n"] = np.minimum(size[~branching], 2)
    beacons = pieces[same[node_first[contents > 1]]]
    beacons["n"] = BEACON
    sent = np.concatenate([sent, beacons])
    mask = np.uint64(buckets - 1)
    place = np.concatenate([(sent["node"] >> np.uint64(13)) & mask, mixed(verdicts["doc"].view(np.uint64) + verdicts["start"].astype(np.uint64)) & mask])
    return np.concatenate([sent, verdicts]), place.astype(np.int32)


def _piece_dealer(window: int, buckets: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flushed() -> Iterator[pa.RecordBatch]:
            place, parts = _dealt(*_known_here(np.concatenate(held), buckets))
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(parts, pa.binary())], ["bucket", "block"])

        for batch in batches:
            docs, versions = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for first, last, texts in text_blocks(batch.column(2)):
                found, at = hashed_texts(texts)
                pieces = _pieces(found, at, docs[first:last], versions[first:last], window)
                if len(pieces):
                    held.append(pieces)
                    rows += len(pieces)
                if rows >= HELD:
                    yield from flushed()
                    held, rows = [], 0
        if held:
            yield from flushed()

    return released(deal)


def _packed(records: np.ndarray, kind: np.dtype) -> pa.Table:
    """One row for each document of a block of verdicts, with its records packed."""
    records = records[np.lexsort((records["start"], records["version"], records["doc"]))]
    first, _ = _runs(records["doc"], records["version"]) if len(records) else (np.zeros(0, int), None)
    packed = np.empty(len(records), kind)
    for name in kind.names:
        packed[name] = records[name].view(kind[name]) if records[name].dtype.itemsize == kind[name].itemsize else records[name]
    parts = [p.tobytes() for p in np.split(packed, first[1:])] if len(records) else []
    return pa.table([pa.array(records["doc"][first]), pa.array(records["version"][first]), pa.array(parts, pa.binary())], ["doc_id", "version", "marks"])


def _judged(table: pa.Table) -> pa.Table:
    """Verdicts on the pieces of a bucket of minimizers."""
    records = np.frombuffer(b"".join(table.column("block").to_pylist()), _PIECE)
    given = records[(records["kind"] > 0)]
    open_ = records[records["kind"] == 0]
    open_ = open_[np.lexsort((open_["start"], open_["doc"], open_["content"], open_["node"]))]
    if len(open_):
        beacon = open_["n"] == BEACON
        node_first, of_node = _runs(open_["node"])
        told = np.logical_or.reduceat(beacon, node_first)[of_node]
        open_, of_node, told = open_[~beacon], of_node[~beacon], told[~beacon]
    if len(open_):
        same, of_same = _runs(open_["node"], open_["content"])
        count = np.add.reduceat(open_["n"].astype(np.int64), same)[of_same]
        differ = np.bincount(of_node[same], minlength=of_node[-1] + 1)[of_node] > 1
        kind = np.where(count > 1, SOLID, 0)
        lead = np.zeros(len(open_), bool)
        lead[same] = True
        kind = np.where(lead & (differ | told), kind | OPEN, kind)
        open_ = open_.copy()
        open_["kind"] = kind
        given = np.concatenate([given, open_[kind > 0]])
    return _packed(given, _JUDGED)


_PIECES_SQL = "doc_id bigint, version int, start int, edges int, kind int, content bigint, before bigint, after bigint"


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, version, verdicts): one row for each piece, with the repeated pieces that stand right before and after it."""
    for batch in batches:
        lists = batch.column(2)
        parts = lists.flatten().to_pylist()
        owner = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
        records = np.frombuffer(b"".join(parts), _JUDGED)
        of = np.repeat(owner, [len(p) // _JUDGED.itemsize for p in parts])
        by = np.lexsort((records["start"], of))
        records, of = records[by], of[by]
        first, _ = _runs(of, records["start"]) if len(of) else (np.zeros(0, int), None)  # repeated rows have equal pieces
        kind = np.bitwise_or.reduceat(records["kind"], first) if len(of) else np.zeros(0, np.uint8)
        records, of = records[first], of[first]
        start, edges, content = records["start"], records["edges"].astype(np.int32), records["content"]
        solid = kind & SOLID > 0
        linked = solid[:-1] & solid[1:] & (of[1:] == of[:-1]) & (start[:-1] + edges[:-1] == start[1:]) if len(of) else np.zeros(0, bool)
        alone = np.ones(1, bool)[: len(of)]
        after = pa.array(np.concatenate([content[1:], content[:1]]), mask=np.concatenate([~linked, alone]))
        before = pa.array(np.concatenate([content[-1:], content[:-1]]), mask=np.concatenate([alone, ~linked]))
        where = pa.array(of)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(where), batch.column(1).take(where), pa.array(start), pa.array(edges), pa.array(kind.astype(np.int32)), pa.array(content), before, after],
            ["doc_id", "version", "start", "edges", "kind", "content", "before", "after"],
        )


def successors(pieces: DataFrame) -> DataFrame:
    """One row for each content of repeated pieces: its edges, and its only predecessor and successor if it has one."""
    solid = pieces.where(F.col("kind").bitwiseAND(SOLID) > 0)
    only = [F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count("*")), F.min(c)).alias(c) for c in ("before", "after")]
    return solid.groupBy("content").agg(F.min("edges").alias("edges"), *only)


def links(table: DataFrame) -> DataFrame:
    """(node, to) of :func:`successors`: ``node`` always follows ``to``, which is always followed by it."""
    ahead = table.where("after is not null").select(F.col("content").alias("to"), F.col("after").alias("node"))
    back = table.where("before is not null").select(F.col("content").alias("node"), F.col("before").alias("to"))
    return back.join(ahead, ["node", "to"])


def compacted(link: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, path): the first piece of each nonbranching path, for all pieces of it but the first.

    A path's links are halved in each round, by a join of the pointers with themselves. Links never close a
    circle: every document has a first and a last piece, which ends a path."""
    follows = link.select(F.col("node").alias("to"), F.lit(True).alias("more"))
    held = staged(link.join(follows, "to", "left").select("node", "to", F.col("more").isNull().alias("done")), "pointers")
    found, tables = [], [held]
    for _ in range(rounds):
        found.append(held.where("done").select("node", "to", "done"))
        waiting = held.where("not done").select("node", "to", "done")
        if waiting.isEmpty():
            out = staged(reduce(DataFrame.unionByName, found).select("node", F.col("to").alias("path")), "paths")
            discard(*tables)
            return out
        onward = reduce(DataFrame.unionByName, [*found, waiting]).toDF("to", "next", "end")
        held = staged(waiting.join(onward, "to").select("node", F.col("next").alias("to"), F.col("end").alias("done")), "pointers")
        tables.append(held)
    raise RuntimeError(f"paths are not compact after {rounds} rounds")


def occurrences(pieces: DataFrame) -> DataFrame:
    """(doc_id, version, start, edges) of all paths."""
    table = staged(successors(pieces), "successors")
    link = staged(links(table), "links")
    paths = compacted(link)
    whole = table.join(paths, F.col("content") == F.col("node"), "left").groupBy(F.coalesce("path", "content").alias("content")).agg(F.sum("edges").cast("int").alias("total"))
    solid = pieces.where(F.col("kind").bitwiseAND(SOLID) > 0).select("doc_id", "version", "start", "content")
    # both sides are dealt out anew, so that a very common passage can be split
    out = staged(solid.join(staged(whole, "wholes"), "content").select("doc_id", "version", "start", F.col("total").alias("edges")), "occurrences")
    discard(table, link, paths)
    return out


def _spans(start: np.ndarray, edges: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and edges of a document's paths, and of the single edges of its branching pieces."""
    ones = np.concatenate([np.zeros(0, int), *(np.arange(s, s + n) for s, n in zip(start[single], edges[single], strict=True))])
    return np.concatenate([start[~single], ones]).astype(np.int64), np.concatenate([edges[~single], np.ones(len(ones), int)]).astype(np.int64)


def _digests(words: list[bytes], start: np.ndarray, edges: np.ndarray, window: int) -> np.ndarray:
    """Spans with the digests of their words."""
    out = np.empty(len(start), _SPAN)
    made = [hashlib.blake2b(b" ".join(words[s : s + n + window - 1]), digest_size=16).digest() for s, n in zip(start.tolist(), edges.tolist(), strict=True)]
    both = np.frombuffer(b"".join(made), "<u8").reshape(-1, 2)
    out["one"], out["two"], out["start"], out["edges"], out["n"] = both[:, 0], both[:, 1], start, edges, 1
    return out


def _reader(window: int, buckets: int, text: bool):
    """Finishes the documents without repeated pieces; deals the spans of the others, digested."""

    def here(held: np.ndarray) -> Iterator[pa.RecordBatch]:
        held = held[np.lexsort((held["start"], held["doc"], held["two"], held["one"]))]
        first, of = _runs(held["one"], held["two"])
        size = np.diff(np.concatenate([first, [len(held)]]))
        sent = held[first].copy()
        sent["n"] = np.where(size > 1, BEACON, 1)
        place, parts = _dealt(sent, ((sent["one"] >> np.uint64(13)) & np.uint64(buckets - 1)).astype(np.int32))
        yield _row(bucket=place, block=parts)
        done = held[size[of] > 1]
        if len(done):
            yield _row(**{k: v.to_pylist() for k, v in zip(("doc_id", "version", "marks"), _packed(done, _MARK).columns, strict=True)})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            docs, versions, lists = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(3)
            fields = lists.flatten()
            start, edges, single = (fields.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            at = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))])
            for first, last, texts in text_blocks(batch.column(2)):
                ready, waiting = [], []
                for i, raw in enumerate(texts, first):
                    if at[i] == at[i + 1]:
                        ready.append(i)
                        continue
                    waiting.append(i)
                    own = slice(at[i], at[i + 1])
                    found = _digests((raw or b"").split(), *_spans(start[own], edges[own], single[own]), window)
                    found["doc"], found["version"] = docs[i], versions[i]
                    held.append(found)
                    rows += len(found)
                if ready:
                    made = [_cut(texts[i - first], None, window, text) for i in ready]
                    yield _row(doc_id=docs[ready], version=versions[ready], **dict(zip(("n_words", "n_removed", "kept_sha256", "kept"), zip(*made, strict=True), strict=True)))
                if waiting:
                    yield _row(doc_id=docs[waiting], version=versions[waiting], text=[texts[i - first] or b"" for i in waiting])
                if rows >= HELD:
                    yield from here(np.concatenate(held))
                    held, rows = [], 0
        if held:
            yield from here(np.concatenate(held))

    return released(read)


_STAGE = pa.schema([("bucket", pa.int32()), ("block", pa.binary()), ("doc_id", pa.int64()), ("version", pa.int32()), ("text", pa.binary()), ("marks", pa.binary()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])
_STAGE_SQL = "bucket int, block binary, doc_id bigint, version int, text binary, marks binary, n_words bigint, n_removed bigint, kept_sha256 string, kept string"


def _row(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _STAGE], schema=_STAGE)


def _compared(table: pa.Table) -> pa.Table:
    """Marks for the spans of a bucket whose words occur in more than one place."""
    held = np.frombuffer(b"".join(table.column("block").to_pylist()), _SPAN)
    held = held[np.lexsort((held["start"], held["doc"], held["two"], held["one"]))]
    first, of = _runs(held["one"], held["two"])
    many = np.add.reduceat(held["n"].astype(np.int64), first)[of] > 1
    return _packed(held[many & (held["n"] == 1)], _MARK)


def _cut(text: bytes | None, marks: np.ndarray | None, window: int, with_text: bool) -> tuple[int, int, str, str | None]:
    """n_words, n_removed, digest of the kept words joined by one space; and, if asked for, the text: as it was
    where nothing goes, else the runs of kept words as they stand, joined by one space."""
    text = text or b""
    if marks is None or not len(marks):
        words = text.split()
        return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest(), text.decode() if with_text else None
    starts, ends = bounds(np.frombuffer(text, np.uint8))
    n = len(starts)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, marks["start"], 1)
    np.add.at(change, marks["start"].astype(np.int64) + marks["edges"] + window - 1, -1)
    stays = np.cumsum(change[:-1]) <= 0
    kept = b" ".join([text[s:e] for s, e in zip(starts[stays].tolist(), ends[stays].tolist(), strict=True)])
    left = None
    if with_text:
        edge = np.diff(np.concatenate([[0], stays.view(np.int8), [0]]))
        runs = zip(starts[np.flatnonzero(edge[:-1] == 1)].tolist(), ends[np.flatnonzero(edge[1:] == -1)].tolist(), strict=True)
        left = b" ".join([text[s:e] for s, e in runs]).decode()
    return n, int(n - stays.sum()), hashlib.sha256(kept).hexdigest(), left


def _finisher(window: int, text: bool):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, texts in text_blocks(batch.column(2)):
                more = batch.column(3).slice(first, last - first).to_pylist()
                made = [_cut(t, np.frombuffer(b"".join(m or ()), _MARK), window, text) for t, m in zip(texts, more, strict=True)]
                n, removed, digest, kept = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:last], batch.column(1)[first:last], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())],
                    ["doc_id", "version", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    return released(finish)


def version(text: str = "text") -> Column:
    """Tells the texts of rows with one id apart."""
    return F.coalesce(F.hash(F.col(text)), F.lit(0))


def mark(docs: DataFrame, window: int = 35, text: bool = False) -> DataFrame:
    """doc_id, version, n_words, n_removed, kept_sha256 and, if asked for, the kept text, for every row."""
    key, verdicts = ["doc_id", "version"], "doc_id bigint, version int, marks binary"
    rows = docs.select(F.coalesce("doc_id", F.lit(-(1 << 62))).alias("doc_id"), version().alias("version"), F.col("text").cast("binary").alias("text"))
    buckets = bucket_count(docs)
    dealt = rows.mapInArrow(_piece_dealer(window, buckets), "bucket int, block binary")
    judged = dealt.groupBy("bucket").applyInArrow(_judged, verdicts).groupBy(*key).agg(F.collect_list("marks").alias("marks"))
    pieces = staged(judged.mapInArrow(released(_in_order), _PIECES_SQL), "pieces")
    open_ = pieces.where(F.col("kind").bitwiseAND(OPEN) > 0).select(*key, "start", "edges", F.lit(True).alias("single"))
    found = occurrences(pieces)
    spans_of = found.withColumn("single", F.lit(False)).unionByName(open_)
    by_doc = spans_of.groupBy(*key).agg(F.collect_list(F.struct("start", "edges", "single")).alias("spans"))
    stage = staged(rows.join(by_doc, key, "left").select(*key, "text", "spans").mapInArrow(_reader(window, buckets, text), _STAGE_SQL), "spans")
    discard(pieces, found)
    compared = stage.where("block is not null").select("bucket", "block").groupBy("bucket").applyInArrow(_compared, verdicts)
    here = stage.where("marks is not null").select(*key, "marks")
    more = compared.unionByName(here).groupBy(*key).agg(F.collect_list("marks").alias("more"))
    waiting = stage.where("text is not null").select(*key, "text").join(more, key, "left")
    finished = waiting.mapInArrow(_finisher(window, text), "doc_id bigint, version int, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
    ready = stage.where("n_words is not null").select(*key, "n_words", "n_removed", "kept_sha256", "kept")
    out = ready.unionByName(finished)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 62), F.col("doc_id")))
