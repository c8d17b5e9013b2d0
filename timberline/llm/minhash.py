"""Near duplicates by MinHash: universal hash minima, banding, signature verification, full-set
confirmation, and connected components by alternating large-star and small-star.

A document's set holds its distinct shingles of ``width`` words (A-Z lower-cased); with fewer words the
whole sequence is the one shingle. Two documents are linked when 100 * intersection >= percent * union.
Documents with equal sets form a class; classes, not ids, are the nodes of all that follows.

1. Banding finds the classes that share a band with any other: with probability
   1 - (1 - 0.8 ** ROWS) ** BANDS, over 0.9999999, for a linked pair at the threshold. Band keys travel
   alone, and a task sends one member of each of its buckets.
2. For these classes signatures travel too. Each bucket is cut into canopies: a member whose signature
   agrees with that of a canopy's head in TIGHT places or more makes no canopy of its own, and members
   that agree with a head in LOOSE places or more belong to the head's family. Tasks cut their own buckets
   first and send the heads on. A bucket yields, for each member, the head that it is most like and one edge
   of its family: never all pairs.
3. Each member is confirmed on full sets with the head it is most like of all its buckets, then with the
   next ones if they are still apart, and the components of the links so found are joined: copies of one text
   are done here, in a pair or two each.
4. Families that are one component by now are left alone. In the others, signatures are compared in tiles of
   two blocks, so that memory is bounded; the largest component's blocks meet the others' blocks, not each
   other. Members that agree with none of another component in LIKELY places or more are done. What is left
   falls into smaller families, whose pairs across components are confirmed on full sets by matrix products
   over tiles of texts. A tile returns what spans its components, never all its pairs.
5. Components of these links are labelled by large-star and small-star.

Cases: null and empty texts, and texts without words, have empty sets and are linked with nothing; rows
with one id and several texts are judged apart, and each gets the smallest id of its component; rows
without an id never name a component (if it has no other rows, its id is null and all are kept); very long texts are read whole;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import bucket_count, discard, released, staged
from .words import hashed_texts, mixed, text_blocks

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS

#: Places (of 128) in which signatures agree. Linked documents agree in 102, with a deviation of 4.5. A member
#: that is TIGHT to a head may stand behind it: what is linked with the member is LOOSE to the head at least,
#: and so of its family. Pairs below LIKELY aren't worth confirming (six deviations).
TIGHT, LOOSE, LIKELY = 100, 56, 75

#: Heads that a member is confirmed with, one after another, as long as it is apart from them.
STARS = 3

#: Documents, and bytes of text, of a block; a tile holds two blocks.
BLOCK_ROWS, BLOCK_BYTES = 500, 16 << 20
#: Signatures of a block, at least and at most.
SIGN_ROWS = (128, 2000)

_SEEDS = np.random.default_rng(7).integers(0, 1 << 63, (2, HASHES), dtype=np.uint64)
_FACTORS = _SEEDS[0] * np.uint64(2) + np.uint64(1)
_OFFSETS = _SEEDS[1]


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words, or of all words where they are fewer."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return np.unique(out)


def minima(items: np.ndarray) -> np.ndarray:
    """The HASHES minima of a non-empty set, each by its own universal hash (top 32 bits)."""
    best = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 256):
        hashed = items[at : at + 256, None] * _FACTORS
        hashed += _OFFSETS
        np.minimum(best, hashed.min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    rows = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return keys


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def _signer(width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = batch.column(0), batch.column(2)
            for first, last, texts in text_blocks(batch.column(1)):
                found, at = hashed_texts(texts, lower=True)
                size, one, two, signs = [], [], [], []
                for i in range(last - first):
                    items = shingles(found[at[i] : at[i + 1]], width)
                    size.append(len(items))
                    one.append(np.add.reduce(mixed(items), dtype=np.uint64))
                    two.append(np.add.reduce(mixed(items ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64))
                    signs.append(minima(items).tobytes() if len(items) else None)
                yield pa.RecordBatch.from_arrays(
                    [ids[first:last], versions[first:last], pa.array(size, pa.int64()), pa.array(_signed(np.array(one))), pa.array(_signed(np.array(two))), pa.array(signs, pa.binary())],
                    ["doc_id", "version", "n_shingles", "set_a", "set_b", "signature"],
                )

    return released(sign)


_MEMBER = np.dtype([("band", "<u8"), ("doc", "<i8")])
_SIGNED = np.dtype([("band", "<u8"), ("doc", "<i8"), ("sign", "u1", (HASHES,))])


def _first_of(keys: np.ndarray) -> np.ndarray:
    """For each place of a sorted array, the first place with an equal value."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))


def _in_buckets(records: np.ndarray, buckets: int) -> pa.RecordBatch:
    place = ((records["band"] >> np.uint64(20)) & np.uint64(buckets - 1)).astype(np.int32)
    by = np.argsort(place, kind="stable")
    records, place = records[by], place[by]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1]) if len(place) else np.zeros(0, int)
    parts = [part.tobytes() for part in np.split(records, starts[1:])] if len(place) else []
    none = pa.nulls(len(parts), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(place[starts]), pa.array(parts, pa.binary()), none, none, pa.nulls(len(parts), pa.int32())], ["bucket", "block", "a", "b", "agree"])


def _pairs(a: np.ndarray, b: np.ndarray, agree: np.ndarray) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays(
        [pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(agree, pa.int32())], ["bucket", "block", "a", "b", "agree"]
    )


_Cut = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _sharing(members: np.ndarray) -> _Cut:
    """The first member of each bucket; and (member, first, 0) for the others."""
    members = members[np.lexsort((members["doc"], members["band"]))]
    first = _first_of(members["band"])
    alone = first == np.arange(len(first))
    return members[alone], members["doc"][~alone], members["doc"][first[~alone]], np.zeros(int((~alone).sum()), np.int32)


def _canopies(members: np.ndarray) -> _Cut:
    """The heads of the canopies of each bucket; and (member, head, places in which they agree): for each
    member the head it is most like, and what else joins the heads of a family."""
    members = members[np.lexsort((members["doc"], members["band"]))]
    edges = np.flatnonzero(np.concatenate([[True], members["band"][1:] != members["band"][:-1], [True]]))
    heads_of, a, b, agree = [members[edges[:-1][np.diff(edges) == 1]]], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for at in np.flatnonzero(np.diff(edges) > 1).tolist():
        part = members[edges[at] : edges[at + 1]]
        signs, docs, n = part["sign"], part["doc"], edges[at + 1] - edges[at]
        heads, behind = [], np.zeros(n, bool)
        best, best_head = np.full(n, LOOSE - 1, np.int32), np.full(n, -1)
        family = np.arange(n)  # of heads and of the members they were first loose to
        joined = np.zeros(n, bool)
        for head in range(n):
            if behind[head]:
                continue
            heads.append(head)
            like = (signs == signs[head]).sum(axis=1, dtype=np.int32)
            like[head] = 0
            near = like >= LOOSE
            if not near.any():
                continue
            behind |= like >= TIGHT
            better = near & (like > best)
            best[better], best_head[better] = like[better], head
            # families that meet in this head, by one member each
            met = np.flatnonzero(near & joined)
            which, first = np.unique(family[met], return_index=True)
            own = family[head] if joined[head] else head
            for f, k in zip(which.tolist(), met[first].tolist()):
                if f != own:
                    a.append(docs[[k]])
                    b.append(docs[[head]])
                    agree.append(like[[k]])
                    family[family == f] = own
            fresh = near & ~joined
            family[fresh], family[head] = own, own
            joined |= near
            joined[head] = True
        found = np.flatnonzero(best_head >= 0)
        a.append(docs[found])
        b.append(docs[best_head[found]])
        agree.append(best[found])
        heads_of.append(part[heads])
    return np.concatenate(heads_of), np.concatenate(a), np.concatenate(b), np.concatenate(agree)


def _bander(buckets: int, signed: bool):
    """Deals members by band; what a task finds within itself leaves as pairs."""
    cut = _canopies if signed else _sharing

    def deal(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        heads, a, b, agree = cut(np.concatenate(held))
        yield _pairs(a, b, agree)
        yield _in_buckets(heads, buckets)

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            docs = np.asarray(batch.column(0))
            signatures = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, HASHES)
            for at in range(0, len(docs), 5000):
                part = signatures[at : at + 5000]
                members = np.empty((len(part), BANDS), _SIGNED if signed else _MEMBER)
                members["band"], members["doc"] = band_keys(part), docs[at : at + 5000, None]
                if signed:
                    members["sign"] = (part & np.uint32(255)).astype(np.uint8)[:, None, :]
                held.append(members.ravel())
                rows += len(part)
                if rows >= (5_000 if signed else 50_000):
                    yield from deal(held)
                    held, rows = [], 0
        if held:
            yield from deal(held)

    return released(band)


def _meeter(signed: bool):
    def meet(table: pa.Table) -> pa.Table:
        records = np.frombuffer(b"".join(table.column("block").to_pylist()), _SIGNED if signed else _MEMBER)
        _, a, b, agree = (_canopies if signed else _sharing)(records)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(agree, pa.int32())], ["a", "b", "agree"])

    return meet


def paired(classes: DataFrame, signed: bool) -> DataFrame:
    """Distinct (a, b, agree) of members of a bucket (or of its canopies, if ``signed``) with a head."""
    buckets = bucket_count(classes, 512)
    rows = classes.select("node", "signature")
    dealt = staged(rows.mapInArrow(_bander(buckets, signed), "bucket int, block binary, a bigint, b bigint, agree int"), "bands")
    near = dealt.where("a is not null").select("a", "b", "agree")
    far = dealt.where("block is not null").select("bucket", "block").groupBy("bucket").applyInArrow(_meeter(signed), "a bigint, b bigint, agree int")
    out = staged(near.unionByName(far).where("a != b").distinct(), "pairs")
    discard(dealt)
    return out


def _star_confirmer(width: int, percent: int):
    """Of (a, b, text, head_text): the (a, b) whose texts are linked."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = batch.column(3)
            for first, last, texts in text_blocks(batch.column(2)):
                found, at = hashed_texts(texts, lower=True)
                other, to = hashed_texts(heads.slice(first, last - first).to_pylist(), lower=True)
                keep = []
                for i in range(last - first):
                    one, two = shingles(found[at[i] : at[i + 1]], width), shingles(other[to[i] : to[i + 1]], width)
                    both = len(np.intersect1d(one, two, assume_unique=True))
                    keep.append((100 + percent) * both >= percent * (len(one) + len(two)))
                yield pa.RecordBatch.from_arrays([c.slice(first, last - first).filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return released(confirm)


def _tile_confirmer(width: int, percent: int):
    def confirm(table: pa.Table) -> pa.Table:
        """Links (a, b) that span the components of one tile; a component's own pairs aren't looked at."""
        docs, of = np.asarray(table.column("node")), np.asarray(table.column("part"))
        found, at = hashed_texts(table.column("load").to_pylist(), lower=True)
        sets = [shingles(found[at[i] : at[i + 1]], width) for i in range(len(docs))]
        size = np.array([len(s) for s in sets])
        kinds, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(docs)), size)
        shared = count[column] > 1
        # only shingles that two documents have count; their columns are taken some at a time
        number = np.cumsum(count > 1) - 1
        row, column = row[shared], number[column[shared]]
        by = np.argsort(column, kind="stable")
        row, column = row[by], column[by]
        both = np.zeros((len(docs), len(docs)), np.float32)
        step, top = max(64, (4 << 20) // len(docs)), int((count > 1).sum())
        for first in range(0, top, step):
            a, b = np.searchsorted(column, [first, first + step])
            part = np.zeros((len(docs), min(step, top - first)), np.float32)
            part[row[a:b], column[a:b] - first] = 1
            both += part @ part.T
        linked = (100 + percent) * both.astype(np.int64) >= percent * (size[:, None] + size[None, :])
        linked |= of[:, None] == of[None, :]
        labels = np.arange(len(docs))
        while True:
            new = np.where(linked, labels[None, :], len(docs)).min(axis=1, initial=len(docs))
            new = np.minimum(new, labels)
            new = new[new]
            if (new == labels).all():
                break
            labels = new
        keep = of[labels] != of
        links = np.unique(np.stack([of[keep], of[labels][keep]]), axis=1)
        return pa.table([pa.array(links[0], pa.int64()), pa.array(links[1], pa.int64())], ["a", "b"])

    return confirm


def stars(pairs: DataFrame, families: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, family, part), written: parts are the components of the links among each member's pairs with the
    STARS heads it is most like, confirmed on full sets one after another; once two are one part, their
    pair isn't looked at."""
    likely = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("agree"), "b")).alias("turn")
    ranked = staged(pairs.where(F.col("agree") >= LIKELY).select("a", "b", likely).where(F.col("turn") <= STARS), "ranked")
    parts = staged(families.select("node", "family", F.col("node").alias("part")), "parts")
    for turn in range(1, STARS + 1):
        own, other = parts.select(F.col("node").alias("a"), F.col("part").alias("pa")), parts.select(F.col("node").alias("b"), F.col("part").alias("pb"))
        apart = ranked.where(F.col("turn") == turn).join(own, "a").join(other, "b").where("pa != pb")
        members = apart.join(texts.select(F.col("node").alias("a"), "text"), "a")
        both = members.join(texts.select(F.col("node").alias("b"), F.col("text").alias("head_text")), "b").select("pa", "pb", "text", "head_text")
        linked = staged(both.mapInArrow(_star_confirmer(width, percent), "a bigint, b bigint"), "linked")
        label = components(linked).toDF("part", "label")
        new = staged(parts.join(label, "part", "left").select("node", "family", F.coalesce("label", "part").alias("part")), "parts")
        discard(parts, linked)
        parts = new
    discard(ranked)
    return parts


def _likely(table: pa.Table) -> pa.Table:
    """(a, b): what joins the nodes of one tile whose signatures are LIKELY across parts."""
    nodes, of = np.asarray(table.column("node")), np.asarray(table.column("part"))
    signs = np.frombuffer(b"".join(table.column("load").to_pylist()), np.uint8).reshape(-1, HASHES)
    label, near = np.arange(len(nodes)), np.zeros(len(nodes), bool)
    for k in range(1, len(nodes)):
        like = np.flatnonzero(((signs[:k] == signs[k]).sum(axis=1) >= LIKELY) & (of[:k] != of[k]))
        if len(like):
            near[like], near[k] = True, True
            met = np.unique(label[like])
            label[np.isin(label, met)] = met[0]
            label[k] = met[0]
    return pa.table([pa.array(nodes[near]), pa.array(nodes[label[near]])], ["a", "b"])


def _low_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).astype(np.uint8).reshape(-1, HASHES)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in signs], pa.binary())], ["node", "load"])


def _tiles(held: DataFrame, rows_of: Column, most_bytes: int) -> DataFrame:
    """node, part, load, family, i and j: rows of (node, family, part, load) in every tile (i, j) of two blocks
    that they are part of. The largest part's blocks meet those of the others, which also meet each other."""
    parts = held.groupBy("family", "part").agg(F.count("*").alias("n"), F.sum(F.octet_length("load")).alias("bytes"))
    most = F.max(F.struct("n", "part")).alias("most")
    mains = parts.groupBy("family").agg(most, F.sum("n").alias("all")).select("family", F.col("most.part").alias("main"), "all")
    of_main = F.col("part") == F.col("main")
    sizes = parts.join(mains, "family").groupBy("family", "main", "all", of_main.alias("of_main")).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    blocks_of = F.greatest(F.ceil(F.col("n") / rows_of), F.ceil(F.col("bytes") / most_bytes)).cast("int")
    counts = sizes.groupBy("family", "main").agg(F.coalesce(F.sum(F.when(~F.col("of_main"), blocks_of)), F.lit(0)).alias("others"), F.sum(F.when(F.col("of_main"), blocks_of)).alias("mains"))
    rows = held.join(staged(counts.where("others > 0"), "sizes"), "family")
    # blocks 0 .. others - 1 hold the smaller parts, those from there on the largest one
    own = F.when(of_main, F.col("others") + F.pmod(F.xxhash64("node"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("node"), F.col("others")))
    every = F.when(of_main, F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1).cast("int")
    tiles = rows.withColumn("own", own.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), every)))
    return tiles.select("node", "part", "load", "family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def across(families: DataFrame, near: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between parts, written; ``families``: (node, family, part), ``near``: (node, signature)."""
    open_ = families.groupBy("family").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low != high").select("family")
    apart = staged(families.join(open_, "family"), "apart")
    signs = near.select("node", "signature").mapInArrow(released(_low_bytes), "node bigint, load binary")
    signs = staged(apart.join(signs, "node"), "signs")
    rows_of = F.least(F.lit(SIGN_ROWS[1]), F.greatest(F.lit(SIGN_ROWS[0]), F.col("all") / 16))
    likely = staged(_tiles(signs, rows_of, BLOCK_BYTES).groupBy("family", "i", "j").applyInArrow(_likely, "a bigint, b bigint"), "likely")
    label = components(likely)
    label = label.unionByName(label.select(F.col("component").alias("node"), "component")).distinct()
    held = staged(apart.select("node", "part").join(label.toDF("node", "family"), "node").join(texts.withColumnRenamed("text", "load"), "node"), "held")
    out = _tiles(held, F.lit(BLOCK_ROWS), BLOCK_BYTES).groupBy("family", "i", "j").applyInArrow(_tile_confirmer(width, percent), "a bigint, b bigint")
    out = staged(out, "across")
    discard(apart, signs, likely, held)
    return out


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for all nodes with links (a, b) but the smallest ones.

    Alternates large-star (neighbours above a node move to its smallest neighbour) and small-star
    (those below do), each followed by a checkpoint, until nothing changes. As the rounds needed grow with
    the logarithm of the links, so many are never used up; if they were, it is an error.
    """

    def checked(edges: DataFrame) -> DataFrame:
        return edges.distinct().checkpoint()

    edges = checked(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    before = None
    for _ in range(rounds):
        # minima are written, so that joins deal out both sides anew and can split a node with very many links
        least = staged(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
        large = checked(edges.join(least.select(F.col("a").alias("b"), "m"), "b", "left").select("a", F.coalesce("m", "b").alias("b")))
        below = staged(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(below, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checked(small.unionByName(below.select("a", F.col("m").alias("b"))))
        discard(least, below)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        if tuple(now) == before or now[0] == now[2] and not edges.join(edges.select(F.col("a").alias("x")), F.col("b") == F.col("x"), "left_semi").take(1):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = tuple(now)
    raise RuntimeError(f"components are not complete after {rounds} rounds")


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("version"))
    signed = docs.mapInArrow(_signer(width), "doc_id bigint, version bigint, n_shingles bigint, set_a bigint, set_b bigint, signature binary")
    signed = staged(signed, "signatures")
    # one node for each class of equal sets, with one of its rows; numbers are fixed by writing them
    first = [F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "version")).alias("row"), F.min("signature").alias("signature")]
    classes = signed.where("n_shingles > 0").groupBy("set_a", "set_b").agg(*first)
    classes = staged(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    shared = paired(classes, signed=False)
    near = shared.select(F.col("a").alias("node")).unionByName(shared.select(F.col("b").alias("node"))).distinct()
    near = staged(classes.join(near, "node", "left_semi"), "near")
    discard(shared)
    pairs = paired(near, signed=True)
    families = components(pairs)
    families = staged(families.unionByName(families.select(F.col("component").alias("node"), "component")).distinct().toDF("node", "family"), "families")
    rows = near.join(families, "node").select("node", F.col("row.doc_id").alias("row_id"), F.col("row.version").alias("row_version"))
    texts = docs.join(rows, F.col("doc_id").eqNullSafe(F.col("row_id")) & (F.col("version") == F.col("row_version"))).select("node", "text")
    texts = staged(texts.dropDuplicates(["node"]), "texts")
    whole = stars(pairs, families, texts, width, percent)
    crossed = across(whole, near, texts, width, percent)
    more = staged(components(crossed).toDF("part", "label"), "joined")
    discard(pairs, near, texts, families, crossed)
    labels = whole.join(more, "part", "left").select("node", F.coalesce("label", "part").alias("label"))
    labels = classes.join(labels, "node", "left").select("set_a", "set_b", "least_id", F.coalesce("label", "node").alias("label"), F.col("label").isNotNull().alias("in_family"))
    labels = staged(labels, "labels")
    discard(classes, whole, more)
    least = labels.where("in_family").groupBy("label").agg(F.min("least_id").alias("family_least"))
    ids = labels.join(staged(least, "least"), "label", "left").select("set_a", "set_b", F.when(F.col("in_family"), F.col("family_least")).otherwise(F.col("least_id")).alias("component_id"))
    out = signed.join(ids, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
