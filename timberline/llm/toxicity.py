"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input joins a word part and a character part, both embeddings that the network learns by itself:
that of the word, and the mean of those of its character n-grams (word ends marked). Words and n-grams that
fewer than one in ``SHARE`` texts of the training sample hold share one embedding, that of the unknown. A forward
and a backward gated recurrent layer read each window of ``WINDOW`` words, attention pools their states, and
a logistic unit scores the window. Windows overlap by a quarter and cover the whole text; a document scores
as its highest window. Nothing is counted by label: all that tells toxic from clean comes from the gradient.

The network is fitted to a bounded sample: of the labelled rows that may be learned from, those with the
smallest hashes, up to ``SAMPLE_ROWS`` rows and ``SAMPLE_BYTES`` of text of either label. A text that
doesn't fit is left out and the next one tried; a label of which no row fits is an error. Rows are chosen by
their sizes alone; their texts go to the shared folder, and one executor task reads them there and trains.
Only the weights (:data:`MODEL_BYTES` at most) reach the driver. Scoring reads every text.

Cases: null and empty texts, and texts without words, get the score of an empty window; repeated labels
count as often as they occur; without labels of both kinds every score is 0; an empty table gives an empty
result; texts of any length are whole; extra columns pass through, but in :func:`scored` columns named
``toxic_score`` and the text give way to the score.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import released, staged, widened
from .words import _LOWER, _TABLE, blocks, mixed, spans, text_blocks

#: Bounds of the training sample: rows, and bytes of text, of each label.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 6 << 20

WINDOW, STEP = 24, 18
HIDDEN, WIDTH = 8, 8
#: Slots that words, and n-grams, are hashed to; the most of either that have embeddings of their own.
SLOTS, KNOWN = 1 << 18, 1 << 14
#: A word or an n-gram has an embedding of its own if one text in so many of the sample holds it, 3 texts at least.
SHARE = 75
#: The learning rate; the shares of clean and of toxic texts that the later epochs leave out.
RATE, TRIM = 0.01, (0.02, 0.12)
#: Lengths of the n-grams, in bytes with word ends marked.
GRAMS = (4, 6)
#: Values of a word's input: two embeddings, and that there is a word.
INPUTS = 2 * WIDTH + 1
#: What the weights of a model take at most.
MODEL_BYTES = 4 << 20

#: Bytes that are no part of a word here: controls, white space and ASCII punctuation.
_CUTS = np.ones(256, bool)
_CUTS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def may_learn(doc_id: str = "doc_id"):
    """Rows whose labels may be learned from."""
    return F.expr(f"crc32(cast(cast({doc_id} as string) as binary)) % 5 != 0")


def _hashed(buf: np.ndarray, start: np.ndarray, end: np.ndarray, size: int = 1 << 20) -> np.ndarray:
    """Hashes of the words of ``buf``, some at a time, so that tables of powers stay small."""
    cuts = np.searchsorted(start, np.arange(size, len(buf), size))
    out = [np.zeros(0, np.uint64)]
    for s, e in zip(np.split(start, cuts), np.split(end, cuts), strict=True):
        if len(s):
            out.append(spans(_TABLE[buf[s[0] : e[-1]]], s - s[0], e - s[0]))
    return np.concatenate(out)


def _slots(found: np.ndarray) -> np.ndarray:
    """Slots 1 and up, 0 for none."""
    shift = np.uint64(64 - SLOTS.bit_length() + 1)
    return np.where(found > 0, np.maximum(found >> shift, 1), 0).astype(np.int64)


class Words:
    """The words of a block of texts: ``number`` tells each word's kind, ``at`` where texts start; of the
    kinds, hashed words and the hashed n-grams at each of their (marked) bytes."""

    def __init__(self, texts: list[bytes | None]):
        buf = _LOWER[np.frombuffer(b" ".join(t or b"" for t in texts), np.uint8)]
        inside = np.zeros(len(buf) + 2, bool)
        np.logical_not(_CUTS[buf], out=inside[1:-1])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[0::2], edges[1::2]
        kinds, first, self.number = np.unique(_hashed(buf, start, end), return_index=True, return_inverse=True)
        ends = np.cumsum([len(t or b"") + 1 for t in texts])
        self.at = np.concatenate([[0], np.searchsorted(start, ends)]).astype(np.int64)
        self.kinds = kinds
        # the kinds' bytes, marked at both ends
        start, size = start[first], (end - start)[first]
        self.size = size + 2
        self.first = np.cumsum(self.size) - self.size
        n = int(self.size.sum())
        left = np.arange(n) - np.repeat(self.first, self.size)
        place = np.repeat(start - 1, self.size) + left
        marked = buf[np.clip(place, 0, max(0, len(buf) - 1))] if n else np.zeros(0, np.uint8)
        marked[self.first], marked[self.first + size + 1] = 60, 62
        self.left = np.repeat(self.size, self.size) - left  # bytes from here to the word's end
        self.values = _TABLE[marked]

    def word_slots(self) -> np.ndarray:
        """The slot of each kind."""
        return _slots(mixed(self.kinds))

    def gram_slots(self, n: int) -> np.ndarray:
        """The slot of the n-gram that starts at each byte of the kinds; 0 where the word ends before."""
        padded = np.concatenate([self.values, np.zeros(n, np.uint64)])
        out = np.full(len(self.values), n, np.uint64)
        for k in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + padded[k : k + len(self.values)]
        return _slots(np.where(self.left >= n, mixed(out), np.uint64(0)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Parameters and passes. Arrays run (steps, windows, values), in single precision."""

    def __init__(self, words: int = 1, grams: int = 1, seed: int = 1):
        rng = np.random.default_rng(seed)

        def random(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) * (1 / max(1, shape[0])) ** 0.5).astype(np.float32)

        def table(rows: int) -> np.ndarray:
            out = (rng.standard_normal((rows, WIDTH)) * 0.05).astype(np.float32)
            out[0] = 0
            return out

        self.p = {"word": table(words), "gram": table(grams), "att": random(2 * HIDDEN), "out": random(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"w{side}": random(INPUTS, 3 * HIDDEN), f"u{side}": random(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}

    def _run(self, given: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        u = self.p["u" + side]
        gate, last = np.ascontiguousarray(u[:, : 2 * HIDDEN]), np.ascontiguousarray(u[:, 2 * HIDDEN :])
        h = np.zeros((given.shape[1], HIDDEN), np.float32)
        out = np.empty((*given.shape[:2], HIDDEN), np.float32)
        for t in range(len(given)) if side == "f" else reversed(range(len(given))):
            old = h
            gates = h @ gate
            gates += given[t, :, : 2 * HIDDEN]
            gates *= np.float32(0.5)
            np.tanh(gates, out=gates)
            gates += 1
            gates *= np.float32(0.5)
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = (r * h) @ last
            new += given[t, :, 2 * HIDDEN :]
            np.tanh(new, out=new)
            h = new - old
            h *= z
            h += old
            out[t] = h
            if keep is not None:
                keep.append((t, old, z, r, new))
        return out

    def tables(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        """What each kind of word, and after them no word, gives to the gates of either side."""
        padded = np.concatenate([vectors, np.zeros((1, INPUTS), np.float32)])
        return {side: padded @ self.p["w" + side] + self.p["c" + side] for side in "fb"}

    def logits(self, tables: dict[str, np.ndarray], at: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """``at``: (steps, windows) numbers of kinds, the last kind where there is no word."""
        runs = {side: [] if keep is not None else None for side in "fb"}
        h = np.concatenate([self._run(tables[side][at], side, runs[side]) for side in "fb"], axis=2)
        mask = at < len(tables["f"]) - 1
        e = np.where(mask, h @ self.p["att"], np.float32(-30))
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        pooled = (a[:, :, None] * h).sum(axis=0)
        if keep is not None:
            keep |= {"h": h, "a": a, "pooled": pooled, "runs": runs, "mask": mask}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def gradients(self, keep: dict, x: np.ndarray, d: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the loss, given ``d``, its derivative by the logits; and by the inputs ``x``."""
        p, h, a = self.p, keep["h"], keep["a"]
        out = {"out": keep["pooled"].T @ d, "bias": np.array([d.sum()], np.float32)}
        dp = d[:, None] * p["out"]
        da = (h * dp).sum(axis=2)
        de = a * (da - (a * da).sum(axis=0)) * keep["mask"]
        out["att"] = np.einsum("tn,tnk->k", de, h)
        dh = a[:, :, None] * dp + de[:, :, None] * p["att"]
        dx = np.zeros_like(x)
        for side, part in (("f", dh[:, :, :HIDDEN]), ("b", dh[:, :, HIDDEN:])):
            w, u = p["w" + side], p["u" + side]
            dw, du, dc = np.zeros_like(w), np.zeros_like(u), np.zeros(3 * HIDDEN, np.float32)
            back = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, old, z, r, new in reversed(keep["runs"][side]):
                g = part[t] + back
                dz = g * (new - old) * z * (1 - z)
                dn = g * z * (1 - new * new)
                via = dn @ u[:, 2 * HIDDEN :].T
                gates = np.concatenate([dz, via * old * r * (1 - r)], axis=1)
                back = g * (1 - z) + via * r + gates @ u[:, : 2 * HIDDEN].T
                du[:, : 2 * HIDDEN] += old.T @ gates
                du[:, 2 * HIDDEN :] += (r * old).T @ dn
                every = np.concatenate([gates, dn], axis=1)
                dw += x[t].T @ every
                dc += every.sum(axis=0)
                dx[t] += every @ w.T
            out |= {"w" + side: dw, "u" + side: du, "c" + side: dc}
        return out, dx


def windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of all windows of texts whose words start at ``at``; one at least for each text."""
    size = np.diff(at)
    count = np.maximum(1, -(-(size - WINDOW) // STEP) + 1)
    owner = np.repeat(np.arange(len(size)), count)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = at[:-1][owner] + step * STEP
    return start, np.minimum(start + WINDOW, at[1:][owner]), owner


class Model:
    """Network, and the rows of its embeddings that slots have (0: unknown); ``constant``: the score of every
    text where nothing could be learned."""

    def __init__(self, words: np.ndarray | None, grams: np.ndarray | None, network: Network | None, constant: float | None = None):
        self.words, self.grams, self.network, self.constant = words, grams, network, constant

    def means(self, found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The mean embedding of each kind's known n-grams; their rows (one list after another, by length), and how many each kind has."""
        rows = np.stack([self.grams[found.gram_slots(n)] for n in GRAMS])
        table = self.network.p["gram"]  # its row 0 stays zero
        count = np.add.reduceat((rows > 0).sum(axis=0), found.first)
        sums = np.add.reduceat(sum(table[r] for r in rows), found.first, axis=0)
        return sums / np.maximum(1, count)[:, None].astype(np.float32), rows, count

    def vectors(self, found: Words) -> np.ndarray:
        n = len(found.kinds)
        if not n:
            return np.zeros((0, INPUTS), np.float32)
        return np.concatenate([self.network.p["word"][self.words[found.word_slots()]], self.means(found)[0], np.ones((n, 1), np.float32)], axis=1)

    def scores(self, texts: list[bytes | None], batch: int = 4096) -> np.ndarray:
        """The highest window of each text, as a probability."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        found = Words(texts)
        tables = self.network.tables(self.vectors(found))
        start, end, owner = windows(found.at)
        number = np.concatenate([found.number, np.full(WINDOW, len(found.kinds))])
        best = np.full(len(texts), -np.inf, np.float32)
        for i in range(0, len(start), batch):
            place = start[i : i + batch] + np.arange(WINDOW)[:, None]
            at = np.where(place < end[i : i + batch], number[place], len(found.kinds))
            np.maximum.at(best, owner[i : i + batch], self.network.logits(tables, at))
        return _sigmoid(best.astype(np.float64))

    def to_bytes(self) -> bytes:
        if self.constant is not None:
            return b""
        out = io.BytesIO()
        np.savez_compressed(out, words=self.words, grams=self.grams, **{"p_" + k: v for k, v in self.network.p.items()})
        return out.getvalue()

    @staticmethod
    def from_bytes(raw: bytes) -> Model:
        if not raw:
            return Model(None, None, None, 0.0)
        held, network = np.load(io.BytesIO(raw)), Network()
        network.p = {k[2:]: held[k] for k in held.files if k.startswith("p_")}
        return Model(held["words"], held["grams"], network)


def _known(texts_with: np.ndarray, least: int) -> np.ndarray:
    """A row for each slot that ``least`` texts or more hold (the most frequent, KNOWN - 1 at most), 0 for the others."""
    texts_with[0] = 0
    often = np.argsort(-texts_with, kind="stable")[: KNOWN - 1]
    often = np.sort(often[texts_with[often] >= least])
    rows = np.zeros(SLOTS, np.int32)
    rows[often] = np.arange(1, len(often) + 1)
    return rows


def _sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by row."""
    return np.stack([np.bincount(rows, weights=values[:, k], minlength=n) for k in range(values.shape[1])], axis=1).astype(np.float32)


def _places(found: Words, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some kinds, one kind after another, and where each begins."""
    size = found.size[of]
    first = np.cumsum(size) - size
    return np.repeat(found.first[of] - first, size) + np.arange(size.sum()), first


def fit(texts: list[bytes | None], labels: np.ndarray, epochs: int | None = None, seed: int = 3) -> Model:
    """Multiple-instance training: the first epochs learn from random windows of each text, the later ones from
    its highest window by the network so far, and from some other windows of clean texts. Small samples get
    more epochs, so that every one is learned from in some hundred steps."""
    labels = np.asarray(labels, np.int64)
    if not len(labels) or labels.min() == labels.max():
        return Model(None, None, None, 0.0)
    epochs = epochs or max(8, min(60, 12_800 // len(texts)))
    found = Words(texts)
    kinds = len(found.kinds)
    word_slots, gram_slots = found.word_slots(), [found.gram_slots(n) for n in GRAMS]
    with_word, with_gram = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
    for i in range(len(texts)):
        held = np.unique(found.number[found.at[i] : found.at[i + 1]])
        if len(held):
            with_word[np.unique(word_slots[held])] += 1
            places, _ = _places(found, held)
            with_gram[np.unique(np.concatenate([s[places] for s in gram_slots]))] += 1
    least = max(3, len(texts) // SHARE)
    words, grams = _known(with_word, least), _known(with_gram, least)
    model = Model(words, grams, Network(int(words.max()) + 1, int(grams.max()) + 1))
    p = model.network.p
    word_row = words[word_slots]
    start, end, owner = windows(found.at)
    number = np.concatenate([found.number, np.full(WINDOW, kinds)])
    rng = np.random.default_rng(seed)

    def numbers(which: np.ndarray) -> np.ndarray:
        place = start[which] + np.arange(WINDOW)[:, None]
        return np.where(place < end[which], number[place], kinds)

    gram_rows = np.stack([grams[g] for g in gram_slots])
    gram_count = np.maximum(1, np.add.reduceat((gram_rows > 0).sum(axis=0), found.first)).astype(np.float32)

    def current(of: np.ndarray) -> np.ndarray:
        """The input vectors of some kinds."""
        places, first = _places(found, of)
        sums = np.add.reduceat(sum(p["gram"][r[places]] for r in gram_rows), first, axis=0)
        return np.concatenate([p["word"][word_row[of]], sums / gram_count[of][:, None], np.ones((len(of), 1), np.float32)], axis=1)

    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    toxic = labels == 1
    weight = np.where(toxic, min(4.0, (~toxic).sum() / toxic.sum()), 1.0).astype(np.float32)
    warm, turn = max(2, epochs // 4), 0
    for epoch in range(epochs):
        if epoch < warm:
            chosen = rng.permutation(len(start))
            rank = np.argsort(np.argsort(owner[chosen], kind="stable"), kind="stable")
            first = np.searchsorted(owner, np.arange(len(texts)))
            chosen = chosen[rank - first[owner[chosen]] < 4]  # four random windows of each text at most
        else:
            if epoch == warm or epoch % 2:
                tables = model.network.tables(model.vectors(found))
                strength = np.concatenate([model.network.logits(tables, numbers(np.arange(i, min(i + 4096, len(start))))) for i in range(0, len(start), 4096)])
            order = np.lexsort((strength, owner))
            top = order[np.concatenate([np.flatnonzero(np.diff(owner[order])), [len(order) - 1]])]
            clean = np.flatnonzero(~toxic[owner])
            if epoch > warm + 1:  # labels may be wrong: the texts that fit worst by now are left out
                worst = np.where(toxic[owner[top]], -strength[top], strength[top])
                top = np.concatenate([t[np.argsort(worst[of], kind="stable")][: len(t) - int(TRIM[y] * len(t))] for y in (0, 1) for of in [toxic[owner[top]] == (y == 1)] for t in [top[of]]])
            chosen = rng.permutation(np.concatenate([top, rng.choice(clean, min(len(clean), len(top) // 2), replace=False)]))
        for i in range(0, len(chosen), 64):
            which = chosen[i : i + 64]
            at = numbers(which)
            there = at < kinds
            here, back = np.unique(at[there], return_inverse=True)
            if not len(here):
                continue
            local = np.full(at.shape, len(here))
            local[there] = back
            vectors = current(here)
            keep: dict = {}
            score = model.network.logits(model.network.tables(vectors), local, keep)
            y = labels[owner[which]]
            d = ((_sigmoid(score) - y) * weight[owner[which]] / len(which)).astype(np.float32)
            x = np.concatenate([vectors, np.zeros((1, INPUTS), np.float32)])[local]
            out, dx = model.network.gradients(keep, x, d)
            by_kind = _sums(back, dx[there], len(here))
            places, first = _places(found, here)
            spread = np.repeat(by_kind[:, WIDTH : 2 * WIDTH] / gram_count[here][:, None], found.size[here], axis=0)
            gram = sum(_sums(r[places], spread, len(p["gram"])) for r in gram_rows)
            word = _sums(word_row[here], by_kind[:, :WIDTH], len(p["word"]))
            gram[0] = 0
            word[0] = 0
            out |= {"word": word, "gram": gram}
            turn += 1
            rate = RATE * min(1.0, turn / 20) * (0.3 if epoch >= epochs - 3 else 1.0)
            for k, g in out.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p[k] -= (rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-6)).astype(np.float32)
    # the bias moves to where most training rows, in their natural shares, come out right
    scores = np.concatenate([model.scores(texts[a:b]) for a, b in blocks(texts, 4 << 20)])
    logit = np.log(np.clip(scores, 1e-9, 1 - 1e-9) / np.clip(1 - scores, 1e-9, 1))
    by = np.argsort(logit)
    right = np.concatenate([[0], np.cumsum(np.where(labels[by] == 1, -1, 1))])
    cut = int(np.argmax(right))
    low, high = (logit[by[cut - 1]] if cut else logit[by[0]] - 1), (logit[by[cut]] if cut < len(by) else logit[by[-1]] + 1)
    p["bias"] -= np.float32((low + high) / 2)
    return model


def sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """label, place and text to learn from, in the order of ``place``: of all rows that may be, those with the
    smallest hashes, within the bounds. What is sorted, and what reaches the driver, are sizes, not texts."""
    spark = docs.sparkSession
    order = F.xxhash64("doc_id", F.lit("toxicity")).alias("order")
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(may_learn()).select("doc_id", F.col("toxic").cast("int").alias("label"), order)
    chosen = [known.where(F.col("label") == y).orderBy("order").limit(SAMPLE_ROWS) for y in (1, 0)]
    chosen = chosen[0].unionByName(chosen[1])  # a bounded number of rows: they may be broadcast
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    text = F.when(size <= SAMPLE_BYTES, F.col("text")).alias("text")
    rows = staged(rows.select("doc_id", "label", "order", size.alias("bytes"), F.xxhash64("text").alias("hash"), text, F.monotonically_increasing_id().alias("row")), "sample")
    picked = []
    for y in (0, 1):
        used, before = 0, len(picked)
        narrow = rows.where(F.col("label") == y).select("order", "doc_id", "bytes", "hash", "row")
        found = narrow.orderBy("order", "doc_id", "bytes", "hash", "row").limit(SAMPLE_ROWS).collect()  # SAMPLE_ROWS at most
        for r in found:
            if used + r["bytes"] <= SAMPLE_BYTES:
                used += r["bytes"]
                picked.append((r["row"], len(picked)))
        if found and len(picked) == before:
            raise ValueError(f"none of the {len(found)} labelled texts with toxic = {y} is within {SAMPLE_BYTES} bytes")
    places = spark.createDataFrame(picked, "row bigint, place int")
    return rows.join(F.broadcast(places), "row").select("label", "place", "text")


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, labels = [], []
    for batch in batches:
        labels += batch.column(0).to_pylist()
        texts += batch.column(2).to_pylist()
    yield pa.RecordBatch.from_arrays([pa.array([fit(texts, np.array(labels, np.int64)).to_bytes()], pa.binary())], ["model"])


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The network, fitted to the sample by one task."""
    rows = sampled(docs, labels).repartition(1).sortWithinPartitions("place")
    made = rows.mapInArrow(released(_train), "model binary").collect()  # MODEL_BYTES at most
    return Model.from_bytes(bytes(made[0]["model"]) if made else b"")


def _scorer(model: Model, keep_text: bool):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.scores(texts) for _, _, texts in text_blocks(batch.column(batch.num_columns - 1))]
            n = batch.num_columns - (not keep_text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(np.concatenate([np.zeros(0), *scores]))], [*batch.schema.names[:n], "toxic_score"])

    return released(score)


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with toxic_score; the other columns, but for the text, pass through as they are."""
    columns = [c for c in docs.columns if c not in ("toxic_score", "toxic_text", text)]
    rows = docs.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{text}`").cast("binary").alias("toxic_text"))
    kept = docs.select(*[F.col(f"`{c}`") for c in columns]).schema
    return rows.mapInArrow(_scorer(model, False), widened(kept, "toxic_score double"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that don't score as toxic, with their columns."""
    model = trained(docs, labels)
    others = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("others")
    rows = docs.select(others, F.col("text").cast("binary").alias("raw"))
    found = rows.mapInArrow(_scorer(model, True), widened(rows.schema, "toxic_score double")).where("toxic_score < 0.5")
    return found.select(*[F.col("raw").cast("string").alias("text") if c == "text" else F.col(f"others.`{c}`") for c in docs.columns])
