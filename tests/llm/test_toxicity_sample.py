"""What the toxicity model learns from."""

from __future__ import annotations

import numpy as np
import pytest

toxicity = pytest.importorskip("timberline.llm.toxicity")


@pytest.fixture
def small_bytes(monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 2000)


def tables(spark, texts):
    """``texts``: (label, text); ids are such that labels may be learned from."""
    import zlib

    ids = [i for i in range(5 * len(texts) + 50) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, t) for i, (_, t) in zip(ids, texts)]
    labels = [(i, 1, y) for i, (y, _) in zip(ids, texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def sample(docs, labels):
    rows = toxicity.sampled(docs, labels).orderBy("place").collect()
    return [r.text for r in rows], np.array([r.label for r in rows])


def test_large_texts_are_left_out(spark, small_bytes):
    # of either label 12 short texts and 12 that never fit: whichever comes first by hash, all short ones are learned from
    texts = [(y, ("x" * 100 if k % 2 else "y" * 2001)) for k in range(24) for y in (0, 1)]
    got, labels = sample(*tables(spark, texts))
    assert sorted(labels.tolist()) == [0] * 12 + [1] * 12
    assert {len(t) for t in got} == {100}


def test_budgets_are_apart(spark, small_bytes):
    texts = [(0, "x" * 100)] * 40 + [(1, "y" * 400)] * 5
    _, labels = sample(*tables(spark, texts))
    assert np.bincount(labels).tolist() == [20, 5]


def test_a_label_without_rows_is_an_error(spark, small_bytes):
    with pytest.raises(ValueError, match="toxic = 1"):
        sample(*tables(spark, [(0, "x")] * 5 + [(1, "y" * 3000)] * 3))


def test_copies_do_not_take_the_rows_of_the_other_label(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_ROWS", 4)
    docs, labels = tables(spark, [(0, "clean words")] + [(1, f"bad words {i}") for i in range(4)])
    clean = docs.where("text = 'clean words'")
    for _ in range(4):
        clean = clean.unionByName(clean)
    _, found = sample(docs.unionByName(clean), labels)
    assert np.bincount(found).tolist() == [4, 4]


def test_model_bytes(spark):
    texts = [(k % 2, f"plain words here {'vileword' if k % 2 else 'nothing'} more of them {k}") for k in range(120)]
    docs, labels = tables(spark, texts)
    model = toxicity.trained(docs, labels)
    raw = model.to_bytes()
    assert len(raw) <= toxicity.MODEL_BYTES
    assert [model.scores([t]) for t in (b"a vileword b", b"nothing", None)] == [toxicity.Model.from_bytes(raw).scores([t]) for t in (b"a vileword b", b"nothing", None)]
    assert model.scores([b"a vileword b"])[0] > 0.5 > model.scores([b"plain words here nothing more"])[0]


def test_stage_keeps_rows_whole(spark):
    texts = [(k % 2, f"plain words here {'vileword' if k % 2 else 'nothing'} more of them {k}") for k in range(120)]
    docs, labels = tables(spark, texts)
    docs = docs.selectExpr("doc_id", "text", "'x' as raw", "named_struct('_', 1) as others", "1.5 as toxic_score")
    got = toxicity.keep_clean(docs, labels)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    assert sorted(r.text for r in got.collect()) == sorted(t for y, t in texts if not y)
    assert toxicity.keep_clean(docs.limit(0), labels).count() == 0


def plain_score(model, text):
    """The same network by plain loops, word by word, window by window."""
    import re

    from timberline.llm.words import _TABLE, mixed

    p, hidden, width = model.network.p, toxicity.HIDDEN, toxicity.WIDTH
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or b"").lower())

    def vector(w):
        found = toxicity.Words([w])
        word = p["word"][model.words[toxicity._slots(mixed(found.kinds))[0]]]
        marked, rows = b"<" + w + b">", []
        for n in toxicity.GRAMS:
            for i in range(len(marked) - n + 1):
                h = n
                for b in marked[i : i + n]:
                    h = (h * 0x9E3779B97F4A7C15 + int(_TABLE[b])) % (1 << 64)
                rows.append(model.grams[toxicity._slots(mixed(np.array([h], np.uint64)))[0]])
        rows = [r for r in rows if r]
        mean = sum((p["gram"][r] for r in rows), np.zeros(width)) / max(1, len(rows))
        return np.concatenate([word, mean, [1.0]])

    def sigma(x):
        return 1 / (1 + np.exp(-x))

    def run(vectors, side):
        h, out = np.zeros(hidden), []
        for x in vectors:
            given = x @ p["w" + side] + p["c" + side]
            z, r = sigma(given[:hidden] + h @ p["u" + side][:, :hidden]), sigma(given[hidden : 2 * hidden] + h @ p["u" + side][:, hidden : 2 * hidden])
            new = np.tanh(given[2 * hidden :] + (r * h) @ p["u" + side][:, 2 * hidden :])
            h = (1 - z) * h + z * new
            out.append(h)
        return out

    best, at = -np.inf, 0
    while True:
        part = [vector(w) for w in words[at : at + toxicity.WINDOW]]
        empty = [np.zeros(toxicity.INPUTS)] * (toxicity.WINDOW - len(part))
        forward, backward = run(part + empty, "f"), run(empty + part[::-1], "b")[::-1]
        states = [np.concatenate(s) for s in zip(forward, backward)]
        e = np.array([s @ p["att"] if k < len(part) else -30 for k, s in enumerate(states)])
        a = np.exp(e - e.max())
        best = max(best, (a / a.sum()) @ np.array(states) @ p["out"] + p["bias"][0])
        if at + toxicity.WINDOW >= len(words):
            return sigma(best)
        at += toxicity.STEP


def test_scores_against_plain_loops():
    texts = [f"plain words here {'vileword' if k % 2 else 'nothing'} more of them {k}".encode() for k in range(60)]
    model = toxicity.fit(texts, np.arange(60) % 2, epochs=3)
    hard = [None, b"", b" \n", b"vileword", "Ein Wort öfter, VILEWORD!".encode(), b"plain words " * 40 + b"vileword" + b" more" * 50, b"x" * 3000, b"words here more of them nothing " * 9]
    for text, score in zip(hard, model.scores(hard)):
        assert abs(plain_score(model, text) - score) < 1e-4, text


def test_two_fits_are_the_same():
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(40)]
    labels = np.array([i % 4 == 0 for i in range(60)], np.int64)
    texts = [" ".join([*rng.choice(words, 30), *(["nasty", "vile"] * 2 if y else [])]).encode() for y in labels]
    a, b = (toxicity.fit(texts, labels, epochs=4) for _ in range(2))
    assert (a.scores(texts) == b.scores(texts)).all()
    again = toxicity.Model.from_bytes(a.to_bytes())
    assert (again.scores([*texts, None, b""]) == b.scores([*texts, None, b""])).all()
