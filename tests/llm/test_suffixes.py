"""Repeated byte strings, suffix arrays and common prefixes against plain versions."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

suffixes = pytest.importorskip("timberline.llm.suffixes")
induced = pytest.importorskip("timberline.llm.induced")

SCHEMA = "doc_id bigint, text string"


def plain(rows, window):
    texts = [(t or "").encode() for _, t in rows]
    often = Counter(t[k : k + window] for t in texts for k in range(len(t) - window + 1))
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for k in range(len(t) - window + 1):
            if often[t[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((doc, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def marked(spark, rows, window, **more):
    found = suffixes.mark(spark.createDataFrame(rows, SCHEMA), window, **more)
    return sorted((tuple(r) for r in found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


@given(st.lists(st.integers(1, 4), max_size=80), st.integers(1, 3))
@settings(max_examples=200, deadline=None)
def test_suffix_array_and_prefixes(values, top):
    text = np.array([min(v, top) for v in values] + [0], np.int16)
    plain_text = text.tolist()
    order = sorted(range(len(plain_text)), key=lambda i: plain_text[i:])
    array = induced.suffix_array(text)
    assert array.tolist() == order

    def common(i, j):
        k = 0
        while max(i, j) + k < len(plain_text) and plain_text[i + k] == plain_text[j + k]:
            k += 1
        return k

    before, after = induced.common_prefixes(text, array)
    for rank, i in enumerate(order):
        assert before[i] == (common(i, order[rank - 1]) if rank else 0)
        assert after[i] == (common(i, order[rank + 1]) if rank + 1 < len(order) else 0)


def test_suffix_array_of_long_runs_and_copies():
    rng = random.Random(3)
    for text in ([7] * 5000, [1, 2] * 2000, ([rng.randrange(2, 60) for _ in range(700)] + [1]) * 6):
        array = induced.suffix_array(np.array([*text, 0], np.int16))
        whole = [*text, 0]
        assert sorted(array.tolist()) == list(range(len(whole)))
        assert all(whole[a : a + 5000] < whole[b : b + 5000] for a, b in zip(array[:-1].tolist(), array[1:].tolist(), strict=True))


@pytest.mark.parametrize("hot", [4096, 2])
def test_against_plain_version(spark, hot):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(2, 9)))
    shared = ["".join(word() for _ in range(12)) for _ in range(4)]
    line = " every text holds this line "
    rows = [(i, line.join(rng.choice([rng.choice(shared), "".join(word() for _ in range(9))]) for _ in range(5))) for i in range(60)]
    rows += [(100, rows[0][1]), (100, rows[1][1]), (101, "ab" * 300), (102, "x" * 900), (103, "y" * 40), (104, None), (105, ""), (None, rows[2][1]), (7, rows[7][1])]
    assert marked(spark, rows, 40, hot=hot) == plain(rows, 40)


def test_windows_that_start_or_end_a_text(spark):
    a, b = "".join(chr(97 + i % 26) + str(i) for i in range(60)), "".join(chr(65 + i % 26) + str(i) for i in range(60))
    rows = [(1, a), (2, b + a[:40]), (3, a[-40:] + b[:39]), (4, a[:20] + a[21:60])]
    assert marked(spark, rows, 40) == plain(rows, 40)


def test_long_texts_are_hashed_in_segments(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 500)
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefghijklmnop") for _ in range(4000))
    held = [(i, o, p) for owner, offset, parts in suffixes._segments([text.encode(), None, text[:39].encode()], 40) for i, o, p in zip(owner, offset, parts, strict=True)]
    starts = [o + k for _, o, p in held for k in range(len(p) - 39)]
    assert starts == list(range(4000 - 39)) and {i for i, _, _ in held} == {0}


def test_kept_text_empty_table_and_other_columns(spark):
    rows = [(1, "z" * 30 + "the same forty bytes stand in two of these texts"), (2, "the same forty bytes stand in two of these texts" + "q")]
    docs = spark.createDataFrame([(*r, b"x", 1) for r in rows], SCHEMA + ", kept binary, version int")
    got = {r.doc_id: (bytes(r.kept), r.n_spans) for r in suffixes.mark(docs, 40, text=True).collect()}
    assert got == {1: (b"z" * 30, 1), 2: (b"q", 1)}
    assert suffixes.mark(spark.createDataFrame([], SCHEMA), 40).count() == 0
