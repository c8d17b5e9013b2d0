"""Canopies of a bucket, and links within and across components."""

from __future__ import annotations

import random

import numpy as np
import pytest

minhash = pytest.importorskip("timberline.llm.minhash")


def members(*signs):
    out = np.zeros(len(signs), minhash._SIGNED)
    out["band"], out["doc"], out["sign"] = 7, range(1, len(signs) + 1), signs
    return out


def test_members_join_every_family():
    # 1 agrees with 2 in 60 places and 2 with 3 in 104; 1 and 3 agree in 36 only
    one = np.zeros(minhash.HASHES, np.uint8)
    two = one.copy()
    two[60:] = 1
    three = two.copy()
    three[:24] = 2
    heads, a, b, agree = minhash._canopies(members(one, two, three))
    assert heads["doc"].tolist() == [1, 2]
    assert sorted(zip(a.tolist(), b.tolist(), agree.tolist())) == [(1, 2, 60), (2, 1, 60), (3, 2, 104)]


def test_families_meet_in_a_later_head():
    rng = np.random.default_rng(1)
    left, right = (rng.integers(0, 256, minhash.HASHES, dtype=np.uint8) for _ in range(2))
    middle = np.concatenate([left[:64], right[64:]])
    heads, a, b, _ = minhash._canopies(members(left, left, right, right, middle))
    assert heads["doc"].tolist() == [1, 3, 5]
    label = {k: k for k in range(1, 6)}
    for _ in range(5):
        for x, y in zip(a.tolist(), b.tolist()):
            label[x] = label[y] = min(label[x], label[y])
    assert set(label.values()) == {1}


def test_a_head_has_one_edge_for_each_member():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 256, minhash.HASHES, dtype=np.uint8)
    signs = np.tile(base, (400, 1))
    for row in signs:
        row[rng.permutation(minhash.HASHES)[: rng.integers(0, 50)]] = rng.integers(0, 256)
    _, a, _, _ = minhash._canopies(members(*signs))
    assert len(a) < 2 * 400


def near(texts, width=2, percent=80):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return [root(x) for x in range(len(texts))]


def edited(rng, words, n):
    copy = list(words)
    for at in rng.sample(range(len(copy)), n):
        copy[at] = f"e{rng.randrange(10**9)}"
    return copy


def test_recall_at_the_threshold(spark, monkeypatch):
    """Families whose copies are near 0.8: some are linked with the first, others with one another only."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 60)
    monkeypatch.setattr(minhash, "SIGN_ROWS", (20, 2000))
    rng = random.Random(11)
    rows = []
    for k in range(6):
        base = [f"f{k}x{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(40):
            base = base if rng.random() < 0.6 else edited(rng, base, 5)  # families drift
            rows.append(" ".join(edited(rng, base, rng.randrange(12))))
    rows += [" ".join(edited(rng, rows[0].split(), 40)) for _ in range(30)]
    rng.shuffle(rows)
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(table).collect()}
    want = near(rows)
    assert [got[i] for i in range(len(rows))] == want
    assert len(set(want)) > 6


def test_one_id_with_two_texts(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    table = spark.createDataFrame([(1, one), (1, two), (2, one + " z"), (3, two + " z"), (3, two + " z")], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(table).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False)]


def test_components_that_do_not_end(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "a bigint, b bigint")
    with pytest.raises(RuntimeError, match="not complete"):
        minhash.components(edges, rounds=1)
