"""Leaves, proofs and roots against a plain tree."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

manifest = pytest.importorskip("timberline.llm.manifest")

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, small=False):
    doc, text, lang, source, chars = row
    if small and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, chars, text)))


def tree(leaves):
    found = [leaves]
    while len(found[-1]) > 1:
        found.append([digest("".join(found[-1][i : i + 8])) for i in range(0, len(found[-1]), 8)])
    return found


def path(found, i):
    out = []
    for nodes in found[:-1]:
        first = i // 8 * 8
        out.append((nodes[first:i], nodes[i + 1 : first + 8]))
        i //= 8
    return out


def plain(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    trees = {g: tree([leaf(r) for r in own]) for g, own in groups.items()}
    top = tree([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            steps = path(trees[g], i) + path(top, k)
            now = leaf(r, small=r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
            for a, b in steps:
                now = digest("".join(a) + now + "".join(b))
            proof = digest("".join("".join(a + b) for a, b in steps))
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(out, key=repr)


def proved(spark, rows, **more):
    found = manifest.manifest(spark.createDataFrame(rows, SCHEMA), **more)
    return sorted((tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def corpus(n, langs, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice(["Some Text", "small text", "Ünïcode Ä", "", None]) and f"{rng.choice(['Text', 'text', 'É'])} {i}", rng.choice(langs), rng.choice([None, "web", "quelle"]), rng.choice([None, i])) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 8, 9, 65, 130])
def test_sizes(spark, n):
    rows = corpus(n, ["en", "de", None])
    assert proved(spark, rows) == plain(rows)


def test_blocks_of_several_levels(spark):
    # blocks of 8 leaves, so that 600 leaves need four tables of blocks
    rows = corpus(600, ["en"] * 30 + ["de", "fr", None, ""]) + corpus(90, [f"l{i}" for i in range(40)], seed=2)
    assert proved(spark, rows, depth=1) == plain(rows)


def test_cases(spark):
    rows = [(3, "A", "en", "s", 1), (3, "A", "en", "s", 1), (3, "B", "en", "s", 1), (None, "Ab", "en", None, None), (None, None, None, None, None), (5, None, "", "", 0)]
    assert proved(spark, rows) == plain(rows)
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    more = spark.createDataFrame([(*r, "x", b"y") for r in rows], SCHEMA + ", root string, leaf binary")
    assert manifest.manifest(more).count() == len(rows)


def test_levels():
    assert [manifest.levels(n) for n in (0, 1, 2, 8, 9, 64, 65, 4096, 4097)] == [0, 0, 1, 1, 2, 2, 3, 4, 5]
