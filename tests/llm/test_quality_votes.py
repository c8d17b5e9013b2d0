"""Verdicts against a plain expectation-maximisation over documents, and against labels."""

from __future__ import annotations

import math
import re

import pytest

quality = pytest.importorskip("timberline.llm.quality")

SF = "/root/testdata/sf0.01"

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÉÈÊËÍÎÏÑÓÔÖÚÛÜ"


def plain_votes(text):
    """Base verdict and the eight votes of a text, by their own counts."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, chars = len(w), sum(map(len, w))
    runs = {}
    for i in range(n - 4):
        runs.setdefault(tuple(w[i : i + 5]), []).append(i)
    again = {k for at in runs.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    failed = n < 10 or 100 * len(again) > 20 * n
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    ended = sum(x.rstrip(" \t\n\x0b\x0c\r")[-1] in '.!?"' for x in lines)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    capitals, digits = sum(c in _CAPITALS for c in "".join(w)), len(re.findall("[0-9]", text or ""))
    longest = max(map(len, w), default=0)

    def vote(against, good):
        return 0 if not n else -1 if against else 1 if good else 0

    return failed, (
        vote(symbols / max(n, 1) > 0.2, symbols * 50 <= n),
        vote(10 * chars < 44 * n or 10 * chars > 63 * n, 46 * n <= 10 * chars <= 58 * n),
        vote(20 * ended < 19 * len(lines), ended == len(lines)),
        vote(100 * capitals < chars or 100 * capitals > 3 * chars, 12 * chars <= 1000 * capitals <= 25 * chars),
        vote(100 * digits > chars, digits == 0),
        vote(len(set(lines)) < len(lines), len(lines) >= 4),
        vote(n < 50, n >= 100),
        vote(longest > 30, longest <= 20),
    )


def plain_posteriors(votes, fitted):
    """Expectation-maximisation, document by document; the posterior of each of ``votes`` under the model of ``fitted``."""
    rules = range(8)
    share, rates = 0.8, [[0.02, 0.3] for _ in rules]

    def posterior(v):
        good, bad = share, 1 - share
        for j in rules:
            if v[j]:
                good *= rates[j][0] if v[j] < 0 else 1 - rates[j][0]
                bad *= rates[j][1] if v[j] < 0 else 1 - rates[j][1]
        return good / (good + bad)

    for _ in range(200):
        p = [posterior(v) for v in fitted]
        new = (sum(p) + 1) / (len(fitted) + 2)
        for j in rules:
            for y in (0, 1):
                weight = [x if y == 0 else 1 - x for x in p]
                cast = sum(x for x, v in zip(weight, fitted, strict=True) if v[j])
                rates[j][y] = (0.5 + sum(x for x, v in zip(weight, fitted, strict=True) if v[j] < 0)) / (1 + cast)
        moved, share = abs(new - share), new
        if moved < 1e-9:
            break
    return [posterior(v) for v in votes]


def test_verdicts_by_document_and_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    held = {r.doc_id: plain_votes(r.text) for r in docs.collect()}
    want = dict(zip(held, plain_posteriors([v for _, v in held.values()], [v for failed, v in held.values() if not failed]), strict=True))
    got = {r.doc_id: r for r in quality.score(docs).collect()}
    names = [f"vote_{name}" for name, _, _ in quality.RULES]
    assert set(got) == set(held)
    for doc, r in got.items():
        assert tuple(r[c] for c in names) == held[doc][1], doc
        assert math.isclose(r.posterior, want[doc], rel_tol=1e-6, abs_tol=1e-9)
        assert r.kept == (not held[doc][0] and want[doc] >= 0.5)
    passed = [r for r in got.values() if not r.base_failed]
    for c in names:  # each rule has something to say
        assert sum(r[c] < 0 for r in passed) >= 0.01 * len(passed)
    assert any(r.kept and min(r[c] for c in names) < 0 for r in passed)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    told = [(r.kept, labels[r.doc_id] == 1) for r in passed if r.doc_id in labels]
    assert sum(a == b for a, b in told) >= 0.97 * len(told)


def test_rules_without_weight_refuse_nothing():
    """A rule that votes against good and bad documents alike says nothing; two that agree with a third one outweigh its silence."""
    n = len(quality.RULES)
    good, noisy = (1,) * n, (*(1,) * 6, -1, -1)
    bad, silent = (-1, -1, -1, *(1,) * (n - 3)), (0, -1, -1, *(1,) * (n - 3))
    model = quality.estimate([(good, 900), (noisy, 30), (bad, 90), ((-1, -1, -1, 1, 1, 1, -1, -1), 3), (silent, 4), ((0,) * n, 10)])
    assert quality.posterior_of(model, noisy) > 0.9 and quality.posterior_of(model, bad) < 0.1 and quality.posterior_of(model, silent) < 0.1
