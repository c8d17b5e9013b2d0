"""Order-dependent and iterative miners against plain versions, and published numbers."""

from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timberline.operators import build, cache, diversity, extract, miners, online, sampling
from timberline.operators.clean import corrected, header_pattern
from timberline.operators.tokens import message_split
from timberline.settings import SETTINGS

WORD = re.compile(r"\S+=|\S+")


def fixpoint(texts: list[str], threshold: float) -> dict[str, str]:
    """Anchor mining over all lengths at once, pass by pass."""
    held, out = {t: {t} for t in texts}, {}
    while held:
        split = {t: WORD.findall(t) for t in held}
        counts: dict = {}
        for w in split.values():
            for k, x in enumerate(w):
                if x != "<*>":
                    counts[len(w), k, x] = counts.get((len(w), k, x), 0) + 1
        low, after = min(counts.values(), default=0), {}
        for t, origins in held.items():
            w = split[t]
            new = ["<*>" if x == "<*>" or counts[len(w), k, x] == low else x for k, x in enumerate(w)]
            if new.count("<*>") / len(new) > threshold:
                out.update(dict.fromkeys(origins, t))
            else:
                after.setdefault(" ".join(new), set()).update(origins)
        held = after
    return out


def test_anchor_fixpoint(spark):
    rng = random.Random(1)
    rows, case = [], 0
    for case in range(12):
        for k in range(rng.randrange(1, 14)):
            rows.append((case, k, " ".join(rng.choice("abcd") + rng.choice(["", "1", "="]) for _ in range(rng.randrange(1, 6)))))
    for threshold in (0.3, 0.66):
        for c in range(case + 1):
            mine = [(k, t) for x, k, t in rows if x == c]
            want = fixpoint([t for _, t in mine], threshold)
            lines = spark.createDataFrame(mine, "line_id bigint, content string")
            got = miners.by_anchors(lines, threshold=threshold, clean=False).collect()
            assert {r.line_id: r.template for r in got} == {k: want[t] for k, t in mine}
        rows = rows[: len(rows) // 2]
        case = rows[-1][0]


def test_parse_tree():
    tree = online.ParseTree(depth=4, similarity=0.5)
    assert [tree.add(m.split()) for m in ("a b c", "a b d", "x1 b c", "x2 b c", "a q r")] == [0, 0, 1, 1, 2]
    assert tree.templates[0] == ["a", "b", "<*>"] and tree.templates[1] == ["<*>", "b", "c"]
    short = online.ParseTree(depth=6)
    assert [short.add(["one"]), short.add(["one"])] == [0, 1]  # never stored
    wide = online.ParseTree(depth=4, similarity=0.9, children=3)
    for k, w in enumerate("abcd"):
        assert wide.add([w, "z"]) == k
    assert len(wide.branches[()]) == 3


def test_drain_and_spell(spark):
    lines = [f"user {n} logged in from host{n % 3}" for n in range(30)] + [f"disk {n} is full" for n in range(10)]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id bigint, content string")
    got = {r.line_id: r.template for r in online.drain(df).collect()}
    assert got[0] == "user <*> logged in from <*>" and got[35] == "disk <*> is full"
    got = {r.line_id: r.template for r in online.spell(df, tau=0.5).collect()}
    assert got[35] == "disk <*> is full" and len(set(got.values())) == 2


@given(st.lists(st.sampled_from("abc"), max_size=7), st.lists(st.sampled_from("abc"), max_size=7))
@settings(max_examples=80, deadline=None)
def test_common(a, b):
    found = online.common(a, b)
    for whole in (a, b):
        rest = iter(whole)
        assert all(x in rest for x in found)
    best = 0
    for mask in range(1 << len(a)):
        part, rest = [x for i, x in enumerate(a) if mask >> i & 1], iter(b)
        if all(x in rest for x in part):
            best = max(best, len(part))
    assert len(found) == best


def test_published_diversity(spark):
    rows = [
        ("HDFS", 14, 4, [43, 2, 2, 2, 2, 2, 2, 2, 2, 1, 1, 1, 1, 1], 0.3507047280, 0.1002013509),
        ("HDFS", 14, 10, [10, *[3] * 16, 2, 2, 2], 0.6997461433, 0.4998186738),
        ("Apache", 6, 4, [16, *[2] * 16, *[1] * 16], 0.75, 0.5),
        ("Proxifier", 8, 6, [4] * 16, 0.6666666667, 0.5),
        ("Zookeeper", 38, 12, [35, 8, 7, 7, 7], 0.3164600027, 0.0999347377),
    ]
    report = []
    for k, (name, groups, active, counts, slot, _) in enumerate(rows):
        assert build.entropy(counts) == pytest.approx(slot, abs=1e-10)
        report += [(f"{name}{k}", int(g < active), 64, 1, counts if g < active else [64]) for g in range(groups)]
    df = spark.createDataFrame(report, "dataset string, active int, line_budget int, placeholder_count int, value_counts array<bigint>")
    got = {r.dataset: r.ground_truth_ld for r in diversity.report_diversity(df).collect()}
    for k, (name, *_, ld) in enumerate(rows):
        assert got[f"{name}{k}"] == pytest.approx(ld, abs=1e-9)


def test_construction():
    assert build.parameters(14, 0.1)[0] == 4 and build.parameters(0, 0.5) == (0, 0.0, 0.0)
    counts = build.target_counts(64, build.parameters(14, 0.1)[2])
    assert sum(counts) == 64 and counts[0] == 43
    order = build.active_order(list("abcdef"), 7, "HDFS")
    assert sorted(order) == list("abcdef") and order == build.active_order(list("abcdef"), 7, "HDFS")


def test_header_patterns():
    assert len(SETTINGS) == 16
    names, pattern = header_pattern(SETTINGS["Linux"].log_format)
    found = re.match(pattern, "Jun 14 15:16:01 combo sshd(pam_unix)[19939]: authentication failure; x=1")
    assert dict(zip(names, found.groups(), strict=True))["Content"] == "authentication failure; x=1"


def test_message_split(spark):
    def brute(text: str) -> list[str]:
        marks = "!\"#$%&'()+,-/:;=?@.[\\]^_`{|}~"
        parts = [p for p in re.split("([" + re.escape(marks) + r"\s]+)", text) if p]
        out: list[str] = []
        for p in parts:
            t = "<*>" if "<*>" in p or p == "*" else "".join(c for c in p if c in "=|()" or (c not in marks and c != " ")).strip()
            if t:
                out.append(t)
        return [t for i, t in enumerate(out) if not (t == "<*>" and i and out[i - 1] == "<*>")]

    rng = random.Random(6)
    rows = ["a=b, <*>:<*> (x)|y [z]", "", "*", "<*> <*>", "a  \t b"] + ["".join(rng.choice("ab<*> =(|),.:-_[]") for _ in range(rng.randrange(25))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = {r.i: r.k for r in df.select("i", message_split(df.t).alias("k")).collect()}
    assert all(got[i] == brute(t) for i, t in enumerate(rows))


def test_corrected_templates(spark):
    rows = {
        "a  b": "a b",
        "took 12 ms": "took <*> ms",
        "id<*>x done": "<*> done",
        "<*>.<*>.<*> up": "<*> up",
        "at <*>:<*> now": "at <*> now",
        "job #<*># end": "job <*> end",
        "path <*>/<*> end": "path <*> end",
        'say "<*>" end': "say <*> end",
    }
    df = spark.createDataFrame([(k,) for k in rows], "t string")
    assert {r.t: r.c for r in df.select("t", corrected(df.t).alias("c")).collect()} == rows


def test_parameters():
    assert extract.values("user 7 from 10.0.0.1", "user <*> from <*>") == ["7", "10.0.0.1"]
    assert extract.values("a   b 5", "a b <*>") == ["5"]
    assert extract.values("x", "x") == [] and extract.values(None, None) == []


def test_permutation(spark):
    lines = [(i, f"job {i % 4} of {'abc'[i % 3]} ended, code {i}") for i in range(60)]
    a = spark.createDataFrame(lines, "line_id bigint, content string")
    b = a.orderBy(a.line_id.desc())
    assert sorted(map(tuple, miners.logram(a).collect())) == sorted(map(tuple, miners.logram(b).collect()))
    assert sorted(map(tuple, miners.by_anchors(a).collect())) == sorted(map(tuple, miners.by_anchors(b).collect()))


def test_merged_numbers(spark):
    rows = spark.createDataFrame([(1, "A", [7, 3]), (2, "b", [1]), (3, "a", [5]), (4, None, [2])], "line_id bigint, content string, line_ids array<bigint>")
    got = miners.merged_numbers(rows, F.lower("content")).orderBy("line_id").collect()
    assert [(r.text, r.place, r.line_ids) for r in got] == [("a", 1, [7, 3]), ("b", 2, [1]), ("a", 1, [5]), (None, 4, [2])]


def test_template_cache(spark):
    c = cache.TemplateCache()
    rules = cache.Rules()
    assert c.number("user 7 logged in", rules) == 0 and c.templates[0] == "user <*> logged in"
    assert c.number("user alpha beta logged in", rules) == 0  # a wildcard takes a run
    assert c.number("user 7 logged out", rules) == 1
    assert c.number("user", rules) != 0
    assert c.find(cache.split("nothing like it")) == (None, [])
    assert c.add("", []) == -1 and c.add("<*>", []) == -1
    merged = cache.TemplateCache()
    first = merged.add("a b c d e f", [])
    assert merged.add("a b c d e g", [first]) == first and merged.templates[first] == "a b c d e <*>"
    df = spark.createDataFrame([(i, f"job {i} ended after {i * 3} ms") for i in range(9)], "line_id bigint, content string")
    assert {r.template for r in cache.cached(df).collect()} == {"job <*> ended after <*> ms"}


def test_normalised_anchors(spark):
    lines = [(i, f"block blk_{i} served to 10.0.0.{i}") for i in range(8)] + [(20 + i, f"session {'ab'[i % 2]}{'ab'[i % 2]}alpha closed") for i in range(4)]
    df = spark.createDataFrame(lines, "line_id bigint, content string")
    extra = spark.createDataFrame([(-100001, "block blk_99 served to 10.0.0.99")], "line_id bigint, content string")
    got = {r.line_id: r.template for r in miners.by_normalised_anchors(df, threshold=0.6, variants=extra).collect()}
    assert set(got) == {k for k, _ in lines}
    assert got[0] == "block <*> served to <*>" and got[20] == "session <*> closed"
