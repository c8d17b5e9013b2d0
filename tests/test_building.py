"""Whole data sets, tails, levels of repetition and far-apart lines against plain versions."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from timberline.operators import augment, build, sampling
from timberline.operators.clean import masked


def apart(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    return 1 - sum((x & y).values()) / sum((x | y).values())


def test_farthest_of_all_lines(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(120)]
    lines = spark.createDataFrame(list(enumerate(texts)), "line_id bigint, content string")
    once, n = {}, Counter(texts)
    for i, t in enumerate(texts):
        once.setdefault(t, i)
    first = max(once, key=lambda t: (len(t.split()), n[t], -once[t]))
    want, left = [(once[first], None)], set(once) - {first}
    chosen = [first]
    while len(want) < 12:
        gap = {t: round(min(apart(t, c) for c in chosen), 12) for t in left}
        best = max(left, key=lambda t: (gap[t], n[t], -once[t]))
        want.append((once[best], gap[best]))
        chosen.append(best)
        left.discard(best)
    got = sampling.adaptive_sample(lines, 12, None).orderBy("rank").collect()
    assert [(r.line_id, r.gap) for r in got] == want


def test_draws_of_candidates(spark):
    lines = spark.createDataFrame([(i, f"line {i} {'x' * (i % 5)} of {i // 10}") for i in range(80)], "line_id bigint, content string")
    a, b = (sorted(map(tuple, sampling.adaptive_sample(lines.repartition(n), 6, 10).collect())) for n in (2, 5))
    assert a == b and len({r[1] for r in a}) == 6
    many = sampling.adaptive_sample(lines, 6, 1000).collect()
    assert sorted(map(tuple, many)) == sorted(map(tuple, sampling.adaptive_sample(lines, 6, None).collect()))
    assert sampling.adaptive_sample(lines.limit(3), 9).count() == 3 and sampling.adaptive_sample(lines.limit(0), 2).count() == 0


@pytest.fixture(scope="module")
def source(spark):
    """Two data sets whose raw lines have a header before their content."""
    rows, events = [], []
    for d, n in (("one", 11), ("two", 3)):
        for e in range(n):
            template = f"event {'abcdefghijk'[e]} took <*> ms" + (" at <*>" if e % 2 else "")
            events.append((d, f"E{e + 1}", template))
            for k in range(3):
                content = template.replace("<*>", str(k))
                rows.append((d, 100 * e + k, f"E{e + 1}", f"Jan 1 host: {content}", content))
    events += [("one", "E40", "no variable"), ("one", "E41", "never seen <*>"), ("two", "E9", "not found <*>")]
    rows += [("one", 9000, "E40", "Jan 1 host: no variable", "no variable"), ("two", 9001, "E9", "another text", "not found 3")]
    return spark.createDataFrame(rows, "dataset string, line_id bigint, event_id string, line string, content string"), spark.createDataFrame(events, "dataset string, event_id string, template string")


def test_events_that_can_be_built_from(source):
    got = build.chosen_events(*source).collect()
    assert sorted((r.dataset, r.event_number) for r in got) == [*(("one", k) for k in range(1, 12)), *(("two", k) for k in range(1, 4))]
    assert {r.line_id for r in got if r.dataset == "two"} == {0, 100, 200}
    assert {r.placeholder_count for r in got} == {1, 2}


def test_reports_and_lines(source):
    targets = (0.1, 0.4, 0.9)
    chosen = build.chosen_events(*source)
    report = build.level_report(chosen, targets, lines=16)
    rows = report.collect()
    assert len(rows) == 14 * 3 and len(report.columns) == 18
    order = {}
    for r in rows:
        groups = 11 if r.dataset == "one" else 3
        active, share, wanted = build.parameters(groups, r.target_score)
        counts = build.target_counts(16, wanted)
        assert (r.active, r.activation_ratio, r.value_counts) == (int(r.selection_rank <= active), share, counts)
        assert math.isclose(r.achieved_entropy_per_active_slot, build.entropy(counts)) and math.isclose(r.target_entropy_per_active_slot, wanted)
        assert (r.start_line_id, r.end_line_id) == (16 * r.selection_rank - 15, 16 * r.selection_rank)
        assert order.setdefault((r.dataset, r.selection_rank), r.event_id) == r.event_id  # one order for all levels
    lines = build.built_lines(report, chosen).collect()
    assert len(lines) == len(rows) * 16
    by = {}
    for x in lines:
        assert x.line == f"Jan 1 host: {x.content}"
        by.setdefault((x.dataset, x.target_score, x.event_id), []).append(x)
    for r in rows:
        own = sorted(by[r.dataset, r.target_score, r.event_id], key=lambda x: x.line_id)
        assert [x.line_id for x in own] == list(range(r.start_line_id, r.end_line_id + 1))
        assert sorted(Counter(x.content for x in own).values(), reverse=True) == (sorted(r.value_counts, reverse=True) if r.active else [16])


def letters(n):
    out = ""
    while True:
        out, n = "abcdefghijklmnopqrstuvwxyz"[n % 26] + out, n // 26
        if not n:
            return out


@pytest.mark.parametrize("target", [0.05, 0.5, 0.9])
def test_tails(spark, target):
    contents = {7: "a b c", 8: "a  b d e ", 1 << 40: "x"}
    rows = spark.createDataFrame(list(contents.items()), "line_id bigint, content string")
    mean = sum(len(c.split()) for c in contents.values()) / 3
    total = max(60, math.ceil(target * (mean + 1) / (1 - target)) + 80)
    varied = max(1, min(total, round(target * (mean + 1 + total))))
    for r in build.with_tails(rows, [target]).collect():
        line = r.line_id % (1 << 31)
        tail = ["dganchor", *(f"zv{letters(i)}<*>{'ab'[(line * 1103515245 + i * 12345) >> 8 & 1]}" for i in range(varied)), *(f"zf{letters(i)}" for i in range(total - varied))]
        assert r.content == " ".join([contents[r.line_id].strip(), *tail])


def test_letters(spark):
    got = spark.range(2000).select("id", build._letters(F.col("id")).alias("t")).collect()
    assert all(r.t == letters(r.id) for r in got)


def test_levels(spark):
    rows = [(i, f"user {i} is {'abc'[i % 3]}") for i in range(30)] + [(100, "alone 7")]
    levels = augment.by_level(spark.createDataFrame(rows, "line_id bigint, content string"), masked(F.col("content"), [r"\d+"]), 4).collect()
    for k in range(1, 5):
        own = [r.line_id for r in levels if r.level == k]
        assert sorted(own) == [*range(3 * k), 100]


def test_oracle_of_levels(spark):
    rows = [(i, f"job {i % 40} took {i} ms on node {'abcdefgh'[i % 8]}") for i in range(400)] + [(900, "see http://x/1"), (901, "y" * 401 + " 1")]
    shape = masked(F.col("content"), [r"\d+"])
    levels = augment.by_level(spark.createDataFrame(rows, "line_id bigint, content string"), shape, 8)
    got = augment.level_oracle(levels, sizes=(20, 60)).withColumn("a", shape).withColumn("b", masked(F.col("variant"), [r"\d+"])).collect()
    assert {r.level for r in got} == set(range(1, 9)) and all(r.a == r.b and r.variant != r.content for r in got)
    assert not any("http" in r.content or len(r.content) > 400 for r in got if r.level <= 5)
    for level in range(1, 9):
        for size in (20, 60):
            own = [r.variant for r in got if (r.level, r.size) == (level, size)]
            assert len(own) == len(set(own)) and 0.5 * size <= len(own) <= size
    # from level 6 on every shape has more than five lines: the most frequent ones are seeds
    assert {r.content for r in got if r.level == 8}


@pytest.mark.parametrize("k", [1, 3, 200])
def test_similar_examples(spark, k):
    rng = random.Random(k)
    make = lambda: " ".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(1, 8)))
    asked, examples = [make() for _ in range(40)], [(i, make()) for i in range(120)]
    once = {}
    for i, t in examples:
        once.setdefault(t, i)
    want = []
    for a in set(asked):
        like = sorted((-round(1 - apart(a, t), 6), i) for t, i in once.items() if apart(a, t) < 1)
        want += [(a, i, n, -s) for n, (s, i) in enumerate(like[:k], 1)]
    got = sampling.similar_examples(spark.createDataFrame([(a,) for a in asked], "template string"), spark.createDataFrame(examples, "line_id bigint, content string"), k)
    assert sorted(map(tuple, got.collect())) == sorted(want)
