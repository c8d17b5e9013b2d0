"""Answers of a template source, tables kept by version, and logs read in parts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from timberline.operators import answers, augment, cache
from timberline.sources.versions import Versions


def test_templates_in_answers(spark):
    cases = [
        ("Sure.\nLog template: `a {x} b`\nmore `c`", "a {x} b"),
        ("first `one`\nsecond `two`", "one"),
        ("Log template: \"quoted {x}\"", "quoted {x}"),
        ("no mark at all", None),
        ("`only one tick", None),
        ("a line\n`", None),
        ("``", None),
        ("Log template: nothing\n`ticked`", None),
        ('"quotes without a name"', None),
        ("`a ` b ` c`", "a ` b ` c"),
        (None, None),
        ("", None),
    ]
    rows = spark.createDataFrame(list(enumerate(a for a, _ in cases)), "k int, answer string")
    got = {r.k: r.t for r in rows.select("k", answers.answered(F.col("answer")).alias("t")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}


def plain_fits(template, tokens):
    """The trie's walk, for a trie of one template."""
    held = cache.TemplateCache()
    held.templates.append("x")
    node = held.root
    for t in template:
        node = node.setdefault(t, {})
    node[None] = 0
    return held.find(tokens)[0] is not None


def test_fits_as_the_cache_does(spark):
    rng = random.Random(2)
    cases = []
    for _ in range(600):
        template = [rng.choice(["a", "b", "c", "<*>"]) for _ in range(rng.randrange(1, 6))]
        template = [t for i, t in enumerate(template) if not (t == "<*>" and i and template[i - 1] == "<*>")]
        cases.append((template, [rng.choice("abc") for _ in range(rng.randrange(0, 7))]))
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(cases)], "k int, template array<string>, tokens array<string>")
    got = {r.k: r.ok for r in rows.select("k", answers.fits(F.col("template"), F.col("tokens")).alias("ok")).collect()}
    wrong = [(a, b, got[k]) for k, (a, b) in enumerate(cases) if got[k] != plain_fits(a, b)]
    assert not wrong, wrong[:5]
    assert 50 < sum(got.values()) < 550


def test_cache_tokens(spark):
    texts = ["user 7 (x=1) at /a/b", "a <*>:<*> b", "a, <*> <*> b*", "* - |", "x.y=z|"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {r.k: r.w for r in rows.select("k", answers.cache_tokens(F.col("t")).alias("w")).collect()}
    assert got == {k: cache.split(t) for k, t in enumerate(texts)}


def test_sources(spark):
    given = {
        "user 7 logged in": "Log template: `user {id} logged in`",
        "user 8 logged in": "I can't tell",
        "user 9 logged in": "Log template: `{all} - {of}: {it}`",
        "user 4 logged in": "Log template: `user {id} logged out`",
        "started": "Log template: `{never} asked`",
        "17 18": "Log template: `{a} {b}`",
    }
    messages = spark.createDataFrame([(i, m) for i, m in enumerate([*given, "not asked 5", "user 7 logged in"])], "line_id bigint, content string")
    said = spark.createDataFrame(list(given.items()), "message string, answer string")
    got = {r.content: (r.template, r.source) for r in answers.templates(messages, said).collect()}
    assert got == {
        "user 7 logged in": ("user <*> logged in", "answer"),
        "user 8 logged in": ("user <*> logged in", "no template"),
        "user 9 logged in": ("user <*> logged in", "too general"),
        "user 4 logged in": ("user <*> logged in", "no match"),
        "started": ("started", "one word"),
        "17 18": (None, "too general"),
        "not asked 5": ("not asked <*>", "no template"),
    }


class Counting:
    """Answers, and keeps what it was asked."""

    def __init__(self):
        self.asked = []

    def answers(self, messages):
        self.asked.append(sorted(r.message for r in messages.collect()))
        if any("fail" in m for m in self.asked[-1]):
            raise OSError("no answer")
        return messages.select("message", F.concat(F.lit("`"), "message", F.lit("`")).alias("answer"))


def test_asked_once(spark, tmp_path):
    source, path = Counting(), f"file://{tmp_path}/answers"
    ask = lambda *texts: sorted(r.message for r in answers.asked(source, spark.createDataFrame([(t,) for t in texts], "message string"), path).collect())
    assert ask("a b", "c d", "a b", "single") == ["a b", "c d"]
    assert ask("a b", "e f") == ["a b", "e f"]
    with pytest.raises(OSError, match="no answer"):
        ask("g h", "fail here")
    assert ask("a b", "c d") == ["a b", "c d"]
    assert source.asked == [["a b", "c d"], ["e f"], ["fail here", "g h"]]
    assert Versions(spark, path).read("answers").count() == 3


def test_versions(spark, tmp_path):
    kept = Versions(spark, f"file://{tmp_path}/v")
    assert kept.latest() == 0 and kept.read("t") is None
    assert kept.commit({"t": spark.range(3)}, 0) == 1
    spark.range(9).write.parquet(f"{kept.path}/2-broken/t")  # a run that failed before its marker
    assert kept.latest() == 1 and kept.read("t").count() == 3
    assert kept.commit({"t": spark.range(5)}, 1) == 2 and kept.read("t").count() == 5 and kept.read("t", 1).count() == 3
    with pytest.raises(RuntimeError, match="another run"):
        kept.commit({"t": spark.range(1)}, 1)
    assert kept.read("t").count() == 5


def test_a_log_in_parts_is_the_log_at_once(spark, tmp_path):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "up", "down"]
    rows = [("ab"[i % 2], i, " ".join(rng.choice(words) for _ in range(5)) + rng.choice([f" took {i} ms", " ended", ""])) for i in range(240)]
    lines = spark.createDataFrame(rows, "log string, line_id bigint, content string")
    whole = cache.read_on(lines, f"file://{tmp_path}/whole", key="log")
    want = sorted(map(tuple, whole.collect()))
    path = f"file://{tmp_path}/parts"
    for low, high in ((0, 70), (70, 150), (70, 150), (0, 150), (150, 240)):
        found = cache.read_on(lines.where((F.col("line_id") >= low) & (F.col("line_id") < high)), path, key="log")
    assert sorted(map(tuple, found.collect())) == want and len(want) == 240
    once = {(r.cache, r.line_id): r.template for r in cache.cached(lines, key="log", keep_key=True).collect()}
    assert once == {(c, line): t for c, line, _, t in want}
    assert Versions(spark, path).latest() == 3


def test_a_failed_run_changes_nothing(spark, tmp_path):
    class Failing(cache.Rules):
        def template(self, content, similar):
            if "poison" in content:
                raise ValueError("poison")
            return super().template(content, similar)

    path = f"file://{tmp_path}/state"
    lines = lambda *texts: spark.createDataFrame([(i, t) for i, t in texts], "line_id bigint, content string")
    cache.read_on(lines((1, "a 1 b"), (2, "c d e")), path, Failing()).collect()
    with pytest.raises(Exception, match="poison"):
        cache.read_on(lines((3, "x y z"), (4, "poison here")), path, Failing())
    got = cache.read_on(lines((3, "x y z"), (2, "c d e")), path, Failing()).orderBy("line_id").collect()
    assert [(r.line_id, r.template) for r in got] == [(1, "a <*> b"), (2, "c d e"), (3, "x y z")]


def test_answer_lines(spark):
    text = "Here are lines:\nOutput buffer full\nSure thing 4\n1. \"quoted\"\n2) b\n3: c\n- d\n* e\n```text\n--- rule\n# head\n** bold **\n> quote\n10、 ten\n以下是 lines\n说明x\n\n  padded  \nÜber 5"
    rows = spark.createDataFrame([(1, text)], "id int, answer string")
    variants = [r.line for r in augment.answer_lines(rows).collect()]
    assert variants == ["Here are lines:", "Output buffer full", "Sure thing 4", "quoted", "b", "c", "d", "e", "-- rule", "# head", "* bold **", "> quote", "10、 ten", "以下是 lines", "说明x", "padded", "Über 5"]
    logs = [r.line for r in augment.answer_lines(rows, "logs").collect()]
    assert logs == ["Here are lines:", "Output buffer full", "Sure thing 4", '"quoted"', "b", "3: c", "- d", "* e", "ten", "padded", "Über 5"]
    apache = spark.createDataFrame([(1, "1. [warn] x\n[Sun Dec 04 04:47:44 2005] [error] y")], "id int, answer string")
    got = [r.line for r in augment.answer_lines(apache, "logs", "Apache").collect()]
    assert got[0].endswith("] [warn] x") and got[0].startswith("[Sun Dec 04 0") and got[1] == "[Sun Dec 04 04:47:44 2005] [error] y"
