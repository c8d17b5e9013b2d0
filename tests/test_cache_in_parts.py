"""A log whose cache settles is read in parts, with the result of one reader of all its lines."""

from __future__ import annotations

import random
import re

import pytest

from timberline.operators import cache

SEPARATORS = r"""[\s!"#$%&'()+,\-/:;=?@.\[\\\]^_`{|}~]"""


def plain(texts: list[str]) -> list[str]:
    """Templates of lines, one after the other, by a cache that remembers nothing."""
    own, source = cache.TemplateCache(), cache.Rules()
    numbers = []
    for text in texts:
        found, similar = own.find(cache.split(text))
        numbers.append(own.add(source.template(text, similar), similar) if found is None else found)
    return ["<*>" if k < 0 else own.templates[k] for k in numbers]


def drawn(seed: int, n: int) -> list[str]:
    draw = random.Random(seed)
    forms = ["user {} viewed page {} of the shop", "job {} ended {} after {} ms", "open /srv/{} by={}", "{}", "a b c d e {} g", "late (x) {} = {}"]
    words = ["ann", "bob", "7", "12", "10.0.0.1", "<*>", "x-y"]
    late = lambda k: forms if k > n * 0.8 else forms[:4]
    return [re.sub(r"\{\}", lambda _: draw.choice(words), draw.choice(late(k))) for k in range(n)]


@pytest.mark.parametrize(("seed", "mixed"), [(1, False), (2, True), (3, True)])
def test_parts_are_as_one_reader(spark, monkeypatch, seed, mixed):
    monkeypatch.setattr(cache, "_run", None)  # one task for a log
    logs = {"x": drawn(seed, 900), "y": drawn(seed + 10, 300), None: drawn(seed + 20, 50)}
    rows = [(log, k, text) for log, texts in logs.items() for k, text in enumerate(texts)]
    if mixed:
        random.Random(seed).shuffle(rows)
    lines = spark.createDataFrame(rows, "log string, line_id long, content string").repartition(7) if mixed else spark.createDataFrame(rows, "log string, line_id long, content string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        found = cache.cached(lines, key="log", keep_key=True).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(log, k): t for log, texts in logs.items() for k, t in enumerate(plain(texts))}
    assert len(found) == len(rows) and {(r.cache, r.line_id): r.template for r in found} == want


@pytest.mark.parametrize("limit", ["MOST", "ROUNDS"])
def test_a_log_that_does_not_settle_has_one_reader(spark, monkeypatch, limit):
    monkeypatch.setattr(cache, limit, 1)
    texts = drawn(5, 200)
    lines = spark.createDataFrame(list(enumerate(texts)), "line_id long, content string")
    assert cache._in_parts(lines.selectExpr("line_id", "content", "'' AS cache")) is None
    assert [r.template for r in cache.cached(lines).orderBy("line_id").collect()] == plain(texts)


def test_lines_that_are_equal_and_have_no_fitting_template(spark):
    texts = ["open /- now", "open /- now", "open /- now", "shut"]
    lines = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "line_id long, content string")
    assert cache._in_parts(lines.selectExpr("line_id", "content", "'' AS cache")) is None
    assert sorted(r.template for r in cache.cached(lines).collect()) == sorted(plain(texts))


def test_no_lines(spark):
    assert cache.cached(spark.createDataFrame([], "line_id long, content string")).collect() == []


def test_split_is_by_separators():
    draw = random.Random(1)
    for _ in range(2_000):
        text = "".join(draw.choice("ab<*>=|()-_/. \t é") for _ in range(draw.randrange(30)))
        out: list[str] = []
        for part in re.findall(rf"{SEPARATORS}|[^{SEPARATORS[1:]}+", text):
            token = "<*>" if "<*>" in part else "".join(c for c in part if c in "=|()" or c not in "!\"#$%&'+,-/:;?@.[\\]^_`{}~").strip()
            if token and not (token == "<*>" and out and out[-1] == "<*>"):
                out.append(token)
        assert cache.split(text) == out


def test_a_cache_remembers_little(monkeypatch):
    monkeypatch.setattr(cache, "HELD", 50)
    own, texts = cache.TemplateCache(), drawn(9, 400)
    numbers = [own.number(t, cache.Rules()) for t in texts]
    assert ["<*>" if k < 0 else own.templates[k] for k in numbers] == plain(texts)
    assert sum(len(kind) for kind in own.held) <= 50 + 30
