"""Tokens of a message and of its template are made once for a message."""

from __future__ import annotations

from timberline.operators import answers


def test_tokens_are_made_once(spark):
    messages = spark.createDataFrame([("a 5 b",), ("c 6 d",)], "content string")
    said = spark.createDataFrame([("a 5 b", "Log template: `a {x} b`"), ("c 6 d", "Log template: `e {x}`")], "message string, answer string")
    found = answers.templates(messages, said)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "AS _tokens" in plan and "AS _own" not in plan
    assert {(r.content, r.template, r.source) for r in found.collect()} == {("a 5 b", "a <*> b", "answer"), ("c 6 d", "c <*> d", "no match")}
