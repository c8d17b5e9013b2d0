"""Counts are looked up where rows stand, and give what a join gives."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from timberline.operators import counted, sampling


def test_counts_are_those_of_a_join(spark):
    rng = random.Random(5)
    rows = [(i, f"w{int(rng.paretovariate(0.6)) % 300}") for i in range(2000)]
    table = spark.createDataFrame(rows, "line_id bigint, token string")
    sizes = Counter(w for _, w in rows)
    counts = table.groupBy("token").agg(F.count("*").alias("n"))
    want = sorted((i, w, sizes[w]) for i, w in rows)
    for sent in (0, 1, 10, 10_000):
        found = counted.with_counts(table, counts, ["token"], "n", sent)
        assert sorted((r.line_id, r.token, r.n) for r in found.collect()) == want


def test_top_tokens_of_a_line_that_several_rows_have(spark):
    rows = [(1, "aaa bbb aaa"), (1, "bbb ccc ddd"), (2, "the aaa zz"), (3, ""), (4, None)]
    lines = spark.createDataFrame(rows, "line_id bigint, content string")
    found = sampling.top_tokens(lines, F.split("content", " "))
    assert sorted((r.line_id, r["rank"], r.token) for r in found.collect()) == [(1, 1, "aaa"), (1, 2, "bbb"), (1, 3, "ccc"), (2, 1, "aaa")]
    # tokens are not dealt by word, or by line before the best ones are known
    assert "hashpartitioning(token" not in found._jdf.queryExecution().executedPlan().toString()
