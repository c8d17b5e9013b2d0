"""Miners with one state hold a batch of a group's lines, not the whole group."""

from __future__ import annotations

import tracemalloc

import pytest

from timberline.operators import cache, online

LINES, WIDTH = 100_000, 1_000


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    yield spark
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lines_are_streamed(small_batches):
    class Probe:
        """A state whose one template is the most memory that was in use, in MB."""

        def __init__(self):
            tracemalloc.start()
            tracemalloc.reset_peak()

        def add(self, tokens):
            return 0

        @property
        def templates(self):
            return [[str(tracemalloc.get_traced_memory()[1] // 1_000_000)]]

    rows = small_batches.range(LINES).selectExpr("id AS line_id", f"array(rpad(cast(id as string), {WIDTH}, 'x')) AS tokens", "0 AS log")
    found = online._mined(rows, ["log"], [], lambda row: Probe())
    assert found.count() == LINES
    peaks = {int(r.template) for r in found.select("template").distinct().collect()}
    assert len(peaks) == 1 and max(peaks) < LINES * WIDTH // 2_000_000  # half of the group's text


def test_groups_of_null_and_other_keys(spark):
    rows = spark.createDataFrame([(2, None, "b 1"), (1, None, "b 2"), (1, "x", "b 1"), (5, "x", "c")], "line_id long, log string, content string")
    found = online.drain(rows, similarity=0.4, key=["log"])
    assert sorted((r.log or "", r.line_id, r.template) for r in found.collect()) == [("", 1, "b <*>"), ("", 2, "b <*>"), ("x", 1, "b 1"), ("x", 5, "c")]


def test_cached_lines_are_streamed(small_batches):
    class Probe:
        def template(self, content, similar):
            if content != "probe":
                tracemalloc.start()
                tracemalloc.reset_peak()
                return content
            return f"peak {tracemalloc.get_traced_memory()[1] // 1_000_000}"

    lines = small_batches.range(LINES + 1).selectExpr("id AS line_id", f"if(id = {LINES}, 'probe', rpad('same', {WIDTH}, 'x')) AS content")
    found = cache.cached(lines, Probe())
    assert found.count() == LINES + 1
    peak = found.where(f"line_id = {LINES}").first().template
    assert int(peak.removeprefix("peak ")) < LINES * WIDTH // 2_000_000
