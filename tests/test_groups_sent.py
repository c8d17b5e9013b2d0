"""What positional mining knows of groups and frequent tokens is sent to its rows."""

from __future__ import annotations

from timberline.operators import miners


def test_rows_are_not_dealt_by_group(spark):
    lines = spark.range(200).selectExpr("id AS line_id", "concat('send ', id % 7, ' bytes to host', id % 9) AS content")
    plan = miners.brain(lines)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [width" not in plan and "SortMergeJoin [pos" not in plan
