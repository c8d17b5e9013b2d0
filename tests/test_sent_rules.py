"""Rules of collections go to the lines, which stay where they are."""

from __future__ import annotations

from timberline.operators import rules


def test_lines_are_not_dealt_by_collection(spark):
    lines = spark.range(1000).selectExpr("id AS line_id", "if(id % 2 = 0, 'HDFS', 'none') AS dataset", "'blk_1 at 10.1.2.3:80' AS content").repartition(7)
    found = rules.with_rules(lines, rules.rule_table(spark), ["mask"])
    assert found.rdd.getNumPartitions() == 7
    assert {r.n for r in found.selectExpr("(dataset = 'HDFS') = (size(rules_mask) > 0) AS n").distinct().collect()} == {True}
