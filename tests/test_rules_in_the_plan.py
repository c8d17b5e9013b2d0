"""Patterns of collections stand in the plan, and lines stay where they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline import api
from timberline.operators import rules
from timberline.settings import SETTINGS


def test_rules_in_the_plan_give_what_arrays_give(spark):
    text = "a,b=c:d blk_7 (x) _y 10.1.2.3:80 12 KB host.example.org/x 0xff [9] 03:04:05"
    lines = spark.createDataFrame([(d, text) for d in (*SETTINGS, "none", None)] + [("HDFS", None)], "dataset string, content string")
    for kinds in (("mask", "removed", "positional spaced"), ("mask", "anchor spaced"), ("legacy mask",), ("spaced",)):
        plain = rules.rewritten(F.col("content"), *[F.col(rules.column_of(k)) for k in kinds])
        table = rules.rule_table(spark)
        for known in (rules.read(None, kinds), rules.read(table, kinds)):
            both = rules.with_rules(lines, table, kinds).select(plain.alias("a"), rules.rewritten_by(F.col("content"), known, *kinds).alias("b"))
            assert both.where("not (a <=> b)").count() == 0
    spaced = rules.with_rules(lines, rules.rule_table(spark), ["last mask"])
    both = spaced.select(rules.rewritten_after_space(F.col("content"), F.col("rules_last_mask")).alias("a"), rules.rewritten_by(F.col("content"), rules.read(None, ["last mask"]), "last mask", before=" ").alias("b"))
    assert both.where("not (a <=> b)").count() == 0


def test_mined_lines_are_not_dealt_by_collection(spark):
    lines = spark.range(100).selectExpr("id AS line_id", "if(id % 2 = 0, 'HDFS', 'Spark') AS dataset", "'blk_1 at 10.1.2.3:80' AS content").repartition(7)
    assert api.mine_all(lines, "mask").rdd.getNumPartitions() == 7


def test_headers_are_split_in_one_go(spark):
    rows = [("HDFS", "081109 203615 148 INFO a.B: text 5 "), ("HDFS", "081109 203615 148 INFO a.B: te\x01xt"), ("HDFS", "081109 203615 148 INFO a.B: text\n"), ("HDFS", "odd"), ("HDFS", "\x01odd"), ("HDFS", None), ("none", "x"), (None, "y")]
    lines = spark.createDataFrame(rows, "dataset string, line string").repartition(7)
    found = rules.split_headers(lines, rules.header_table(spark))
    assert found.rdd.getNumPartitions() == 7
    got = {(r.dataset, r.line): (r.format_ok, r.content, r.fields and r.fields["Component"]) for r in found.collect()}
    assert got == {rows[0]: (True, "text 5", "a.B"), rows[1]: (True, "te\x01xt", "a.B"), rows[2]: (True, "text", "a.B"), **{r: (False, r[1], None) for r in rows[3:]}}
