"""Every miner with the settings of several collections."""

from __future__ import annotations

import pytest

from timberline import api


@pytest.mark.parametrize("miner", sorted(api.MINERS))
@pytest.mark.parametrize("dataset", ["HDFS", "Hadoop", "Proxifier"])
def test_mine(spark, miner, dataset):
    rows = [(i, f"receiving block blk_{i} from 10.0.0.{i}:50{i}") for i in range(12)] + [(50 + i, "service started") for i in range(3)]
    lines = spark.createDataFrame(rows, "line_id bigint, content string")
    got = {r.line_id: r.template for r in api.mine(lines, miner, dataset).collect()}
    assert set(got) == {k for k, _ in rows}
    assert all(t for t in got.values())


def test_contents_and_evaluate(spark):
    rows = [(i, f"081109 20351{i} 143 INFO dfs.DataNode: deleting block blk_{i}") for i in range(6)] + [(9, "no header")]
    lines = api.contents(spark.createDataFrame(rows, "line_id bigint, line string"), "HDFS")
    assert {r.content for r in lines.collect()} == {*(f"deleting block blk_{i}" for i in range(6)), "no header"}
    standard = spark.createDataFrame([("deleting block <*>",), ("other",)], "template string")
    row = api.evaluate(lines, standard, "mask", "HDFS").first()
    assert (round(row.pa, 4), row.pta, row.rta) == (round(6 / 7, 4), 0.5, 0.5)


def test_several_collections(spark):
    rows = [(d, i, f"deleting block blk_{i}") for d in ("HDFS", "Hadoop", "Mac") for i in range(4)]
    lines = spark.createDataFrame(rows, "dataset string, line_id bigint, content string")
    got = api.mine_all(lines, "mask", ("HDFS", "Hadoop")).collect()
    one = {d: sorted(map(tuple, api.mine(lines.where(lines.dataset == d), "mask", d).collect())) for d in ("HDFS", "Hadoop")}
    assert {d: sorted((r.line_id, r.template) for r in got if r.dataset == d) for d in one} == one and len(got) == 8
    standard = spark.createDataFrame([(d, "deleting block <*>") for d in ("HDFS", "Hadoop")], "dataset string, template string")
    table = api.evaluate_all(lines, standard, ("mask", "ngram"), ("HDFS", "Hadoop")).collect()
    assert {(r.miner, r.dataset) for r in table} == {(m, d) for m in ("mask", "ngram") for d in ("HDFS", "Hadoop")}
    assert next(r.pta for r in table if (r.miner, r.dataset) == ("mask", "HDFS")) == 1.0
