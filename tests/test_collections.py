"""Rules and thresholds of collections as tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from timberline import api
from timberline.operators import metrics, miners, rules
from timberline.settings import SETTINGS

#: A content of each collection and what its masks, removals and spacing leave.
MASKED = {
    "HDFS": ("Received block blk_-16 of size 7 from /10.2.3.4:50010", "Received block <*> of size 7 from /<*>"),
    "Hadoop": ("Recalculating schedule, headroom=<memory:0> at 10.1.1.9:80", "Recalculating schedule, headroom=<memory:0> at <*>:80"),
    "Spark": ("Block rdd_2 stored, 12 KB free 3.1 GB at mesos.slave.a:4", "Block rdd_2 stored, 12 <*> free 3.1 <*> at <*>:4"),
    "Zookeeper": ("Accepted connection from /10.1.1.2:3888", "Accepted connection from <*>"),
    "BGL": ("generating core.2275 in 11:1", "generating <*> in 11:1"),
    "HPC": ("node node-40 has no value 7", "node node-40 has no value 7"),
    "Thunderbird": ("session opened from 10.0.0.1 port 7", "session opened from <*> port 7"),
    "Windows": ("Failed HRESULT = 0x800f080d - done", "Failed HRESULT = <*>- done"),
    "Linux": ("connection from 1.2.3.4 at Jul 17 06:15:40", "connection from <*> at <*> 17 <*>"),
    "Android": ("getTasks: caller 10111 from /data/app x.y.z", "getTasks: caller <*> from <*> <*>"),
    "HealthApp": ("setTodayTotalDetailSteps=1514038440000##7", "setTodayTotalDetailSteps=1514038440000##7"),
    "Apache": ("[client 1.2.3.4] Directory index", "[client <*>] Directory index"),
    "OpenSSH": ("Failed password from 1.2.3.4 via a.b.c", "Failed password from <*> via <*>"),
    "OpenStack": ("10.1.1.1,10.1.1.2 GET /v2/servers  status 200", "<*> GET <*>status <*>"),
    "Mac": ("ARPT at host.corp.example-x: 60", "ARPT at <*>: 60"),
    "Proxifier": ("proxy.cse.edu:5070 close, 451 bytes sent, 18 KB lifetime <1 sec (x)", "<*> close, 451 bytes sent, 18 <*> lifetime <*> "),
}


def test_masks_of_every_collection(spark):
    assert set(MASKED) == set(SETTINGS)
    lines = spark.createDataFrame([(d, given) for d, (given, _) in MASKED.items()], "dataset string, content string")
    with_ = rules.with_rules(lines, rules.rule_table(spark), ("mask", "removed"))
    got = {r.dataset: r.text for r in with_.select("dataset", rules.rewritten(F.col("content"), F.col("rules_mask"), F.col("rules_removed")).alias("text")).collect()}
    assert got == {d: want for d, (_, want) in MASKED.items()}


def test_legacy_masks(spark):
    given = {
        "OpenSSH": ("Failed password for invalid user bob from 1.2.3.4 port 22", "Failed password for invalid user <*> from <*> port <*>"),
        "Zookeeper": ("Thread-7 sid:2 cport:-1 at snapshot.b00f 0x1a", "Thread-<*> sid:<*> cport:<*> at snapshot.b<*> <*>"),
        "Apache": ("jk2_init() Can't find child 17 in slot 4", "<*> <*> in slot <*>"),
        "Mac": ("no list 12", "no list 12"),
    }
    lines = spark.createDataFrame([(d, a) for d, (a, _) in given.items()], "dataset string, content string")
    with_ = rules.with_rules(lines, rules.rule_table(spark), ("legacy mask",))
    got = {r.dataset: r.text for r in with_.select("dataset", rules.rewritten(F.col("content"), F.col("rules_legacy_mask")).alias("text")).collect()}
    assert got == {d: want for d, (_, want) in given.items()}


def test_headers(spark):
    rows = [("Linux", "Jun 14 15:16:01 combo sshd(pam_unix)[19939]: failure; logname= uid=0"), ("Linux", "Jun 14 15:16:01 combo su: session opened"), ("HDFS", "nothing"), (None, "x"), ("Unknown", "y")]
    got = {r.line: r for r in rules.split_headers(spark.createDataFrame(rows, "dataset string, line string"), rules.header_table(spark)).collect()}
    first = got[rows[0][1]]
    assert first.format_ok and first.fields["Component"] == "sshd(pam_unix)" and first.fields["PID"] == "19939" and first.content == "failure; logname= uid=0"
    assert got[rows[1][1]].fields["PID"] == "" and got[rows[1][1]].content == "session opened"
    assert [(got[k].format_ok, got[k].fields, got[k].content) for k in ("nothing", "x", "y")] == [(False, None, "nothing"), (False, None, "x"), (False, None, "y")]


LINES = [(f"0.{k}", d, i, text) for k in (1, 9) for d in ("HDFS", "Hadoop", "Mac") for i, text in enumerate([f"deleting block blk_{k}{n} at 10.0.0.{n}" for n in range(9)] + ["service started", f"run {k} ended, code=3"])]


@pytest.mark.parametrize("miner", sorted(set(api.MINERS) - {"cache", "subsequence"}))
def test_logs_dont_meet(spark, miner):
    """One run over levels and collections gives what each log alone gives with the settings of its collection."""
    lines = spark.createDataFrame(LINES, "level string, dataset string, line_id bigint, content string")
    got = {}
    for r in api.mine_all(lines, miner, key=("level", "dataset")).collect():
        got.setdefault((r.level, r.dataset), {})[r.line_id] = r.template
    for (level, dataset), found in got.items():
        own = lines.where((F.col("level") == level) & (F.col("dataset") == dataset)).select("line_id", "content")
        assert found == {r.line_id: r.template for r in api.mine(own, miner, dataset).collect()}
    assert len(got) == 6


def test_settings_by_argument_and_by_table_agree(spark):
    own = spark.createDataFrame([(i, t) for _, d, i, t in LINES if d == "Hadoop"][:11], "line_id bigint, content string")
    s = SETTINGS["Hadoop"]
    plain = {
        "positional": miners.brain(own, s.masks, s.removed, s.spaced, s.brain_threshold, s.digits_vary),
        "ngram": miners.logram(own, s.masks, s.bigram_threshold, s.trigram_threshold),
        "anchor": miners.by_anchors(own, s.masks, s.removed, (), s.anchor_threshold),
    }
    for name, found in plain.items():
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, api.mine(own, name, "Hadoop").collect()))


def test_plan_does_not_grow_with_collections(spark):
    def size(datasets):
        lines = spark.createDataFrame([(d, i, f"block {i}") for d in datasets for i in range(3)], "dataset string, line_id bigint, content string")
        standard = lines.select("dataset", F.lit("block <*>").alias("template")).distinct()
        own = api.evaluate_all(lines, standard, ("mask", "positional", "ngram"))
        return own._jdf.queryExecution().optimizedPlan().toString().count("\n")

    assert size(["HDFS"]) == size(list(SETTINGS))


def test_accuracy_by_key(spark):
    made = spark.createDataFrame([("a", "x <*>", 3), ("a", "y", 1), ("b", "x <*>", 2)], "k string, template string, n bigint")
    true = spark.createDataFrame([("a", "x <*>"), ("b", "z"), ("c", "z")], "k string, template string")
    got = {r.k: (r.pa, r.pta, r.rta) for r in metrics.template_accuracy(made, true, key=["k"]).collect()}
    assert got == {"a": (0.75, 0.5, 1.0), "b": (0.0, 0.0, 0.0), "c": (0.0, 0.0, 0.0)}


def test_own_tables_of_rules(spark):
    table = spark.createDataFrame([("mine", "mask", 1, "b+", "<*>"), ("mine", "mask", 0, "ab", "b")], rules.RULES_SQL)
    lines = spark.createDataFrame([("mine", 1, "aab x"), ("other", 1, "aab")], "dataset string, line_id bigint, content string")
    got = api.mine_all(lines, "mask", rule_table=table, thresholds=rules.threshold_table(spark, {"mine": SETTINGS["HDFS"]})).collect()
    assert [tuple(r) for r in got] == [("mine", 1, "a<*> x")]
