"""N-grams against plain versions, and how much of them is shuffled."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from timberline.operators import grams, miners


def pairs(w):
    return [(x, w[(k + 1) % len(w)]) for k, x in enumerate(w)]


def triples(w):
    return list(zip(w, w[1:], w[2:], strict=False))


def plain(lines: list[str], two: int, three: int) -> list[str]:
    split = [x.split(" ") for x in lines]
    a, b = Counter(g for w in split for g in pairs(w)), Counter(g for w in split for g in triples(w))
    out = []
    for w in split:
        rare = {k + d for k, g in enumerate(triples(w)) if b[g] < three for d in (0, 1, 2)}
        n = [a[g] for g in pairs(w)]
        kept = [n[0] > two if k == 0 else n[k] >= two or n[k - 1] >= two for k in range(len(w))]
        out.append(" ".join("<*>" if k in rare and not kept[k] else x for k, x in enumerate(w)).replace(",", ""))
    return out


@pytest.mark.parametrize(("sent", "piece"), [(grams.SENT, grams.PIECE), (0, 20)])
def test_mining_by_grams(spark, monkeypatch, sent, piece):
    monkeypatch.setattr(grams, "SENT", sent)
    monkeypatch.setattr(grams, "PIECE", piece)
    draw = random.Random(3)
    lines = [" ".join(draw.choice(["a", "b", "c,", "d", "é"]) for _ in range(draw.randrange(1, 9))) for _ in range(150)] + ["", "a", "a a a a"]
    frame = spark.createDataFrame(list(enumerate(lines)), "line_id long, content string")
    found = miners.logram(frame, (), 6, 3).orderBy("line_id").collect()
    assert [r.template for r in found] == plain(lines, 6, 3)


def test_counts_by_key(spark):
    rows = spark.createDataFrame([("x", "a b c"), ("x", "a b"), ("y", "a b c"), ("y", ""), ("y", None)], "log string, text string")
    found = {(r.log, r.gram): r.freq for r in grams.counts(rows, (2, 3), ["log"]).collect()}
    assert found == {("x", "2 a b"): 2, ("x", "2 b c"): 1, ("x", "2 c a"): 1, ("x", "2 b a"): 1, ("x", "3 a b c"): 1, ("y", "2 a b"): 1, ("y", "2 b c"): 1, ("y", "2 c a"): 1, ("y", "3 a b c"): 1, ("y", "2  "): 1}


def shuffled(spark) -> dict[int, int]:
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}


def test_shuffled_bytes(spark):
    """Rare n-grams, which most are, leave their task once, when they are counted."""
    lines = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "content")).selectExpr("doc_id * 1000000 + pos AS line_id", "content")
    size = lines.agg(F.sum(F.octet_length("content"))).first()[0]
    before = shuffled(spark)
    miners.logram(lines, (r"\b\d+\b",), 15, 10).write.format("noop").mode("overwrite").save()
    assert sum(n for k, n in shuffled(spark).items() if k not in before) < 8 * size


def test_little_is_shuffled(spark):
    """Most n-grams are rare: they leave their task as a distance between slots, and lines don't leave theirs."""
    lines = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "content")).selectExpr("doc_id * 1000000 + pos AS line_id", "content")
    size = lines.agg(F.sum(F.octet_length("content"))).first()[0]
    before = shuffled(spark)
    miners.logram(lines, (r"\b\d+\b",), 15, 10).write.format("noop").mode("overwrite").save()
    assert sum(n for k, n in shuffled(spark).items() if k not in before) < 2 * size


@pytest.mark.parametrize("same", [False, True])
def test_mining_by_key_and_with_hashes_that_meet(spark, monkeypatch, same):
    """Logs have n-grams of their own; where hashes meet, n-grams are told apart by themselves."""
    if same:
        told = grams.told
        monkeypatch.setattr(grams, "told", lambda *a: told(*a).withColumn("n", F.lit(2)))
    draw = random.Random(4)
    logs = {log: [" ".join(draw.choice("abcd") for _ in range(draw.randrange(1, 7))) for _ in range(80)] for log in ("x", "y")}
    rows = [(log, k, line) for log, own in logs.items() for k, line in enumerate(own)]
    found = miners.logram(spark.createDataFrame(rows, "log string, line_id long, content string"), (), 6, 3, key=["log"]).orderBy("log", "line_id").collect()
    assert [r.template for r in found] == plain(logs["x"], 6, 3) + plain(logs["y"], 6, 3)


def test_frequent_slots_are_kept():
    places = grams.np.asarray([0, 0, 5, 70_000, (1 << grams.RANGE) - 1])
    assert grams._unpacked(grams._packed(places)).tolist() == places.tolist()


def test_counts_of_hashes_that_meet_stay_apart():
    np = grams.np
    hashes, checks, n = grams._added(np.asarray([5, 2**63, 5, 5], np.uint64), np.asarray([1, 2, 1, 3], np.uint32), np.asarray([1, 4, 2, 1]))
    assert list(zip(hashes.tolist(), checks.tolist(), n.tolist(), strict=True)) == [(5, 1, 3), (5, 3, 1), (2**63, 2, 4)]
    data = grams._planes(np.diff(hashes, prepend=np.uint64(0))) + grams._planes(checks) + grams._planes(n.astype(np.uint32))
    assert np.cumsum(grams._values(data, "<u8", 0, 3), dtype=np.uint64).tolist() == hashes.tolist()
    assert grams._values(data, "<u4", 8, 3).tolist() == checks.tolist() and grams._values(data, "<u4", 12, 3).tolist() == n.tolist()
