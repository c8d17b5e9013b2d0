"""Cutting of Chinese text and mining over its words."""

from __future__ import annotations

import math
import random
import re

from pyspark.sql import functions as F

from timberline.operators import chinese

WORDS = {"虚拟": 50, "虚拟机": 40, "机": 9, "告警": 60, "发生": 30, "生告": 2, "严重": 20, "严重告警": 5, "磁盘": 25, "使用": 20, "使用率": 12, "率": 3, "，": 100, "：": 100, "请": 30, "检查": 40}


def plain_cut(run, words):
    total = math.log(sum(words.values()))
    best = {len(run): (0.0, 0)}
    for i in range(len(run) - 1, -1, -1):
        options = [(math.log(words.get(run[i:j], 1)) - total + best[j][0], j) for j in range(i + 1, len(run) + 1) if j == i + 1 or run[i:j] in words]
        best[i] = max(options)
    out, i = [], 0
    while i < len(run):
        out.append(run[i : best[i][1]])
        i = best[i][1]
    return out


def test_best_paths(spark):
    rng = random.Random(6)
    letters = "".join(WORDS) + "甲乙"
    runs = ["".join(rng.choice([rng.choice(list(WORDS)), rng.choice(letters)]) for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    dictionary = spark.createDataFrame(list(WORDS.items()), "word string, freq bigint")
    got = {r.run: r.words for r in chinese.cut(spark.createDataFrame([(r,) for r in [*runs, ""]], "run string"), dictionary).collect()}
    assert got == {r: plain_cut(r, WORDS) for r in runs}
    assert all("".join(w) == r for r, w in got.items())


def test_tokens_come_together_again(spark):
    texts = ["虚拟机vm-1 发生严重告警：cpu 使用率*%", "abc* x_* y*z off* s*", "", "磁盘，", " \t 请检查"]
    dictionary = spark.createDataFrame(list(WORDS.items()), "word string, freq bigint")
    got = {r.text: r.tokens for r in chinese.tokens(spark.createDataFrame([(t,) for t in texts], "text string"), dictionary).collect()}
    assert {t: "".join(w) for t, w in got.items()} == {t: t for t in texts}
    assert got[texts[0]] == ["虚拟机", "vm-1", " ", "发生", "严重告警", "：", "cpu", " ", "使用率", "*", "%"]
    assert got[texts[1]] == ["abc", "*", " ", "x_*", " ", "y", "*", "z", " ", "off*", " ", "s*"]


def test_alarm_text(spark):
    rows = spark.createDataFrame([("告警(a),[b]{c}【d】", "告警<a>，<b><c><d>"), ("虚拟机列表：vm1\nvm2", "虚拟机列表：*"), ("x 可能原因12：y\nz", "x *"), ("ip 10.0.0.1 -", "ip * ")], "t string, want string")
    got = rows.select(chinese.alarm_text(F.col("t"), [r"(\d+\.){3}\d+"], ["-"]).alias("t"), "want").collect()
    assert all(r.t == r.want for r in got)


def test_mining(spark):
    dictionary = spark.createDataFrame(list(WORDS.items()), "word string, freq bigint")
    rows = [(i, f"虚拟机vm{'abcdefgh'[i % 8]}发生告警，使用率{i}%") for i in range(24)] + [(100 + i, f"磁盘 /dev/sd{'ab'[i % 2]} 请检查") for i in range(6)]
    got = {r.line_id: r.template for r in chinese.brain(spark.createDataFrame(rows, "line_id bigint, content string"), dictionary, threshold=4).collect()}
    assert {got[i] for i in range(24)} == {"虚拟机*发生告警，使用率**"} or {re.sub(r"\*+", "*", got[i]) for i in range(24)} == {"虚拟机*发生告警，使用率*"}
    assert {got[i] for i in range(100, 106)} == {"磁盘 /dev/sda 请检查", "磁盘 /dev/sdb 请检查"}  # slashes make no variable
