"""A parse tree in a stream, with a state for each path: restarts, late lines, clusters that end."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from timberline.streaming import templates

SCHEMA = "line_id bigint, content string, ts timestamp"
START = dt.datetime(2024, 1, 1, 12, 0)


@pytest.fixture()
def stream(spark, tmp_path):
    """Puts batches of (line_id, content, minute) into a folder and runs what is there to the end; a new query each time."""
    before = {k: spark.conf.get(k, None) for k in templates.STATE_STORE}
    for k, v in templates.STATE_STORE.items():
        spark.conf.set(k, v)

    def run(rows, **more):
        made = [(i, c, START + dt.timedelta(minutes=m)) for i, c, m in rows]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        found = templates.parse_by_path(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), (), **more)
        query = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        out = spark.read.parquet(f"{tmp_path}/out").collect()
        return {r.line_id: (r.number, r.template) for r in out}

    yield run
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_restart_late_lines_and_idle_clusters(stream):
    more = {"late": "10 minutes", "idle_ms": 60 * 60_000}
    got = stream([(1, "user a logged in", 0), (2, "user b logged in", 1), (3, "disk 7 is full", 1), (4, "disk 8 was full", 2)], **more)
    assert got == {1: (0, "user a logged in"), 2: (0, "user <*> logged in"), 3: (0, "disk 7 is full"), 4: (0, "disk <*> <*> full")}
    # a new query goes on from the checkpoint
    got = stream([(5, "user c logged in", 30), (6, "user c went away", 31)], **more)
    assert got[5] == (0, "user <*> logged in") and got[6] == (1, "user c went away")
    # the watermark is at minute 21 now: line 7 is late, line 8 is not
    got = stream([(7, "user d logged in", 5), (8, "user d logged in", 25)], **more)
    assert 7 not in got and got[8] == (0, "user <*> logged in")
    # three hours later all clusters were idle: the next line begins one anew
    stream([(9, "other thing here now", 240)], **more)
    got = stream([(10, "other thing here too", 241)], **more)
    got = stream([(11, "user e logged in", 242)], **more)
    assert got[11] == (2, "user e logged in") and got[10] == (0, "other thing here <*>")


def test_paths_dont_meet(spark):
    rows = spark.createDataFrame([("a b c",), ("x1 b c",), ("x2 b c",), ("a",)], "t string")
    assert [r.p for r in rows.select(templates.path_of(F.split("t", " ")).alias("p")).collect()] == ["a", "<*>", "<*>", "a"]
