"""Sources, sinks, ordering and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.functions.ordering import numbered
from timberline.sources import files
from timberline.streaming import templates


def test_read_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes("one\r\n\n  \ntwo é\n".encode())
    (tmp_path / "b.log").write_bytes("三\n四".encode("gbk"))
    got = [(r.line_id, r.line) for r in files.read_lines(spark, str(tmp_path / "a.log")).orderBy("line_id").collect()]
    assert got == [(1, "one"), (2, "two é")]
    assert files.read_lines(spark, str(tmp_path / "a.log"), keep_blank=True).count() == 4
    odd = [r.line for r in files.read_lines(spark, str(tmp_path / "b.log"), encoding=None).orderBy("line_id").collect()]
    assert odd == ["三", "四"]


def test_lists(spark, tmp_path):
    df = spark.createDataFrame([("a <*> b", 3), ("lone", 12)], "template string, n bigint")
    files.write_counts(df, str(tmp_path / "t"))
    assert sorted(map(tuple, files.parsed_counts(spark.read.text(str(tmp_path / "t"))).collect())) == [("a <*> b", 3), ("lone", 12)]
    ids = spark.createDataFrame([("1,2, 3",), ("x,4",), ("",)], "v string").select(files.parsed_ids(F.col("v")).alias("v")).collect()
    assert [r.v for r in ids] == [[1, 2, 3], [4], []]
    assert files.find_log(["d/HDFS_2k.log", "HDFS.log", "HDFS_new.log"], "HDFS", "new") == "HDFS_new.log"
    assert files.find_log(["d/HDFS_2k.log", "HDFS.log"], "HDFS") == "d/HDFS_2k.log" and files.find_log([], "HDFS") is None


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('EventId,EventTemplate\nE1,"a, ""b"" <*>"\nE2,"two\nlines"\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "t.csv")).collect()] == [("E1", 'a, "b" <*>'), ("E2", "two\nlines")]


def test_structured(spark):
    lines = spark.createDataFrame([(1, "user 5 in"), (2, "bye")], "line_id bigint, content string")
    made = spark.createDataFrame([(1, "user <*> in"), (2, "bye")], "line_id bigint, template string")
    got = {r.line_id: r for r in files.structured(lines, made).collect()}
    assert got[1].parameter_list == ["5"] and got[2].parameter_list == [] and len(got[1].event_id) == 8


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("line_id"))
    got = numbered(df).collect()
    assert all(r.number == r.line_id + 1 for r in got)
    assert numbered(df.limit(0)).count() == 0


def test_streams(spark, tmp_path):
    rows = [(i, f"user {i} in" if i % 2 else f"disk d{i} full now", f"2024-01-01 00:{i:02d}:00") for i in range(40)]
    df = spark.createDataFrame(rows, "line_id bigint, content string, at string").select("line_id", "content", F.to_timestamp("at").alias("ts"))
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, made, mode in (
        ("counts", templates.windowed_counts(stream, (r"\b\d+\b",)), "complete"),
        ("parsed", templates.parse_stream(stream, (r"\b\d+\b",)), "append"),
    ):
        query = made.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
    assert spark.table("counts").where("template = 'user <*> in'").agg(F.sum("n")).first()[0] == 20
    assert spark.table("parsed").count() == 40
    assert spark.table("parsed").where("template = 'user <*> in'").count() == 20
