"""Reading logs and lists, and writing results."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.ordering import numbered

#: Encodings that are tried in this order.
ENCODINGS = ("utf-8", "utf-8-sig", "gbk", "latin-1")


def decoded(raw: bytes) -> str:
    """By the first encoding that fits; a byte-order mark goes."""
    for name in ENCODINGS:
        try:
            return raw.decode(name).removeprefix("﻿")
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def read_lines(spark: SparkSession, path: str, keep_blank: bool = False, encoding: str | None = "utf-8") -> DataFrame:
    """(line_id, line) of text files, numbered from 1 by file and place.

    UTF-8 is split by Spark; ``encoding=None`` takes whole files and finds out each one's encoding.
    """
    if encoding == "utf-8":
        lines = spark.read.text(path).select(F.regexp_replace(F.regexp_replace("value", "\r$", ""), "^﻿", "").alias("line"), F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    else:

        def split(batches):
            for pdf in batches:
                rows = [(p, i, line) for p, raw in zip(pdf["path"], pdf["content"], strict=True) for i, line in enumerate(decoded(bytes(raw)).split("\n"))]
                yield type(pdf)(rows, columns=["_file", "_at", "line"])

        lines = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(split, "_file string, _at bigint, line string")
        lines = lines.withColumn("line", F.regexp_replace("line", "\r$", ""))
    lines = lines if keep_blank else lines.where(F.trim("line") != "")
    return numbered(lines, ("_file", "_at"), "line_id").select(F.col("line_id"), "line")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; quoted fields may hold line feeds and doubled quotes."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="utf-8")


def read_rows(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Columns of CSV files as strings, each file in the first encoding that fits; absent columns are null."""
    names = list(columns)

    def split(batches):
        import csv
        import io

        for pdf in batches:
            rows = [[r.get(c) for c in names] for raw in pdf["content"] for r in csv.DictReader(io.StringIO(decoded(bytes(raw)), newline=""))]
            yield type(pdf)(rows, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(split, ", ".join(f"`{c}` string" for c in names))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """(event_id, template) of a table of standard templates; rows without a template are left out."""
    rows = read_rows(spark, path, ("EventId", "EventTemplate"))
    return rows.select(F.col("EventId").alias("event_id"), F.col("EventTemplate").alias("template")).where("template is not null and template != ''")


# The names of a group table's columns, also as they come out of a wrong encoding.
GROUP_COLUMNS = (("模板", "妯℃澘"), ("句子标号", "鍙ュ瓙鏍囧彿"))


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(template, line_ids) of group tables in GBK or UTF-8; columns with other names count by their place."""

    def split(batches):
        import csv
        import io

        for pdf in batches:
            out = []
            for raw in pdf["content"]:
                text = next((t for t in (_tried(bytes(raw), e) for e in ("gbk", "utf-8-sig", "utf-8")) if t is not None), None)
                if text is None:
                    raise ValueError("neither GBK nor UTF-8")
                for r in csv.DictReader(io.StringIO(text, newline="")):
                    keys = list(r)
                    found = [next((r[n] for n in names if r.get(n)), r[keys[k]] if k < len(keys) else "") for k, names in enumerate(GROUP_COLUMNS)]
                    out.append([x or "" for x in found])
            yield type(pdf)(out, columns=["template", "ids"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(split, "template string, ids string")
    return rows.select("template", parsed_ids(F.col("ids")).alias("line_ids"))


def _tried(raw: bytes, encoding: str) -> str | None:
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError:
        return None


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines of text files, -1 where there are none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return spark.read.text(path).count() if there else -1


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, line) of non-blank lines, without white space and backticks around them."""
    lines = read_lines(spark, path)
    return lines.select("line_id", F.expr("trim(BOTH '`' FROM trim(line))").alias("line"))


def load_log(spark: SparkSession, path: str, log_format: str) -> DataFrame:
    """Structured lines of a log: what isn't ASCII has a name, lines that don't fit the format are left out and the rest numbered."""
    from timberline.operators.clean import ascii_only, split_header

    lines = read_lines(spark, path).select("line_id", ascii_only(F.col("line"), "<N/ASCII>").alias("line"))
    return split_header(lines, log_format, keep_failures=False)


def find_log(names: Sequence[str], dataset: str, suffix: str = "") -> str | None:
    """The log of a data set among paths: with the suffix, then ``_2k``, then bare; the least nested first."""
    wanted = [f"{dataset}_{suffix}.log", f"{dataset}_{suffix}.logs"] if suffix else []
    wanted += [f"{dataset}_2k.log", f"{dataset}.log"]
    by_name: dict[str, str] = {}
    for name in sorted(names, key=lambda n: (n.count("/"), n)):
        by_name.setdefault(PurePosixPath(name).name, name)
    return next((by_name[w] for w in wanted if w in by_name), None)


def parsed_ids(ids):
    """Comma-joined numbers as an array; what is no number goes."""
    return F.filter(F.transform(F.split(ids, ","), lambda x: F.try_to_number(F.trim(x), F.lit("999999999999999999")).cast("bigint")), lambda x: x.isNotNull())


def parsed_counts(lines: DataFrame, column: str = "value") -> DataFrame:
    """(template, n) of lines that end with a count; without one, n is null."""
    count = F.regexp_extract(column, r" (\d+)$", 1)
    return lines.select(
        F.when(count != "", F.regexp_replace(column, r" \d+$", "")).otherwise(F.col(column)).alias("template"), F.when(count != "", count).cast("bigint").alias("n")
    )


def write_counts(counts: DataFrame, path: str) -> None:
    """A text file of ``template n`` lines."""
    counts.select(F.concat_ws(" ", "template", F.col("n").cast("string")).alias("value")).write.text(path)


def structured(lines: DataFrame, assigned: DataFrame) -> DataFrame:
    """Lines with event_id, template and the values of its variables."""
    from timberline.operators.clean import template_id
    from timberline.operators.extract import parameters

    both = lines.join(assigned.select("line_id", F.col("template").alias("event_template")), "line_id")
    return parameters(both.withColumn("event_id", template_id(F.col("event_template"))), "content", "event_template")


def templates_table(found: DataFrame) -> DataFrame:
    """(event_id, event_template, occurrences) of structured lines, the table beside them."""
    return found.groupBy("event_id", "event_template").agg(F.count("*").alias("occurrences"))
