"""Tables over runs: averages, missing runs, comparisons, and their sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metric_table(rows: DataFrame, key: str, numbers: Sequence[str]) -> DataFrame:
    """``rows`` and an AVERAGE row over those without an error; failed runs keep nulls and their error."""
    mean = rows.where("error is null").agg(*[F.avg(c).alias(c) for c in numbers])
    average = mean.select(F.lit("AVERAGE").alias(key), *numbers, F.lit(None).cast("string").alias("error"))
    return rows.select(key, *numbers, "error").unionByName(average)


def with_missing(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """A row for every name; those without a run say so in ``error``."""
    known = rows.withColumn("_there", F.lit(True))
    out = names.select(key).join(known, key, "left")
    return out.withColumn("error", F.when(F.col("_there").isNull(), F.lit("missing")).otherwise(F.col("error"))).drop("_there")


def scale_averages(rows: DataFrame, scale: str, numbers: Sequence[str]) -> DataFrame:
    """Means by scale, and a grand row (scale null): the mean of these means."""
    by = rows.groupBy(scale).agg(*[F.avg(c).alias(c) for c in numbers])
    grand = by.agg(*[F.avg(c).alias(c) for c in numbers]).select(F.lit(None).cast(dict(by.dtypes)[scale]).alias(scale), *numbers)
    return by.unionByName(grand)


def deltas(before: DataFrame, after: DataFrame, key: str, numbers: Sequence[str]) -> DataFrame:
    """(key, number_before, number_after, number_delta …) of runs that both sides have."""
    a = before.select(key, *[F.col(c).alias(f"{c}_before") for c in numbers])
    b = after.select(key, *[F.col(c).alias(f"{c}_after") for c in numbers])
    return a.join(b, key).withColumns({f"{c}_delta": F.col(f"{c}_after") - F.col(f"{c}_before") for c in numbers})


def merged(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace old ones with the same keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def with_diversity(rows: DataFrame, diversity: DataFrame, keys: Sequence[str], strict: bool = False) -> DataFrame:
    """Joins diversity by its keys; ``strict``: every row must find one."""
    if strict and rows.join(diversity, list(keys), "left_anti").take(1):
        raise ValueError("rows without a diversity")
    return rows.join(diversity, list(keys), "left")


def parser_averages(runs: DataFrame, level: str, numbers: Sequence[str], levels: int | None = None) -> DataFrame:
    """Means of successful runs by level, and an AVERAGE row over all runs; ``levels``: as many there must be."""
    sums = runs.rollup(level).agg(*[F.avg(c).alias(c) for c in numbers], F.count(numbers[0]).alias("runs"), F.grouping(level).alias("_all"))
    out = sums.select(F.when(F.col("_all") == 1, "AVERAGE").otherwise(F.col(level).cast("string")).alias(level), *numbers, "runs")
    if levels is not None and (found := runs.select(level).distinct().count()) != levels:
        raise ValueError(f"{found} levels, not {levels}")
    return out


def estimate_errors(rows: DataFrame, level: str, truth: str, guess: str, trigger: float = 0.35) -> DataFrame:
    """By level: how many, means of truth and estimate, the mean absolute error, and how often both are on one side of the trigger."""
    agree = ((F.col(truth) <= trigger) == (F.col(guess) <= trigger)).cast("double")
    return rows.groupBy(level).agg(
        F.count("*").alias("datasets"), F.avg(truth).alias("mean_truth"), F.avg(guess).alias("mean_estimate"), F.avg(F.abs(F.col(truth) - F.col(guess))).alias("mae"), F.avg(agree).alias("agreement")
    )


def means_transposed(rows: DataFrame, numbers: Sequence[str], digits: int = 3) -> DataFrame:
    """(measure, mean): one row for each numeric column."""
    means = rows.agg(*[F.round(F.avg(c), digits).cast("double").alias(c) for c in numbers])
    return means.unpivot([], list(numbers), "measure", "mean")


def write_lines(lines: DataFrame, path: str, order: str = "line_id", line: str = "line") -> None:
    """Text files in the order of a column: one file for each range of it, named in order."""
    lines.repartitionByRange(order).sortWithinPartitions(order).select(line).write.text(path)


def write_table(rows: DataFrame, path: str) -> None:
    """CSV with a header, in UTF-8 with a byte-order mark (it stands before the name of the first column)."""
    named = rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0])
    named.write.option("header", True).option("escape", '"').option("quoteAll", False).csv(path)
