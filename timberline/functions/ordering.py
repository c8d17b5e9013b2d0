"""Gapless numbers in an order, without one task for all rows."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def with_checkpoints(spark: SparkSession) -> None:
    """Sets a folder for checkpoints where a local session has none; a cluster must name one that its machines share."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="timberline-"))


def numbered(rows: DataFrame, order: Sequence[str] = ("line_id",), name: str = "number") -> DataFrame:
    """``rows`` with a gapless number from 1 in the order of columns.

    Rows are sorted by ranges and checkpointed, as ranges come from a sample and must not be drawn anew;
    each row gets its partition's offset (from one count for each partition) and its place in it.
    """
    with_checkpoints(rows.sparkSession)
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_place", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    joined = placed.join(F.broadcast(before), part == F.col("_part"))
    return joined.withColumn(name, F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1).drop("_place", "_part", "_before")
