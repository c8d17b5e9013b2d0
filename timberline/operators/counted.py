"""Counts of items looked up in rows that hold them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.ordering import with_checkpoints

#: So many of the most frequent items are sent to all tasks.
SENT = 250_000


def with_counts(rows: DataFrame, counts: DataFrame, on: Sequence[str], name: str, sent: int = SENT) -> DataFrame:
    """``rows`` with the count ``name`` of their item (``on``) from ``counts``; the result of a join of both.

    Frequent items stand in most rows: their counts are sent, so that these rows stay where they are and none of the items
    fills a task. Other items are in few rows each, which are joined by a shuffle. Frequent is what occurs ``least`` times or more,
    the lowest power of two that no more than ``sent`` items reach."""
    on = list(on)
    with_checkpoints(rows.sparkSession)
    counts = counts.select(*on, name).checkpoint()
    power = F.length(F.bin(name)) - 1
    least, held = None, 0
    for r in counts.groupBy(power.alias("power")).agg(F.count("*").alias("n")).orderBy(F.desc("power")).collect():  # 63 rows at most
        held += r["n"]
        if held > sent:
            break
        least = 2 ** r["power"]
    else:
        return rows.join(F.broadcast(counts), on)
    if least is None:
        return rows.join(counts, on)
    frequent, others = counts.where(F.col(name) >= least), counts.where(F.col(name) < least)
    rest = rows.join(F.broadcast(frequent), on, "left_anti").join(others, on)
    return rows.join(F.broadcast(frequent), on).unionByName(rest)
