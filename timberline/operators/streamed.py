"""States that read the rows of a group in order, in little memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.ordering import with_checkpoints

#: Rows that a task gives at once.
BATCH = 10_000


def in_order(rows: DataFrame, group: Sequence[str], order: Sequence[str], mine: Callable[[Iterator[dict]], Iterator[tuple]]) -> DataFrame:
    """(group, line_id, number, template) that ``mine`` yields for the rows of each group, which it reads one by one in order.

    Rows are sorted by Spark and streamed, so that a task holds one batch and what ``mine`` keeps, however long a group is.
    The result is checkpointed, as it is read more than once."""
    group = list(group)
    with_checkpoints(rows.sparkSession)
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in group), "line_id bigint", "number bigint", "template string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        types = [*(first.schema.field(c).type for c in group), pa.int64(), pa.int64(), pa.string()]
        read = (row for batch in chain([first], batches) for row in batch.to_pylist())
        told = (t for _, of in groupby(read, lambda row: [row[c] for c in group]) for t in mine(of))
        while held := list(islice(told, BATCH)):
            columns = [pa.array([t[k] for t in held], kind) for k, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, [*group, "line_id", "number", "template"])

    return rows.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, schema).checkpoint()


def named(found: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, line_id, number, template): the lines of :func:`in_order` with the templates that their numbers have at the
    end, which are rows without a line; null where a number has none."""
    a, b = found.where("line_id is not null").alias("a"), found.where("line_id is null and number >= 0").alias("b")
    same = reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*group, "number")])
    return a.join(b, same, "left").select(*[f"a.{c}" for c in group], "a.line_id", "a.number", "b.template")
