"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised, their cells are numbered along a Hilbert curve, rows are
sorted by that number, and the order is cut into runs of equal counts (law ``rows``: counts at most one
apart). Rows that are near in the dimensions land in one file, so that a file's smallest and largest
values let readers skip it by any dimension.

The dimensions are those of the *group* of equal texts (its smallest language and source, and the
text's size), so that equal texts stand next to each other. A run keeps a group together unless it ends
among its rows, which equal counts demand: at most ``count`` - 1 groups lie in more than one shard.

Quantising keeps order: a dimension is cut at values that leave about equally many groups in each cell, so
that a cell is a range of values and near values have near cells. The cuts (2 ** bits - 1 at most for each
dimension) are all that reaches the driver.

Only narrow rows are sorted; places come from counts by partition, of which there is one for each
partition. Documents are exchanged only by :func:`write`, once, to their files.

Cases: null and empty texts are one group of size 1; null dimensions count as the smallest value;
repeated rows each get a slot, in an arbitrary order among each other (:func:`write` puts them into the
first of their shards); an empty table has no slots, and no files; extra columns pass through
:func:`write`, whose folders are named by ``shard``, or by the first of ``shard_1``, ``shard_2`` ... that no
column has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import discard, staged

#: Bits of each dimension.
BITS = 4


def curve_index(dimensions: list[str], bits: int = BITS) -> Column:
    """The Hilbert index of cells: each of ``dimensions`` is SQL for a bigint below 2 ** bits.

    From the highest bit down, the rotations and reflections of the smaller cubes are undone; Gray coding
    gives the index with its bits transposed, and these are interleaved at last. One-element arrays bind
    the coordinates of each step, so that the expression grows with the steps only.
    """
    n = len(dimensions)

    def changed(new: dict[int, str]) -> str:
        return "array(" + ", ".join(new.get(k, f"x[{k}]") for k in range(n)) + ")"

    steps = []
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            low = f"((x[0] ^ x[{i}]) & {q - 1})"
            new = {0: f"if(x[{i}] & {q} > 0, x[0] ^ {q - 1}, x[0] ^ {low})"}
            if i:
                new[i] = f"if(x[{i}] & {q} > 0, x[{i}], x[{i}] ^ {low})"
            steps.append(changed(new))
    for i in range(1, n):
        steps.append(changed({i: f"x[{i}] ^ x[{i - 1}]"}))
    flips = [f"if(x[{n - 1}] & {q} > 0, {q - 1}, 0)" for q in (1 << b for b in range(bits - 1, 0, -1))]
    if flips:
        flip = "(" + " ^ ".join(flips) + ")"
        steps.append(changed({k: f"x[{k}] ^ {flip}" for k in range(n)}))
    steps.append(" | ".join(f"shiftleft(shiftright(x[{k}], {b}) & 1, {b * n + n - 1 - k})" for b in range(bits) for k in range(n)))
    sql = "array(" + ", ".join(f"cast({d} as bigint)" for d in dimensions) + ")"
    for step in steps:
        sql = f"transform(array({sql}), x -> {step})[0]"
    return F.expr(sql)


def narrow(docs: DataFrame) -> DataFrame:
    """What is known of each row: size, checksum and hash of the text, language and source."""
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
    )


def _cuts(groups: DataFrame, column: str, cells: int) -> list[tuple[int, object]]:
    """(cell, smallest value in it), in order, where cells hold about equally many groups; a value that many groups
    share may leave cells after it empty.

    Values are counted first, and their counts summed up in order, by partition and then over partitions."""
    counts = groups.groupBy(column).agg(F.count("*").alias("n")).repartitionByRange(column).sortWithinPartitions(column)
    counts = staged(counts.withColumn("place", F.monotonically_increasing_id()), "values")
    part = F.shiftright("place", 33)
    sums = counts.groupBy(part.alias("part")).agg(F.sum("n").alias("all"))
    before = sums.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))  # a row for each partition
    within = counts.withColumn("part", part).withColumn("at", F.sum("n").over(Window.partitionBy("part").orderBy("place")) - F.col("n"))
    total = max(1, groups.count())
    cell = F.expr(f"cast((before + at) * {cells} div {total} as int)")
    found = within.join(F.broadcast(before), "part").groupBy(cell.alias("cell")).agg(F.min(column).alias("least"))
    out = sorted((r["cell"], r["least"]) for r in found.collect())  # a row for each cell
    discard(counts)
    return out


def cells_of(groups: DataFrame, column: str, cells: int) -> str:
    """SQL for the cell of ``column``, from 0 to ``cells`` - 1."""

    def literal(value) -> str:
        return str(value) if isinstance(value, int) else f"decode(unhex('{value.encode().hex()}'), 'utf-8')"

    cuts = _cuts(groups, column, cells)
    return " + ".join(["0", *(f"if({column} >= {literal(v)}, {b - a}, 0)" for (a, _), (b, v) in zip(cuts, cuts[1:]))])


def shards(docs: DataFrame, count: int = 16, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, text_hash, curve, rank, shard and slot for every row."""
    rows = staged(narrow(docs), "narrow")
    group = ["text_hash", "text_crc32", "size"]
    of_group = staged(rows.groupBy(*group).agg(F.min("lang").alias("lang"), F.min("source").alias("source")), "groups")
    dimensions = [cells_of(of_group, c, 1 << bits) for c in ("lang", "source", "size")]
    curve = of_group.select(*group, curve_index(dimensions, bits).alias("curve"))
    keys = ["curve", "text_hash", "text_crc32", "size", "doc_id"]
    ordered = rows.drop("lang", "source").join(curve, group).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = staged(ordered.withColumn("place", F.monotonically_increasing_id()), "ordered")
    discard(rows, of_group)
    part = F.shiftright("place", 33)
    counts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    total = F.lit(max(1, ordered.count()))
    ranked = ordered.join(F.broadcast(before), part == F.col("part")).withColumn("rank", F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1))
    ranked = ranked.withColumn("total", total)
    ranked = ranked.withColumn("shard", F.expr(f"cast(rank * {count} div total as int)"))
    ranked = ranked.withColumn("slot", F.expr(f"rank - (shard * total + {count} - 1) div {count}"))
    return ranked.drop("place", "part", "before", "total")


def write(docs: DataFrame, path: str, count: int = 16, file_bytes: int = 128 << 20) -> str:
    """Whole rows to one folder for each shard, in slot order, under ``path``, in files of about ``file_bytes`` of
    text. Returns the name of the column that the folders stand for."""
    found = staged(shards(docs, count), "places")
    places = found.groupBy("doc_id", "text_hash").agg(F.min(F.struct("shard", "slot")).alias("at"))
    total = found.agg(F.sum("size")).first()[0] or 0
    taken = {c.lower() for c in docs.columns}
    name = next(n for n in ("shard", *(f"shard_{k}" for k in range(1, len(taken) + 2))) if n not in taken)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    keyed = docs.select(F.col("doc_id").alias("row_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_hash"), whole)
    both = keyed.join(places, F.col("row_id").eqNullSafe(F.col("doc_id")) & (F.col("row_hash") == F.col("text_hash")))
    files = max(count, -(-total // file_bytes))
    dealt = both.select("whole", "at").repartitionByRange(int(files), "at").sortWithinPartitions("at")
    out = dealt.select(*[F.col(f"whole.`{c}`") for c in docs.columns], F.col("at.shard").alias(name))
    out.write.partitionBy(name).parquet(path)
    return name
