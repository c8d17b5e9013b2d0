"""Entropy-based diversity of template groups and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clean import coarse_key, value_tokens
from .tokens import variable_positions

#: The weight of a group is its size to this power.
ALPHA = 0.5

#: Groups below this are of low diversity; at or below it, augmentation is triggered.
LOW = 0.35


def entropy_of_counts(counts: Column) -> Column:
    """Normalised entropy of an array of counts: by the logarithm of their sum; 0 for a sum of 1 or less."""
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, c: a + c)
    terms = F.aggregate(
        F.filter(counts, lambda c: c > 0), F.lit(0.0), lambda a, c: a - (c / total) * F.log(c / total)
    )
    return F.when(total <= 1, F.lit(0.0)).otherwise(F.coalesce(terms / F.nullif(F.log(total.cast("double")), F.lit(0.0)), F.lit(0.0)))


def values_at_variables(assigned: DataFrame, literals: Sequence[str] = (), template: str = "template", times: str | None = None) -> DataFrame:
    """(template, group_size, position, value): the value tokens of each line at its template's variables; ``times``:
    how many lines a row stands for.

    Positions past a line's tokens are left out. Group sizes come from a count by template, not a window.
    """
    n = F.col(times) if times else F.lit(1)
    assigned = assigned.select(template, "content", n.cast("bigint").alias("_n"))
    sizes = assigned.groupBy(template).agg(F.sum("_n").alias("group_size"))
    positions = variable_positions(F.split(F.col(template), " "))
    spread = assigned.select(template, "_n", value_tokens(F.col("content"), literals).alias("tokens"), F.explode(positions).alias("position"))
    values = spread.where(F.col("position") < F.size("tokens")).select(template, "_n", "position", F.get("tokens", F.col("position")).alias("value"))
    counts = values.groupBy(template, "position", "value").agg(F.sum("_n").alias("n"))
    return counts.join(sizes, template)


def position_scores(counts: DataFrame, template: str = "template") -> DataFrame:
    """(template, group_size, position, values, entropy, distinct_ratio) from counted values.

    p is a value's share of the values there; the entropy is normalised by the group's size.
    """
    keys = [template, "group_size", "position"]
    totals = counts.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.count("*").alias("values"), F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("nlogn")
    )
    raw = F.log(F.col("total").cast("double")) - F.col("nlogn") / F.col("total")
    entropy = F.when((F.col("group_size") <= 1) | (F.col("values") <= 1), F.lit(0.0)).otherwise(raw / F.log(F.greatest("group_size", F.lit(2)).cast("double")))
    ratio = F.when(F.col("group_size") <= 1, F.lit(0.0)).otherwise((F.col("values") - 1) / F.greatest(F.col("group_size") - 1, F.lit(1)))
    return totals.select(*keys, "values", entropy.alias("entropy"), ratio.alias("distinct_ratio"))


def summary(scores: DataFrame) -> DataFrame:
    """One row: means of entropy and distinct ratio, plain and weighted by group size, over variable positions."""
    weight = F.sum("group_size")
    return scores.agg(
        F.avg("entropy").alias("mean_entropy"),
        (F.sum(F.col("entropy") * F.col("group_size")) / weight).alias("weighted_entropy"),
        F.avg("distinct_ratio").alias("mean_ratio"),
        (F.sum(F.col("distinct_ratio") * F.col("group_size")) / weight).alias("weighted_ratio"),
        F.avg(F.col("values").cast("double")).alias("mean_values"),
        F.max("values").alias("most_values"),
        F.count("*").alias("positions"),
    )


def with_average(rows: DataFrame, key: str, numbers: Sequence[str], name: str = "AVERAGE") -> DataFrame:
    """``rows`` and one more with the means of ``numbers``."""
    mean = rows.agg(*[F.avg(c).alias(c) for c in numbers])
    return rows.select(key, *numbers).unionByName(mean.select(F.lit(name).alias(key), *numbers))


def weighted_diversity(groups: DataFrame, size: str = "group_size", score: str = "diversity", alpha: float = ALPHA) -> Column:
    """Sum of size ** alpha * score over the sum of size ** alpha, as an aggregate."""
    weight = F.pow(F.col(size).cast("double"), F.lit(alpha))
    return F.coalesce(F.sum(weight * F.col(score)) / F.nullif(F.sum(weight), F.lit(0.0)), F.lit(0.0))


def report_diversity(report: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(dataset, ground_truth_ld) of group reports: groups that are inactive or without variables score 0 but weigh."""
    scored = report.withColumn(
        "diversity", F.when((F.col("active") == 1) & (F.col("placeholder_count") > 0), entropy_of_counts(F.col("value_counts"))).otherwise(0.0)
    )
    return scored.groupBy("dataset").agg(weighted_diversity(scored, "line_budget", alpha=alpha).alias("ground_truth_ld"))


def calibration(levels: DataFrame) -> DataFrame:
    """Of (target_score, ground_truth_ld) by dataset: mean, error, mean absolute error, least, most and count by target."""
    return levels.groupBy("target_score").agg(
        F.avg("ground_truth_ld").alias("actual"),
        (F.avg("ground_truth_ld") - F.first("target_score")).alias("target_error"),
        F.avg(F.abs(F.col("ground_truth_ld") - F.col("target_score"))).alias("mean_absolute_error"),
        F.min("ground_truth_ld").alias("least"),
        F.max("ground_truth_ld").alias("most"),
        F.count("*").alias("datasets"),
    )


def estimated_groups(lines: DataFrame, literals: Sequence[str] = ()) -> DataFrame:
    """(key, group_size, diversity) of the coarse groups of contents; the mean entropy over variable positions."""
    once = lines.groupBy("content").agg(F.count("*").alias("n"))
    keyed = once.select("content", "n", coarse_key(F.col("content"), literals).alias("key"))
    sizes = keyed.groupBy("key").agg(F.sum("n").alias("group_size"))
    scores = position_scores(values_at_variables(keyed, literals, "key", "n"), "key").groupBy("key").agg(F.avg("entropy").alias("diversity"))
    return sizes.join(scores, "key", "left").select("key", "group_size", F.coalesce("diversity", F.lit(0.0)).alias("diversity"))


def low_groups(groups: DataFrame, below: float = LOW) -> DataFrame:
    """The groups that are of low diversity; a group at the bound is none."""
    return groups.where(F.col("diversity") < below)


def triggers(ld: Column, trigger: float = LOW) -> Column:
    """Whether a log of this diversity shall be augmented; at the bound it shall."""
    return ld <= trigger


def estimated_diversity(groups: DataFrame) -> DataFrame:
    """One row: global_ld, low_groups (below LOW), groups."""
    return groups.agg(
        weighted_diversity(groups).alias("global_ld"), F.sum((F.col("diversity") < LOW).cast("bigint")).alias("low_groups"), F.count("*").alias("groups")
    )


def shannon_by_position(lines: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, entropy): base-2 entropy of each position, short lines filled with ``%``, averaged over positions."""
    spread = lines.select(key, tokens.alias("tokens"))
    size = spread.groupBy(key).agg(F.max(F.size("tokens")).alias("width"), F.count("*").alias("lines"))
    held = spread.select(key, F.posexplode("tokens").alias("pos", "token")).groupBy(key, "pos", "token").agg(F.count("*").alias("n"))
    missing = held.groupBy(key, "pos").agg(F.sum("n").alias("there")).join(size, key).where("there < lines")
    filled = held.unionByName(missing.select(key, "pos", F.lit("%").alias("token"), (F.col("lines") - F.col("there")).alias("n")))
    merged = filled.groupBy(key, "pos", "token").agg(F.sum("n").alias("n")).join(size, key)
    p = F.col("n") / F.col("lines")
    return merged.groupBy(key).agg((-F.sum(p * F.log2(p)) / F.max("width")).alias("entropy"))


def varied_share(lines: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, lines, share): the share of (filled) positions with two values or more."""
    spread = lines.select(key, tokens.alias("tokens"))
    size = spread.groupBy(key).agg(F.max(F.size("tokens")).alias("width"), F.count("*").alias("lines"))
    at = spread.select(key, F.posexplode("tokens").alias("pos", "token")).groupBy(key, "pos").agg(F.count_distinct("token").alias("kinds"), F.count("*").alias("there"))
    varied = at.join(size, key).groupBy(key).agg(F.sum(((F.col("kinds") > 1) | (F.col("there") < F.col("lines"))).cast("bigint")).alias("varied"))
    return size.join(varied, key, "left").select(key, "lines", (F.coalesce("varied", F.lit(0)) / F.greatest("width", F.lit(1))).alias("share"))


def average_varied_share(shares: DataFrame, template: str = "template") -> DataFrame:
    """One row (share, templates): the mean of :func:`varied_share` over templates of several lines that have a variable, 0 where there is none.

    Templates all of whose words are in a dictionary are to be left out as well; as these have no variable, that follows."""
    held = shares.where((F.col("lines") > 1) & F.col(template).contains("*"))
    return held.agg(F.coalesce(F.avg("share"), F.lit(0.0)).alias("share"), F.count("*").alias("templates"))


def rank_within(rows: DataFrame, by: str, order: Sequence[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= most)
