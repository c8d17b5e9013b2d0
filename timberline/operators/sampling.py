"""Sampling of log lines and distances between them."""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.ordering import with_checkpoints

from .clean import shape, signature
from .counted import with_counts

# Words that never stand for a line.
STOP_WORDS = (
    "a an and i ie so to the "
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday Mon Tue Wed Thu Fri Sat Sun "
    "January February March April May June July August September October November December "
    "Jan Feb Mar Apr Jun Jul Aug Sep Oct Nov Dec"
).split()


def top_tokens(lines: DataFrame, tokens: Column, k: int = 3) -> DataFrame:
    """(line_id, rank, token): of each line's distinct tokens of three characters or more, but stop words, the
    ``k`` most frequent of the whole log (how often they occur); ties in the order of the alphabet."""
    kept = F.filter(tokens, lambda t: (F.length(t) > 2) & ~t.isin(STOP_WORDS))
    counts = lines.select(F.explode(kept).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    found = with_counts(lines.select("line_id", F.explode(F.array_distinct(kept)).alias("token")), counts, ["token"], "n")
    # a dense rank, as several rows may have one line_id: as the limit stands in the filter, only a line's best tokens are sent on
    rank = F.dense_rank().over(Window.partitionBy("line_id").orderBy(F.desc("n"), "token"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("line_id", "rank", "token").distinct()


def clusters(lines: DataFrame) -> DataFrame:
    """(line_id, coarse, fine): by the three top tokens of the cleaned line, then by its special characters."""
    chars, words = signature(F.col("content"))
    base = lines.select("line_id", chars.alias("fine"), words.alias("text"))
    top = top_tokens(base, F.split("text", " ")).groupBy("line_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda s: s["token"]), " ").alias("coarse"))
    return base.select("line_id", "fine").join(top, "line_id", "left").select("line_id", F.coalesce("coarse", F.lit("")).alias("coarse"), "fine")


def quotas(groups: DataFrame, shots: int, order: Sequence[Column]) -> DataFrame:
    """Adds quota: ``shots`` dealt over groups, one more for the first ones."""
    numbered = groups.withColumn("_k", F.row_number().over(Window.orderBy(*order)) - 1)  # one row for each group
    n = groups.count()
    return numbered.withColumn("quota", F.lit(shots // max(1, n)) + (F.col("_k") < shots % max(1, n)).cast("int")).drop("_k")


def levenshtein_ratio(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def _tally(tokens: Column) -> Column:
    return F.transform(F.array_distinct(tokens), lambda t: F.struct(t.alias("t"), F.size(F.filter(tokens, lambda x: x == t)).alias("n")))


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Shared tokens over all, counted with repeats."""
    shared = F.aggregate(
        _tally(a), F.lit(0), lambda s, x: s + F.least(x["n"], F.size(F.filter(b, lambda y: y == x["t"])))
    )
    return shared / F.greatest(F.size(a) + F.size(b) - shared, F.lit(1))


def hamming(a: Column, b: Column) -> Column:
    """Places that differ, and the difference of lengths."""
    differ = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x != y, F.lit(False))), lambda d: d))
    return differ + F.abs(F.size(a) - F.size(b))


def cosine(a: Column, b: Column) -> Column:
    """Shared tokens (with repeats) over the geometric mean of the numbers of tokens."""
    shared = F.aggregate(_tally(a), F.lit(0), lambda s, x: s + F.least(x["n"], F.size(F.filter(b, lambda y: y == x["t"]))))
    return F.coalesce(shared / F.nullif(F.sqrt(F.size(a) * F.size(b).cast("double")), F.lit(0.0)), F.lit(0.0))


def matching_blocks_ratio(pairs: DataFrame, a: str, b: str, name: str = "similarity") -> DataFrame:
    """Adds twice the letters in matching blocks over all letters: the longest common block, and so on to its left
    and right. For distinct pairs, as it runs in Python."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, s, t, autojunk=False).ratio() for s, t in zip(x, y, strict=True)], dtype=float)

    return pairs.withColumn(name, ratio(F.col(a), F.col(b)))


def _items(rows: DataFrame, id_: str, text: str, size: str) -> DataFrame:
    """(id, size, item): a text's tokens with the number of their occurrence, so that a multiset is a set."""
    words = rows.select(id_, F.split(text, " ").alias("w")).select(id_, F.size("w").alias(size), F.posexplode("w").alias("pos", "token"))
    nth = F.row_number().over(Window.partitionBy(id_, "token").orderBy("pos"))  # one text's tokens
    return words.select(id_, size, F.struct("token", nth.alias("nth")).alias("item"))


def _ranked_examples(pairs: DataFrame, k: int) -> DataFrame:
    like = pairs.withColumn("similarity", F.round(F.col("both") / (F.col("sa") + F.col("sb") - F.col("both")), 6))
    rank = F.row_number().over(Window.partitionBy("template").orderBy(F.desc("similarity"), "line_id"))
    return like.withColumn("rank", rank).where(F.col("rank") <= k).select("template", "line_id", "rank", "similarity")


def similar_examples(asked: DataFrame, examples: DataFrame, k: int, probes: int = 2) -> DataFrame:
    """(template, line_id, rank, similarity): for each template of ``asked`` the ``k`` distinct contents of ``examples``
    (line_id, content) with the greatest multiset Jaccard similarity above 0, by the first line that has them.

    Templates and contents meet by items (tokens with the number of their occurrence), rare ones first: contents that share
    one of a template's ``probes`` rarest items give a bound, the k-th best similarity among them. What reaches the bound s shares s of
    the template's items, and so one of its (1 - s) rarest ones and one more; only these are joined. Common words meet nothing but
    where a template's bound leaves no other way."""
    once = examples.groupBy("content").agg(F.min("line_id").alias("line_id"))
    with_checkpoints(examples.sparkSession)
    theirs = _items(once, "line_id", "content", "sb").checkpoint()
    often = theirs.groupBy("item").agg(F.count("*").alias("freq"))
    ours = _items(asked.select("template").distinct(), "template", "template", "sa").join(often, "item", "left")
    # items that no content has come first: they count as rare, and meet nothing
    ours = ours.withColumn("place", F.row_number().over(Window.partitionBy("template").orderBy(F.coalesce("freq", F.lit(0)), "item"))).checkpoint()
    sets = ours.groupBy("template", "sa").agg(F.collect_list("item").alias("mine"))
    held = theirs.groupBy("line_id", "sb").agg(F.collect_list("item").alias("items"))

    def met(some: DataFrame) -> DataFrame:
        """Templates and contents that share one of ``some`` items, with all that they share."""
        found = some.select("template", "item").join(theirs.select("line_id", "item"), "item").select("template", "line_id").distinct()
        both = F.size(F.array_intersect("mine", "items")).alias("both")
        return found.join(sets, "template").join(held, "line_id").select("template", "line_id", "sa", "sb", both)

    known = ours.where("freq is not null").withColumn("nth", F.row_number().over(Window.partitionBy("template").orderBy("place")))
    bound = _ranked_examples(met(known.where(F.col("nth") <= probes)), k).where(F.col("rank") == k).select("template", (F.col("similarity") - 1e-6).alias("bound"))
    near = ours.join(bound, "template", "left").where(F.col("place") <= F.col("sa") - F.ceil(F.greatest(F.coalesce("bound", F.lit(0.0)), F.lit(0.0)) * F.col("sa")) + 1)
    return _ranked_examples(met(near.where("freq is not null")), k)


def shape_clusters(lines: DataFrame, event: str, most: int) -> DataFrame:
    """(event, line_id) of the first ``most`` distinct contents in each event's largest cluster of equal coarse shapes
    (of equals, the one that comes first)."""
    shaped = lines.select(event, "line_id", "content", shape(F.col("content")).alias("shape"))
    sizes = shaped.groupBy(event, "shape").agg(F.count("*").alias("n"), F.min("line_id").alias("first"))
    best = sizes.groupBy(event).agg(F.max(F.struct("n", (-F.col("first")).alias("early"), "shape")).alias("b")).select(event, F.col("b.shape").alias("shape"))
    once = shaped.join(best, [event, "shape"]).groupBy(event, "content").agg(F.min("line_id").alias("line_id"))
    rank = F.row_number().over(Window.partitionBy(event).orderBy("line_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= most).select(event, "line_id")


def unknown_groups(assigned: DataFrame) -> DataFrame:
    """(template, n) of groups of (template, content) with one line, or with equal lines only."""
    groups = assigned.groupBy("template").agg(F.count("*").alias("n"), F.min("content").alias("_low"), F.max("content").alias("_high"))
    return groups.where("n = 1 or _low = _high").select("template", "n")


def adaptive_sample(lines: DataFrame, k: int, candidates: int | None = 128, seed: int = 1) -> DataFrame:
    """(rank, line_id, content, gap) of ``k`` lines that lie far apart, of all distinct contents of a log.

    The first is the longest by words (then the most frequent, then the first by line number). Each next one is, of the contents that are
    left, the one whose multiset Jaccard distance to the nearest one chosen (``gap``) is the greatest; of equals the most frequent,
    then the first. ``candidates``: only so many contents take part in a draw, those with the smallest hashes of content, draw and seed; None: all.

    Contents stay in the table: a pick is one aggregate, whose one row reaches the driver. With all contents as
    candidates, each carries its least distance from pick to pick, which is cut by a checkpoint now and then."""
    once = lines.groupBy("content").agg(F.min("line_id").alias("line_id"), F.count("*").alias("n")).select("*", F.split(F.trim("content"), r"\s+").alias("words"))
    with_checkpoints(lines.sparkSession)
    rows = once.withColumn("gap", F.lit(2.0)).checkpoint()
    first = rows.agg(F.max(F.struct(F.size("words").alias("size"), "n", (-F.col("line_id")).alias("early"), "content", "words")).alias("x")).first()["x"]
    if first is None:
        return lines.sparkSession.createDataFrame([], "rank bigint, line_id bigint, content string, gap double")
    chosen = [(1, -first["early"], first["content"], None)]
    picks = [first["words"]]
    while len(chosen) < k:
        taken = [c[2] for c in chosen]
        rest = rows.where(~F.col("content").isin(taken))
        new = picks if candidates is not None else picks[-1:]
        apart = [1 - multiset_jaccard(F.col("words"), F.array(*[F.lit(w) for w in words])) for words in new]
        if candidates is not None:
            rest = rest.orderBy(F.xxhash64("content", F.lit(len(chosen)), F.lit(seed)), "content").limit(candidates)
        least = F.least(F.col("gap"), *apart)
        rest = rest.withColumn("gap", F.round(least, 12))
        if candidates is None:
            rows = rest.checkpoint() if len(chosen) % 8 == 0 else rest
        best = rest.agg(F.max(F.struct("gap", "n", (-F.col("line_id")).alias("early"), "content", "words")).alias("x")).first()["x"]
        if best is None:
            break
        chosen.append((len(chosen) + 1, -best["early"], best["content"], best["gap"]))
        picks.append(best["words"])
    return lines.sparkSession.createDataFrame(chosen, "rank bigint, line_id bigint, content string, gap double")
