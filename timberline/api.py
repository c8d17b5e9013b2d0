"""Running miners on logs of collections, each with its collection's rules and thresholds."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.operators import cache, clean, metrics, miners, online, rules
from timberline.settings import SETTINGS, Settings


#: The rules of each collection, as :func:`rules.read` gives them.
Known = Mapping[str, Mapping[str, Sequence[tuple[str, str]]]]


def _plain(lines: DataFrame, key: Sequence[str], known: Known) -> DataFrame:
    text = rules.rewritten_by(F.col("content"), known, "mask")
    return lines.select(*key, "line_id", text.alias("template"))


def _positional(lines: DataFrame, key: Sequence[str], known: Known) -> DataFrame:
    text = clean.one_spaced(rules.rewritten_by(F.col("content"), known, "mask", "removed", "positional spaced"))
    return miners.brain(lines, threshold=F.col("brain_threshold"), digits_vary=F.col("digits_vary"), key=[*key, "brain_threshold", "digits_vary"], text=text)


def _ngram(lines: DataFrame, key: Sequence[str], known: Known) -> DataFrame:
    text = rules.rewritten_by(F.col("content"), known, "last mask", before=" ")
    set_by = ["bigram_threshold", "trigram_threshold"]
    return miners.logram(lines, bigram_threshold=F.col(set_by[0]), trigram_threshold=F.col(set_by[1]), key=[*key, *set_by], text=text)


def _anchor_text(content: Column, known: Known, *kinds: str) -> Column:
    return clean.anchor_tokens(rules.rewritten_by(content, known, *kinds, "anchor spaced"))


def _anchor(lines: DataFrame, key: Sequence[str], known: Known) -> DataFrame:
    text = _anchor_text(F.col("content"), known, "mask", "removed")
    return miners.by_anchors(lines, threshold=F.col("anchor_threshold"), key=[*key, "anchor_threshold"], text=text)


def _normalised_anchor(lines: DataFrame, key: Sequence[str], known: Known) -> DataFrame:
    text = _anchor_text(clean.normalised(F.col("content")), known)
    found = miners.by_anchors(lines, threshold=F.col("anchor_threshold"), key=[*key, "anchor_threshold"], text=text).withColumnRenamed("template", "group")
    own = lines.select(*key, "line_id", "content").join(found.select(*key, "line_id", "group"), [*key, "line_id"])
    groups = own.select("content", F.struct(*key, "group").alias("of"))
    made = miners.consensus(groups, "of").select(*[F.col(f"of.{c}").alias(c) for c in (*key, "group")], "template")
    return own.join(made, [*key, "group"]).select(*key, "line_id", "template")


def _tree(lines: DataFrame, key: Sequence[str], known: Known) -> DataFrame:
    text = rules.rewritten_by(F.col("content"), known, "mask")
    return online.drain(lines, depth="drain_depth", similarity="drain_similarity", key=[*key, "drain_depth", "drain_similarity"], text=text)


def _subsequence(lines: DataFrame, key: Sequence[str], known: Known) -> DataFrame:
    return online.spell(lines, tau="spell_tau", key=[*key, "spell_tau"], text=rules.rewritten_by(F.col("content"), known, "mask"))


def _cache(lines: DataFrame, key: Sequence[str], known: Known) -> DataFrame:
    own = lines.withColumn("_log", F.to_json(F.struct(*key)))
    found = cache.cached(own, key="_log", keep_key=True)
    return own.select("_log", "line_id", *key).join(found.withColumnRenamed("cache", "_log"), ["_log", "line_id"]).select(*key, "line_id", "template")


#: name: (lines with line_id, content and thresholds; key; rules) to (key, line_id, template).
MINERS: dict[str, Callable[[DataFrame, Sequence[str], Known], DataFrame]] = {
    "mask": _plain,
    "positional": _positional,
    "ngram": _ngram,
    "anchor": _anchor,
    "anchor-normalised": _normalised_anchor,
    "tree": _tree,
    "subsequence": _subsequence,
    "cache": _cache,
}

_KINDS = ("mask", "last mask", "removed", "positional spaced", "anchor spaced")


def configured(lines: DataFrame, rule_table: DataFrame | None = None, thresholds: DataFrame | None = None) -> DataFrame:
    """``lines`` (dataset, ...) with the rules and thresholds of their collection, as columns; lines of collections
    without thresholds are left out. Both tables are this library's where none are given."""
    spark = lines.sparkSession
    rule_table = rules.rule_table(spark) if rule_table is None else rule_table
    thresholds = rules.threshold_table(spark) if thresholds is None else thresholds
    return rules.with_rules(lines, rule_table, _KINDS).join(F.broadcast(thresholds), "dataset")


def contents(lines: DataFrame, dataset: str) -> DataFrame:
    """(line_id, content) of raw lines (line_id, line); lines that don't have the form keep their whole text."""
    return clean.split_header(lines, SETTINGS[dataset].log_format).select("line_id", F.col("Content").alias("content"))


def mine_all(lines: DataFrame, miner: str, datasets: Sequence[str] | None = None, key: Sequence[str] = ("dataset",), rule_table: DataFrame | None = None, thresholds: DataFrame | None = None) -> DataFrame:
    """(key, line_id, template) of lines (key, line_id, content) of any number of collections, in one plan.

    ``key`` tells logs apart (such as level and dataset) and holds ``dataset``, which decides on rules and thresholds;
    line numbers may meet between logs. ``datasets``: only these."""
    own = lines if datasets is None else lines.where(F.col("dataset").isin(*datasets))
    thresholds = rules.threshold_table(lines.sparkSession) if thresholds is None else thresholds
    # a row for each collection: lines stay where they are
    own = own.select(*key, "line_id", "content").join(F.broadcast(thresholds), "dataset")
    return MINERS[miner](own, list(key), rules.read(rule_table, _KINDS)).select(*key, "line_id", "template")


def mine(lines: DataFrame, miner: str, dataset: str) -> DataFrame:
    """(line_id, template) of (line_id, content) by one of MINERS."""
    return mine_all(lines.select(F.lit(dataset).alias("dataset"), "line_id", "content"), miner).select("line_id", "template")


def evaluate_all(lines: DataFrame, standard: DataFrame, names: Sequence[str], datasets: Sequence[str] | None = None, key: Sequence[str] = ("dataset",), rule_table: DataFrame | None = None, thresholds: DataFrame | None = None) -> DataFrame:
    """(miner, key, pa, pta, rta): a row for each miner and log, of lines (key, line_id, content) and standard templates
    (key, template). The plan grows with the miners, not with logs or collections."""
    key = list(key)
    known = standard if datasets is None else standard.where(F.col("dataset").isin(*datasets))
    rows = []
    for name in names:
        made = mine_all(lines, name, datasets, key, rule_table, thresholds).groupBy(*key, "template").agg(F.count("*").alias("n"))
        rows.append(metrics.template_accuracy(made, known, key=key).select(F.lit(name).alias("miner"), *key, "pa", "pta", "rta"))
    return reduce(DataFrame.unionByName, rows)


def evaluate(lines: DataFrame, standard: DataFrame, miner: str, dataset: str) -> DataFrame:
    """One row: miner, dataset, pa, pta, rta against standard templates (template)."""
    own = lines.select(F.lit(dataset).alias("dataset"), "line_id", "content")
    return evaluate_all(own, standard.select(F.lit(dataset).alias("dataset"), "template"), [miner])
