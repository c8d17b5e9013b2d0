"""Predicates on templates and sentences."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clean import WILDCARD


def english(text: Column) -> Column:
    """Latin letters and white space only."""
    return text.rlike(r"^[A-Za-z\s]+$")


def parts_of_words(text: Column) -> Column:
    """Words, and the parts of those in camel case, in lower case."""
    spread = F.regexp_replace(text, r"([a-z])([A-Z])", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", text, spread)), r"[^a-z]+"), lambda w: w != ""))


def meaningful(rows: DataFrame, dictionary: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of which a word, or a part of one, is in the dictionary (word)."""
    words = rows.select(key, F.explode(parts_of_words(F.col(text))).alias("word"))
    return rows.join(words.join(dictionary.select("word").distinct(), "word", "left_semi").select(key).distinct(), key, "left_semi")


def entropy_level(groups: DataFrame, threshold: float = 0.35) -> Column:
    """high for single lines, none for templates without variables, else medium or high by entropy."""
    return F.when(groups["n"] == 1, "high").when(~groups["template"].contains(WILDCARD), "none").when(groups["entropy"] <= threshold, "medium").otherwise("high")


def is_abstract(general: str, special: str) -> bool:
    """Whether a template, its wildcards standing for runs without white space, fits another."""
    pattern = r"(\S+?)".join(re.sub(r"(?:\\\s)+", r"\\s+", re.escape(p)) for p in general.split(WILDCARD))
    return re.fullmatch(pattern, special) is not None


def abstracts(pairs: DataFrame, general: str, special: str, name: str = "abstract") -> DataFrame:
    """Adds a boolean to distinct pairs of templates."""
    @F.pandas_udf("boolean")
    def test(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([is_abstract(x, y) for x, y in zip(a, b, strict=True)])

    return pairs.withColumn(name, test(F.col(general), F.col(special)))


def round_robin(lines: DataFrame, key: str, kinds: int, copies: int) -> DataFrame:
    """For each key ``copies`` lines that go round its first ``kinds`` distinct contents (by line_id)."""
    firsts = lines.groupBy(key, "content").agg(F.min("line_id").alias("first"))
    # the limit stands in the filter, so that only the first contents of a key in each partition are sent on
    rank = F.row_number().over(Window.partitionBy(key).orderBy("first"))
    ranked = firsts.withColumn("rank", rank).where(F.col("rank") <= kinds).withColumn("k", F.col("rank") - 1)
    sizes = ranked.groupBy(key).agg(F.count("*").alias("kinds"))
    slots = sizes.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("k", F.pmod(F.col("slot"), F.col("kinds")).cast("int"))
    return slots.join(ranked.select(key, F.col("k").cast("int").alias("k"), "content"), [key, "k"]).select(key, "slot", "content")


def joined_again(text: Column) -> Column:
    """Undoes spacing: no space after an opening mark, an equals sign, a colon in front of a digit, or before a comma."""
    t = F.regexp_replace(text, r"([(\[=_]) ", "$1")
    t = F.regexp_replace(t, r" ([,)\]])", "$1")
    return F.regexp_replace(t, r": (?=\d)", ":")


# Fixed values: (collections, pattern, replacement) that put spaced tokens of a collection together again, in order.
JOINED = (
    (("HealthApp",), r"\s*\|\s*", "|"),
    (("HealthApp",), r"(\d{2}):\s+(\d{2}):\s+(\d{2})", "$1:$2:$3"),
    (("Hadoop",), "_ ", "_"),
    (("Android", "BGL", "Proxifier"), r"\( ", "("),
    (("Android", "BGL", "Proxifier"), r" \)", ")"),
    (("BGL",), r"\.\. ", ".."),
    (("HealthApp", "Android", "HPC", "BGL", "Hadoop", "Linux", "Thunderbird", "Windows", "Zookeeper"), "= ", "="),
    (("Windows",), r"\[ ", "["),
    (("Windows",), r" \]", "]"),
)


def detokenized(text: Column, dataset: str) -> Column:
    """Undoes the spacing of a collection's tokens; of other collections nothing changes."""
    for names, pattern, by in JOINED:
        text = F.regexp_replace(text, pattern, by) if dataset in names else text
    return text
