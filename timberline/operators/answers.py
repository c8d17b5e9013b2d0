"""Templates from the answers of a language model: asking once, reading answers, checking them.

Answers are a table by the digest of the message that was asked about; messages that are there are never asked for
again. A template is read from an answer, gets its variables masked, and counts only if it matches the message it was made
from; where anything fails, the message itself is masked. All of it is column expressions.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.sources.versions import Versions

from .clean import WILDCARD, post_processed
from .tokens import message_split

#: What a template comes from: the answer; or the message, as it is one word, as the answer has no template, only
#: punctuation beside its variables, or one that doesn't match the message.
SOURCES = ("answer", "one word", "no template", "too general", "no match")

#: How an answer names its template.
MARK = "Log template:"


class AnswerSource(Protocol):
    """Answers messages: (message) to (message, answer). Network models are left to callers."""

    def answers(self, messages: DataFrame) -> DataFrame: ...


def answered(answer: Column) -> Column:
    """The template in an answer, null where there is none: of the first line that names a template, else of the first
    with a back-tick, what stands between the first and the last back-tick, or, where there is none, quotation mark."""
    lines = F.split(F.coalesce(answer, F.lit("")), "\n")
    named, ticked = F.filter(lines, lambda x: x.contains(MARK)), F.filter(lines, lambda x: x.contains("`"))
    line = F.when(F.size(named) > 0, F.get(named, F.lit(0))).otherwise(F.get(ticked, F.lit(0)))
    mark = F.when(line.contains("`"), F.lit("`")).otherwise(F.lit('"'))
    first = F.instr(line, F.lit("`"))
    first = F.when(first > 0, first).otherwise(F.instr(line, F.lit('"')))
    last = F.length(line) - F.instr(F.reverse(line), mark) + 1
    return F.when((first > 0) & (last > first + 1), F.substring(line, first + 1, last - first - 1))


def cache_tokens(text: Column) -> Column:
    """Tokens that a template cache compares."""
    return message_split(text, star_rule=False, greedy=False)


def fits(template: Column, tokens: Column) -> Column:
    """Whether template tokens match all tokens of a message: a wildcard takes a run of one token or more, the last one an
    empty run as well.

    The places that a prefix of the template can end at are carried from token to token; after a wildcard these are
    all places beyond the first one, so that no more than the message's length is ever held."""
    wild = F.element_at(template, -1) == WILDCARD
    body = F.when(wild, F.slice(template, F.lit(1), F.size(template) - 1)).otherwise(template)
    none = F.array().cast("array<int>")
    bound = F.struct(tokens.alias("t"), F.size(tokens).alias("n"))

    def step(at: Column, token: Column) -> Column:
        spread = F.when((F.size(at["places"]) > 0) & (F.array_min(at["places"]) < at["m"]["n"]), F.sequence(F.array_min(at["places"]) + 1, at["m"]["n"])).otherwise(none)
        exact = F.transform(F.filter(at["places"], lambda p: (p < at["m"]["n"]) & (F.get(at["m"]["t"], p) == token)), lambda p: p + 1)
        return F.struct(F.when(token == WILDCARD, spread).otherwise(exact).alias("places"), at["m"].alias("m"))

    ends = F.aggregate(body, F.struct(F.array(F.lit(0)).alias("places"), bound.alias("m")), step)["places"]
    return F.when(wild, F.size(ends) > 0).otherwise(F.array_contains(ends, F.size(tokens))) & (F.size(template) > 0)


def templates(messages: DataFrame, answers: DataFrame, message: str = "content") -> DataFrame:
    """``messages`` with ``template`` (null where even the message has nothing but variables) and ``source`` (one of SOURCES).

    ``answers``: (message, answer), one for each message; repeated messages are judged once."""
    once = messages.select(F.col(message).alias("_m")).distinct()
    read = once.join(answers.select(F.col("message").alias("_m"), "answer"), "_m", "left").withColumn("_said", answered(F.col("answer")))
    masked = read.select("_m", F.size(F.split(F.trim("_m"), r"\s+")).alias("_words"), "_said", post_processed(F.col("_said")).alias("_made"))
    # tokens are made once, and a message is masked only where its answer doesn't count
    masked = masked.select("*", cache_tokens(F.col("_made")).alias("_template"), cache_tokens(F.col("_m")).alias("_tokens"))
    matches = fits(F.col("_template"), F.col("_tokens"))
    source = (
        F.when(F.col("_words") < 2, "one word").when(F.coalesce(F.length("_said"), F.lit(0)) == 0, "no template").when(F.col("_made").isNull(), "too general")
        .when(matches, "answer").otherwise("no match")
    )
    found = masked.withColumn("source", source).select("_m", F.when(F.col("source") == "answer", F.col("_made")).otherwise(post_processed(F.col("_m"))).alias("template"), "source")
    return messages.join(found, F.col(message).eqNullSafe(F.col("_m"))).drop("_m")


def _keyed(messages: DataFrame) -> DataFrame:
    return messages.select("message", F.sha2("message", 256).alias("digest")).where("message is not null")


def asked(source: AnswerSource, messages: DataFrame, path: str) -> DataFrame:
    """(message, answer) of distinct messages (message) of two words or more, from the table of answers under ``path``.

    Only messages that it lacks are asked for; their answers and the ones that were there are its next version, so
    that a run that fails, or is repeated, asks and keeps nothing twice. A message without an answer is kept with a null."""
    kept = Versions(messages.sparkSession, path)
    at = kept.latest()
    known = kept.read("answers", at)
    wanted = _keyed(messages.where(F.size(F.split(F.trim("message"), r"\s+")) > 1).distinct())
    missing = wanted if known is None else wanted.join(known.select("digest"), "digest", "left_anti")
    if known is None or not missing.isEmpty():
        given = source.answers(missing.select("message")).groupBy("message").agg(F.min("answer").alias("answer"))
        new = missing.join(given, "message", "left").select("digest", "message", "answer")
        at = kept.commit({"answers": new if known is None else known.unionByName(new)}, at)
    return kept.read("answers", at).join(wanted.select("digest"), "digest", "left_semi").select("message", "answer")
