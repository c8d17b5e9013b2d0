"""Rules by collection as tables: masks, spacing and thresholds are rows.

One plan then serves any number of collections. Tables of rules are small: where their patterns are known to the plan
(:func:`read`, :func:`rewritten_by`), each is compiled once for a task. A line can also take the rules of its collection as an
array, which one expression applies in their order (:func:`with_rules`); the engine then compiles a pattern anew for every rule of every line.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.settings import LEGACY_MASKS, SETTINGS, Settings

from .clean import ANCHOR_SPACED, WILDCARD, header_pattern

#: (collection, kind, rank, pattern, replacement); patterns of a kind apply in the order of their ranks.
RULES_SQL = "dataset string, kind string, rank int, pattern string, replacement string"
RULE_LIST = "array<struct<pattern: string, replacement: string>>"

#: Thresholds that a collection sets, by their names in :class:`Settings`.
THRESHOLDS = tuple(f.name for f in fields(Settings) if f.type in ("int", "float", "bool"))

#: Literals that the positional miner spaces besides those of the collection.
POSITIONAL_SPACED = {"Proxifier": (":", ",", "(", ")")}


def spacing(literals: Sequence[str]) -> str:
    """The pattern of literals that a space is put after: those given, and commas."""
    return "(" + "|".join(re.escape(x) for x in dict.fromkeys((*literals, ","))) + ")"


def anchor_literals(dataset: str, settings: Settings) -> tuple[str, ...]:
    """After which literals the anchor miner puts spaces, besides ``=``."""
    out, more = ANCHOR_SPACED.get(dataset, ((), ()))
    return (*(x for x in settings.spaced if x not in out), *more)


def rules_of(dataset: str, settings: Settings) -> list[tuple[str, str, int, str, str]]:
    """The rows of one collection."""
    rows = [(dataset, "mask", k, p, WILDCARD) for k, p in enumerate(settings.masks)]
    rows += [(dataset, "last mask", 0, p, WILDCARD) for p in settings.masks[-1:]]
    rows += [(dataset, "removed", k, p, "") for k, p in enumerate(p for p in settings.removed if p)]
    rows += [(dataset, "legacy mask", k, p, WILDCARD) for k, p in enumerate(LEGACY_MASKS.get(dataset, ()))]
    rows.append((dataset, "spaced", 0, spacing(settings.spaced), "$1 "))
    rows.append((dataset, "positional spaced", 0, spacing((*settings.spaced, *POSITIONAL_SPACED.get(dataset, ()))), "$1 "))
    rows.append((dataset, "anchor spaced", 0, spacing((*anchor_literals(dataset, settings), "=")), "$1 "))
    return rows


def rule_table(spark: SparkSession, settings: Mapping[str, Settings] = SETTINGS) -> DataFrame:
    """All rules of the collections; a caller's own table of this form serves as well."""
    return spark.createDataFrame([r for name, own in settings.items() for r in rules_of(name, own)], RULES_SQL)


def threshold_table(spark: SparkSession, settings: Mapping[str, Settings] = SETTINGS) -> DataFrame:
    """(dataset, thresholds ...): one row for each collection."""
    kinds = {"int": "int", "float": "double", "bool": "boolean"}
    types = {f.name: kinds[f.type] for f in fields(Settings) if f.name in THRESHOLDS}
    rows = [(name, *(getattr(own, c) for c in THRESHOLDS)) for name, own in settings.items()]
    return spark.createDataFrame(rows, "dataset string, " + ", ".join(f"{c} {k}" for c, k in types.items()))


def column_of(kind: str) -> str:
    return "rules_" + kind.replace(" ", "_")


def with_rules(lines: DataFrame, rules: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """``lines`` with an array of rules for each kind (``rules_<kind>``), empty where their collection has none.

    The arrays, a row for each collection, are sent to the lines: lines joined by a shuffle would stand in one task for each collection."""
    held = rules.where(F.col("kind").isin(*kinds)).groupBy("dataset").agg(
        *[F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("rank", "pattern", "replacement")))), lambda r: F.struct(r["pattern"].alias("pattern"), r["replacement"].alias("replacement"))).alias(column_of(k)) for k in kinds]
    )
    joined = lines.join(F.broadcast(held), "dataset", "left")
    return joined.withColumns({column_of(k): F.coalesce(column_of(k), F.array().cast(RULE_LIST)) for k in kinds})


def rewritten(text: Column, *rules: Column) -> Column:
    """``text`` after every rule of the arrays, in order."""
    for own in rules:
        text = F.aggregate(own, text, lambda t, r: F.regexp_replace(t, r["pattern"], r["replacement"]))
    return text


def read(table: DataFrame | None, kinds: Sequence[str]) -> dict[str, dict[str, list[tuple[str, str]]]]:
    """{collection: {kind: [(pattern, replacement)]}} of a table of rules, in the order of their ranks; of this library's where none is given."""
    if table is None:
        rows = [r for name, own in SETTINGS.items() for r in rules_of(name, own)]
    else:
        rows = [tuple(r) for r in table.where(F.col("kind").isin(*kinds)).select("dataset", "kind", "rank", "pattern", "replacement").collect()]
    found: dict[str, dict[str, list[tuple[str, str]]]] = {}
    for dataset, kind, _, pattern, by in sorted(rows, key=lambda r: [(x is not None, x) for x in r]):
        if kind in kinds:
            found.setdefault(dataset, {}).setdefault(kind, []).append((pattern, by))
    return found


def rewritten_by(text: Column, known: Mapping[str, Mapping[str, Sequence[tuple[str, str]]]], *kinds: str, before: str = "") -> Column:
    """``text`` after every rule that its line's collection (``dataset``) has of ``kinds``, in order; ``before`` is put in front where there is one."""
    chains: dict[tuple[tuple[str, str], ...], list[str]] = {}
    for dataset, own in known.items():
        chain = tuple(rule for kind in kinds for rule in own.get(kind, ()))
        if chain and dataset is not None:
            chains.setdefault(chain, []).append(dataset)
    out = F
    for chain, names in chains.items():
        changed = F.concat(F.lit(before), text) if before else text
        for pattern, by in chain:
            changed = F.regexp_replace(changed, F.lit(pattern), F.lit(by))
        out = out.when(F.col("dataset").isin(*names), changed)
    return out.otherwise(text) if chains else text


def rewritten_after_space(text: Column, rules: Column) -> Column:
    """As the n-gram miner has it: where there is a rule, with a space before the text."""
    return F.when(F.size(rules) > 0, rewritten(F.concat(F.lit(" "), text), rules)).otherwise(text)


def header_table(spark: SparkSession, settings: Mapping[str, Settings] = SETTINGS) -> DataFrame:
    """(dataset, names, header): the fields of each collection's lines, and an anchored pattern with a group for each."""
    return spark.createDataFrame([(d, *header_pattern(own.log_format)) for d, own in settings.items()], "dataset string, names array<string>, header string")


#: Stands between the fields of a line that is split in one go; lines that hold it, or that end within, are split field by field.
_BETWEEN, _APART = "\x01", r"[\x01\n\r\u0085\u2028\u2029]"


def split_headers(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """``lines`` (dataset, line, ...) of any collections with format_ok, fields (a map by name) and content.

    A line that doesn't fit its collection's form, or has no collection, keeps its whole text as content and has no fields.
    The forms, a row for each collection, are read for the plan: a pattern is compiled once for a task, and a line matched once."""
    text, split = F.trim("line"), F
    for r in headers.collect():
        marked = "".join(f"{_BETWEEN}${k}" for k in range(1, len(r["names"]) + 1))
        split = split.when(F.col("dataset") == r["dataset"], F.regexp_replace(text, r["header"], marked))
    # the line itself is there where no header is
    split = split.otherwise(F.lit(None).cast("string")) if split is not F else F.lit(None).cast("string")
    found = lines.join(F.broadcast(headers), "dataset", "left").withColumn("_split", F.when(~F.col("line").rlike(_APART), split))
    fields = F.expr("CASE WHEN trim(line) rlike header THEN transform(names, (name, k) -> regexp_extract(trim(line), header, k + 1)) END")
    values = F.when(F.col("_split").isNull(), F.when(F.col("line").rlike(_APART), fields)).when(F.col("_split").startswith(_BETWEEN), F.slice(F.split("_split", _BETWEEN), F.lit(2), F.size("names")))
    found = found.withColumn("_values", values).withColumn("format_ok", F.col("_values").isNotNull())
    found = found.withColumn("fields", F.when(F.col("format_ok"), F.map_from_arrays("names", "_values")))
    return found.withColumn("content", F.coalesce(F.col("fields")["Content"], F.col("line"))).drop("names", "header", "_split", "_values")
