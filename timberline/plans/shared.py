"""What the query modules share: log tables, masks, and SQL for common steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.sources.synth import log, log_sql

#: Masks of the generic template miner, in a form that both engines' patterns share.
MASKS = (r"blk_\d+", r"(\d+\.){3}\d+", r"/[A-Za-z0-9_/]+", r"\b\d+\b")

#: After which literals the value tokens of these logs are split.
SPACED = (":", "=")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir, "log_events")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir, "log_orders")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir, "log_items")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir, "log_text")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places."""
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def with_log(name: str, rest: str, alias: str = "log") -> str:
    """A query over one log table."""
    return f"WITH {alias} AS ({log_sql(name)}\n), {rest}" if rest.lstrip().lower().startswith("with ") is False and " AS (" in rest.split("SELECT", 1)[0] else f"WITH {alias} AS ({log_sql(name)}\n)\n{rest}"


def q(text: str) -> str:
    """A SQL string."""
    return "'" + text.replace("'", "''") + "'"


def masked_sql(text: str, masks=MASKS, by: str = "<*>") -> str:
    for m in masks:
        text = f"regexp_replace({text}, {q(m)}, {q(by)}, 'g')"
    return text


def spaced_sql(text: str, literals=SPACED) -> str:
    import re

    any_of = "|".join(re.escape(x) for x in dict.fromkeys((*literals, ",")))
    return f"regexp_replace({text}, {q('(' + any_of + ')')}, '\\1 ', 'g')"


def tokens_sql(text: str, literals=SPACED) -> str:
    return f"list_filter(string_split(regexp_replace({spaced_sql(text, literals)}, ' +', ' ', 'g'), ' '), lambda t: t <> '')"


def normal_sql(text: str) -> str:
    """The eight variable forms without look-behind or back-references."""
    doubles = "|".join(f"{c}{c}alpha" for c in "abcdefghijklmnopqrstuvwxyz")
    steps = (
        (rf"\b({doubles})\b", "<*>"),
        (r"\bblk_-?\d+\b", "<*>"),
        (r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?\b", "<*>"),
        (r"\b[\w-]+(?:\.[\w-]+){2,}(?::\d+)?\b", "<*>"),
        (r"\b[\w-]+\.\d+(?:\.\d+)*\b", "<*>"),
        (r"\b0x[0-9a-fA-F]+\b", "<*>"),
        (r"(/[\w.\-]+)+", "<*>"),
        (r"([0-9_])-\d+(?:\.\d+)?\b", r"\1<*>"),
        (r"\b\d+(?:\.\d+)?\b", "<*>"),
    )
    for pattern, by in steps:
        text = f"regexp_replace({text}, {q(pattern)}, {q(by)}, 'g')"
    return text


_SEPS = r"""\s!"#$%&'()+,\-/:;=?@.\[\\\]^_`{|}~"""


def split_sql(text: str, star_rule: bool = True, greedy: bool = True) -> str:
    """message_split."""
    star = " OR t = '*'" if star_rule else ""
    drop = r"""[ !"#$%&'+,\-/:;?@.\[\\\]^_`{}~]"""
    parts = f"regexp_extract_all({text}, {q('[' + _SEPS + ']' + ('+' if greedy else '') + '|[^' + _SEPS + ']+')})"
    bare = f"list_transform({parts}, lambda t: CASE WHEN contains(t, '<*>'){star} THEN '<*>' ELSE trim(regexp_replace(t, {q(drop)}, '', 'g'), E' \\t\\n\\r') END)"
    found = f"list_filter({bare}, lambda t: t <> '')"
    return f"list_transform([{found}], lambda a: list_filter(a, lambda t, i: NOT (t = '<*>' AND i > 1 AND a[i - 1] = '<*>')))[1]"


def positions_sql(tokens: str) -> str:
    """Places (from 0) of variables."""
    return f"list_filter(list_transform({tokens}, lambda t, i: CASE WHEN contains(t, '<*>') OR t = '*' THEN i - 1 END), lambda i: i IS NOT NULL)"
