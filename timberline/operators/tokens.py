"""Tokenisers of the template matchers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import WILDCARD

#: Characters that separate tokens, in a Java character class.
_MARKS = r"""\s!"#$%&'()+,\-/:;=?@.\[\\\]^_`{|}~"""
#: Of these, the ones that stay in a token.
_DROPPED = r"""[ !"#$%&'+,\-/:;?@.\[\\\]^_`{}~]"""


def message_split(text: Column, star_rule: bool = True, greedy: bool = True) -> Column:
    """Tokens and the separators between them, without punctuation but ``= | ( )``; variables are
    wildcards, of which no two stand together.

    ``star_rule``: a lone ``*`` is a wildcard. ``greedy``: runs of separators are one token.
    """
    parts = F.regexp_extract_all(text, F.lit(rf"[{_MARKS}]{'+' if greedy else ''}|[^{_MARKS}]+"), F.lit(0))

    def bare(t: Column) -> Column:
        wild = t.contains(WILDCARD) | (t == "*") if star_rule else t.contains(WILDCARD)
        return F.when(wild, F.lit(WILDCARD)).otherwise(F.trim(F.regexp_replace(F.regexp_replace(t, _DROPPED, ""), r"^\s+|\s+$", "")))

    found = F.filter(F.transform(parts, bare), lambda t: t != "")
    # one-element array: the tokens are bound once
    return F.transform(F.array(found), lambda a: F.filter(a, lambda t, i: ~((t == WILDCARD) & (i > 0) & (F.get(a, i - 1) == WILDCARD))))[0]


def spell_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"[\s=:,]"), lambda t: t != "")


def plain_tokens(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")


def anchors(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\S+=|\S+"), F.lit(0))


def variable_positions(tokens: Column) -> Column:
    """Places (from 0) of tokens that are or hold a variable."""
    return F.filter(F.transform(tokens, lambda t, i: F.when(t.contains(WILDCARD) | (t == "*"), i)), lambda i: i.isNotNull())
