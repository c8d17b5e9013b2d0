"""Logs in Chinese: cutting text into words by a dictionary, and positional mining over these.

A run of Chinese characters is cut along the best path through the graph of the dictionary's words in it: the product of
the words' shares is the greatest; a character that begins no word stands for itself and counts as seen once. Words are
found by a join of the runs' substrings with the dictionary, so that it may be of any size; each distinct run is cut once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import miners
from .clean import WILDCARD

# Characters of Chinese runs and of the other ones.
HAN = r"[一-鿿　-〿！-／：-＠［-｀｛-･℃]+"
OTHER = r"""[a-zA-Z0-9\s!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]+"""

# Fixed values: (pattern, replacement) that unify commas and brackets, and cut sections whose text varies, in order.
UNIFIED = ((",", "，"), (r"[（({｛【\[]", "<"), (r"[）)}｝】\]]", ">"))
SECTIONS = (
    (r"(?s)(虚拟机列表：).*", "$1*"),
    (r"(?s)(具体原因如下：).*", "$1*"),
    (r"(?s)(请尽快按照下列方式进行处理：).*", "$1*"),
    (r"(?s)(请联系供应商进行技术支持。).*", "$1*"),
    (r"(?s)(请做以下检查：).*", "$1*"),
    (r"(?s)(建议： ).*", "$1*"),
    (r"(?s)(请检查： ).*", "$1*"),
    (r"(?s)(可能原因\d+：).*", "*"),
)

#: Stands for white space inside lists of tokens that are put together with spaces.
_BLANK = "␣"


def alarm_text(text: Column, masks: Sequence[str] = (), removed: Sequence[str] = ()) -> Column:
    """Unified, with masks as ``*``, without delimiters, and with sections cut."""
    for pattern, by in UNIFIED:
        text = F.regexp_replace(text, pattern, by)
    for pattern in masks:
        text = F.regexp_replace(text, pattern, "*")
    for pattern in removed:
        text = F.regexp_replace(text, pattern, "")
    for pattern, by in SECTIONS:
        text = F.regexp_replace(text, pattern, by)
    return text


def cut(runs: DataFrame, dictionary: DataFrame, longest: int = 16) -> DataFrame:
    """(run, words) of distinct runs (run) by a dictionary (word, freq); words beyond ``longest`` characters are not sought."""
    once = runs.select("run").where(F.length("run") > 0).distinct()
    known = dictionary.where((F.col("freq") > 0) & F.length("word").between(1, longest)).groupBy("word").agg(F.max("freq").alias("freq"))
    whole = known.agg(F.log(F.greatest(F.sum("freq"), F.lit(1)).cast("double")).alias("total"))
    starts = once.select("run", F.explode(F.sequence(F.lit(0), F.length("run") - 1)).alias("at"))
    spans = starts.select("run", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run") - F.col("at")))).alias("size"))
    spans = spans.withColumn("word", F.substring(F.col("run"), F.col("at") + 1, F.col("size")))
    found = spans.join(known, "word").select("run", "at", "size", F.log(F.col("freq").cast("double")).alias("share"))
    alone = starts.select("run", "at", F.lit(1).alias("size"), F.lit(0.0).alias("share"))
    edges = found.unionByName(alone).groupBy("run", "at", "size").agg(F.max("share").alias("share"))
    by_place = edges.groupBy("run", "at").agg(F.collect_list(F.struct("size", "share")).alias("edges"))
    graph = by_place.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "edges"))), lambda x: x["edges"]).alias("graph")).crossJoin(F.broadcast(whole))  # one row
    # from the right: for each place the best score and where its word ends; of equals the longest word
    ends = F.array(F.struct(F.lit(0.0).alias("score"), F.length("run").alias("end")))

    def best(done: Column, edges: Column) -> Column:
        at = F.length("run") - F.size(done)
        return F.array_max(F.transform(edges, lambda e: F.struct((e["share"] - F.col("total") + F.get(done, e["size"] - 1)["score"]).alias("score"), (at + e["size"]).alias("end"))))

    route = F.aggregate(F.reverse("graph"), ends, lambda done, edges: F.concat(F.array(best(done, edges)), done))
    none = F.array().cast("array<string>")
    walk = F.aggregate(
        F.sequence(F.lit(0), F.length("run") - 1),
        F.struct(F.lit(0).alias("next"), none.alias("words")),
        lambda s, i: F.when(i == s["next"], F.struct(F.get(F.col("route"), i)["end"].alias("next"), F.concat(s["words"], F.array(F.substring(F.col("run"), i + 1, F.get(F.col("route"), i)["end"] - i))).alias("words"))).otherwise(s),
    )["words"]
    return graph.withColumn("route", route).select("run", walk.alias("words"))


def _parts(text: Column) -> Column:
    """Chinese runs and other ones; characters of neither kind are left out."""
    return F.regexp_extract_all(text, F.lit(f"{HAN}|{OTHER}"), F.lit(0))


def _others(part: Column) -> Column:
    """Blanks, words, and stars apart from what stands around them but in some endings of words."""
    pieces = F.regexp_extract_all(part, F.lit(r"\s|\S+"), F.lit(0))
    whole = lambda p: p.contains("f*") | p.contains("_*") | p.contains("s*")
    return F.flatten(F.transform(pieces, lambda p: F.when(whole(p), F.array(p)).otherwise(F.regexp_extract_all(p, F.lit(r"\*|[^*]+"), F.lit(0)))))


def tokens(texts: DataFrame, dictionary: DataFrame, longest: int = 16) -> DataFrame:
    """(text, tokens) of distinct texts (text)."""
    once = texts.select("text").distinct()
    parts = once.select("text", F.posexplode_outer(_parts(F.col("text"))).alias("pos", "part"))
    han = F.col("part").rlike(f"^{HAN}$")
    words = cut(parts.where(han).select(F.col("part").alias("run")), dictionary, longest)
    joined = parts.join(words, F.col("part") == F.col("run"), "left")
    own = F.coalesce("words", F.when(F.col("part").isNotNull(), _others(F.col("part"))), F.array().cast("array<string>"))
    rows = joined.select("text", "pos", own.alias("own"))
    return rows.groupBy("text").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "own"))), lambda x: x["own"])).alias("tokens"))


def brain(lines: DataFrame, dictionary: DataFrame, masks: Sequence[str] = (), removed: Sequence[str] = (), threshold: int = 4, digits_vary: bool = False, key: Sequence[str] = ()) -> DataFrame:
    """(key, line_id, template) by positional mining over words: wildcards are ``*``, templates have no spaces put in.

    Tokens with a percent sign or a star, and numbers, are variable; slashes make none."""
    own = lines.select(*key, "line_id", alarm_text(F.col("content"), masks, removed).alias("text"))
    cut_ = tokens(own, dictionary).select("text", F.array_join(F.transform("tokens", lambda t: F.regexp_replace(t, r"\s", _BLANK)), " ").alias("content"))
    rows = own.join(cut_, "text").select(*key, "line_id", "content")

    def varies(t: Column) -> Column:
        return t.contains("%") | t.contains("*") | t.rlike(r"^-?\d+$")

    found = miners.brain(rows, threshold=threshold, digits_vary=digits_vary, key=key, text=F.col("content"), variable=varies)
    put = F.transform(F.split("template", " "), lambda t: F.when(t == WILDCARD, "*").when(t == _BLANK, " ").otherwise(t))
    return found.select(*key, "line_id", F.array_join(put, "").alias("template"))
