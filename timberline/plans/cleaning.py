"""Queries over header splitting, cleaning and tokenising."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.operators import clean, tokens

from .shared import MASKS, SPACED, events, items, masked_sql, normal_sql, orders, positions_sql, q, spaced_sql, split_sql, texts, tokens_sql, with_log

_FORMAT = "<Date> <Time> <Level> <Component>: <Content>"
_HEAD = r"^(.*?)\s+(.*?)\s+(.*?)\s+(.*?):\s+(.*?)$"


def _over(name, run, columns):
    """A query that adds ``columns`` (name: expression) to line_id of a log."""
    return lambda spark, sf_dir: run(spark, sf_dir).select("line_id", *[c.alias(n) for n, c in columns().items()])


def _t01(spark, sf_dir):
    found = clean.split_header(events(spark, sf_dir), _FORMAT)
    return found.select("line_id", "Date", "Time", "Level", "Component", F.col("Content").alias("body"), "format_ok")


def _t02(spark, sf_dir):
    mixed = events(spark, sf_dir).select("line_id", F.when(F.col("line_id") % 7 == 0, F.col("content")).otherwise(F.col("line")).alias("line"))
    found = clean.split_header(mixed, _FORMAT)
    return found.groupBy("Level").agg(F.count("*").alias("n"), F.sum((~F.col("format_ok")).cast("bigint")).alias("failed"), F.max(F.length("Content")).cast("bigint").alias("longest"))


def _t03(spark, sf_dir):
    mixed = events(spark, sf_dir).select("line_id", F.when(F.col("line_id") % 7 == 0, F.col("content")).otherwise(F.col("line")).alias("line"))
    return clean.split_header(mixed, _FORMAT, keep_failures=False).select("line_id", "number", F.col("Component").alias("component"))


def _t23(spark, sf_dir):
    return events(spark, sf_dir).select("template").distinct().select("template", clean.template_id(F.col("template")).alias("event_id"))


def _t32(spark, sf_dir):
    words = events(spark, sf_dir).select(F.explode(F.split("line", " ")).alias("word"))
    typed = words.select(F.coalesce(clean.variable_type(F.col("word")), F.lit("none")).alias("kind"), clean.is_variable(F.col("word")).alias("varies"))
    return typed.groupBy("kind", "varies").agg(F.count("*").alias("n"))


_MIXED = "mixed AS (SELECT line_id, CASE WHEN line_id % 7 = 0 THEN content ELSE line END AS line FROM log)"
_SKELETON_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({t}), '\b\d{4}-\d{2}-\d{2}\b', '<DATE>', 'g'), '\b\d{2}:\d{2}:\d{2}(?:[,.]\d+)?\b', '<TIME>', 'g'), '\bblk_-?\d+\b', 'blk_<NUM>', 'g'), '(\d+\.){3}\d+(?::\d+)?', '<IP>', 'g'), '\b\d+(?:\.\d+)?\b', '<NUM>', 'g'), '\s+', ' ', 'g'))"
_STRIPPED = """regexp_replace(w, '^[\\[\\](),;:''"]+|[\\[\\](),;:''"]+$', '', 'g')"""

QUERIES = {
    "t01_header_fields": (
        _t01,
        with_log("log_events", f"SELECT line_id, regexp_extract(line, {q(_HEAD)}, 1) AS \"Date\", regexp_extract(line, {q(_HEAD)}, 2) AS \"Time\", regexp_extract(line, {q(_HEAD)}, 3) AS \"Level\", regexp_extract(line, {q(_HEAD)}, 4) AS \"Component\", regexp_extract(line, {q(_HEAD)}, 5) AS body, true AS format_ok FROM log"),
    ),
    "t02_header_failures": (
        _t02,
        with_log("log_events", f"{_MIXED}, split AS (SELECT *, regexp_matches(line, {q(_HEAD)}) AS ok FROM mixed) SELECT CASE WHEN ok THEN regexp_extract(line, {q(_HEAD)}, 3) END AS \"Level\", count(*) AS n, (count(*) FILTER (NOT ok))::BIGINT AS failed, max(length(CASE WHEN ok THEN regexp_extract(line, {q(_HEAD)}, 5) ELSE line END))::BIGINT AS longest FROM split GROUP BY 1"),
    ),
    "t03_header_numbered": (
        _t03,
        with_log("log_events", f"{_MIXED} SELECT line_id, row_number() OVER (ORDER BY line_id) AS number, regexp_extract(line, {q(_HEAD)}, 4) AS component FROM mixed WHERE regexp_matches(line, {q(_HEAD)})"),
    ),
    "t05_ascii_only": (
        _over("t05", texts, lambda: {"text": clean.ascii_only(F.col("content"))}),
        with_log("log_text", r"SELECT line_id, regexp_replace(content, '[^\x00-\x7F]+', '<NASCII>', 'g') AS text FROM log"),
    ),
    "t06_masks": (_over("t06", events, lambda: {"text": clean.masked(F.col("content"), MASKS)}), with_log("log_events", f"SELECT line_id, {masked_sql('content')} AS text FROM log")),
    "t07_last_mask": (
        _over("t07", orders, lambda: {"text": clean.last_masked(F.col("content"), (r"\d+ pending", r"\b\d+\b"))}),
        with_log("log_orders", r"SELECT line_id, regexp_replace(' ' || content, '\b\d+\b', '<*>', 'g') AS text FROM log"),
    ),
    "t08_removed": (
        _over("t08", orders, lambda: {"text": clean.without(F.col("content"), (r"\(.*?\)", "", r"customer:? "))}),
        with_log("log_orders", r"SELECT line_id, regexp_replace(regexp_replace(content, '\(.*?\)', '', 'g'), 'customer:? ', '', 'g') AS text FROM log"),
    ),
    "t09_spaced": (_over("t09", events, lambda: {"text": clean.spaced(F.col("line"), SPACED)}), with_log("log_events", f"SELECT line_id, {spaced_sql('line')} AS text FROM log")),
    "t11_anchor_text": (
        _over("t11", events, lambda: {"text": clean.anchor_text(F.col("content"), (r"blk_\d+",), (), (":",))}),
        with_log(
            "log_events",
            f"spaced AS (SELECT line_id, trim(regexp_replace({spaced_sql(masked_sql('content', (r'blk_[0-9]+',)), (':', '='))}, ' +', ' ', 'g')) AS s FROM log) "
            "SELECT line_id, array_to_string(list_transform(string_split(s, ' '), lambda t: CASE WHEN contains(t, '<*>') OR (length(regexp_replace(t, '[^0-9]', '', 'g')) > 0 AND length(regexp_replace(t, '[^0-9]', '', 'g'))::DOUBLE / length(t) >= 0.3::DOUBLE) OR length(regexp_replace(t, '[^/]', '', 'g')) >= 3 THEN '<*>' ELSE t END), ' ') AS text FROM spaced",
        ),
    ),
    "t12_value_tokens": (
        _over("t12", events, lambda: {"tokens": F.array_join(clean.value_tokens(F.col("line"), SPACED), "|"), "n": F.size(clean.value_tokens(F.col("line"), SPACED)).cast("bigint")}),
        with_log("log_events", f"SELECT line_id, array_to_string({tokens_sql('line')}, '|') AS tokens, len({tokens_sql('line')})::BIGINT AS n FROM log"),
    ),
    "t14_normalised": (_over("t14", items, lambda: {"text": clean.normalised(F.col("content"))}), with_log("log_items", f"SELECT line_id, {normal_sql('content')} AS text FROM log")),
    "t15_coarse_keys": (
        lambda spark, sf_dir: events(spark, sf_dir).groupBy(clean.coarse_key(F.col("content"), SPACED).alias("key")).agg(F.count("*").alias("n")),
        with_log("log_events", f"SELECT array_to_string({tokens_sql(normal_sql('content'))}, ' ') AS key, count(*) AS n FROM log GROUP BY 1"),
    ),
    "t16_message_split": (
        _over("t16", events, lambda: {"tokens": F.array_join(tokens.message_split(F.concat_ws(" ", "template", "line")), "|")}),
        with_log("log_events", f"SELECT line_id, array_to_string({split_sql('template || chr(32) || line')}, '|') AS tokens FROM log"),
    ),
    "t17_single_separators": (
        _over("t17", events, lambda: {"tokens": F.array_join(tokens.message_split(F.concat_ws(" ", "template", "line"), star_rule=False, greedy=False), "|")}),
        with_log("log_events", f"SELECT line_id, array_to_string({split_sql('template || chr(32) || line', False, False)}, '|') AS tokens FROM log"),
    ),
    "t18_spell_tokens": (
        _over("t18", events, lambda: {"tokens": F.array_join(tokens.spell_tokens(F.col("line")), "|")}),
        with_log("log_events", r"SELECT line_id, array_to_string(list_filter(regexp_split_to_array(line, '[\s=:,]'), lambda t: t <> ''), '|') AS tokens FROM log"),
    ),
    "t19_plain_tokens": (
        _over("t19", texts, lambda: {"n": F.size(tokens.plain_tokens(F.col("content"))).cast("bigint")}),
        with_log("log_text", r"SELECT line_id, len(string_split(trim(regexp_replace(content, '\s+', ' ', 'g')), ' '))::BIGINT AS n FROM log"),
    ),
    "t20_anchors": (
        _over("t20", events, lambda: {"tokens": F.array_join(tokens.anchors(F.col("content")), "|")}),
        with_log("log_events", r"SELECT line_id, array_to_string(regexp_extract_all(content, '\S+=|\S+'), '|') AS tokens FROM log"),
    ),
    "t21_variable_positions": (
        lambda spark, sf_dir: events(spark, sf_dir).select("template").distinct().select("template", F.explode(tokens.variable_positions(F.split("template", " ")).cast("array<bigint>")).alias("position")),
        with_log("log_events", f"SELECT template, unnest({positions_sql('string_split(template, chr(32))')})::BIGINT AS position FROM (SELECT DISTINCT template FROM log) t"),
    ),
    "t23_template_ids": (_t23, with_log("log_events", "SELECT DISTINCT template, substr(md5(template), 1, 8) AS event_id FROM log")),
    "t27_signatures": (
        lambda spark, sf_dir: events(spark, sf_dir).select(*[c.alias(n) for n, c in zip(("chars", "words"), clean.signature(F.col("line")), strict=True)]).groupBy("chars", "words").agg(F.count("*").alias("n")),
        with_log(
            "log_events",
            r"""SELECT array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(line, '[0-9A-Za-z, ]+', '', 'g'), ''), lambda c: c <> ''))), '') AS chars,
 array_to_string(list_filter(regexp_split_to_array(trim(regexp_replace(line, ':|\(|\)|=|,|"|\{|\}|@|\[|\]|\||;|\.?!', ' ', 'g')), '\s+'), lambda w: NOT regexp_matches(w, '\d')), ' ') AS words, count(*) AS n FROM log GROUP BY 1, 2""",
        ),
    ),
    "t29_skeletons": (
        lambda spark, sf_dir: events(spark, sf_dir).groupBy(clean.skeleton(F.col("content")).alias("skeleton")).agg(F.count("*").alias("n")),
        with_log("log_events", f"SELECT {_SKELETON_SQL.replace('{t}', 'content')} AS skeleton, count(*) AS n FROM log GROUP BY 1"),
    ),
    "t31_shapes": (
        lambda spark, sf_dir: orders(spark, sf_dir).groupBy(clean.shape(F.col("content")).alias("shape")).agg(F.count("*").alias("n")),
        with_log("log_orders", r"SELECT trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '([0-9_])-\d+(?:\.\d+)?\b', '\1NUM', 'g'), '\b\d+(?:\.\d+)?\b', 'NUM', 'g'), '[A-Za-z_][A-Za-z0-9_.$-]*', 'WORD', 'g'), '\s+', ' ', 'g')) AS shape, count(*) AS n FROM log GROUP BY 1"),
    ),
    "t32_variable_types": (
        _t32,
        with_log(
            "log_events",
            f"words AS (SELECT unnest(string_split(line, ' ')) AS w FROM log), bare AS (SELECT w, {_STRIPPED} AS t FROM words) "
            r"SELECT CASE WHEN t = '' THEN 'none' WHEN contains(t, '<*>') OR t = '*' THEN 'placeholder' WHEN regexp_matches(t, '\d+\.\d+\.\d+\.\d+') THEN 'ip' WHEN regexp_matches(t, '^-\d+$') THEN 'negative' WHEN regexp_matches(t, '^\+?\d+$') THEN 'positive' WHEN regexp_matches(t, '^\d{2}:\d{2}:\d{2}$') THEN 'time' WHEN starts_with(t, '/') THEN 'path' WHEN contains(t, '://') THEN 'url' ELSE 'none' END AS kind, "
            r"(w = '' OR contains(w, '<*>') OR w = '*' OR regexp_matches(w, '\d+\.\d+\.\d+\.\d+') OR contains(w, '://') OR regexp_matches(w, '^-?\d+$') OR regexp_matches(w, '^\d{2}:\d{2}:\d{2}$') OR starts_with(w, '/')) AS varies, count(*) AS n FROM bare GROUP BY 1, 2",
        ),
    ),
}
