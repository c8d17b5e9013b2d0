"""Queries over accuracy measures and the joins behind them."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.operators import metrics, miners

from .shared import MASKS, events, items, masked_sql, orders, q, rounded, split_sql, with_log


def _pair(spark, sf_dir, run=events):
    lines = run(spark, sf_dir)
    return lines.select("line_id", "template"), miners.by_mask(lines, MASKS)


def _lists(spark, sf_dir, run=events):
    truth, parsed = _pair(spark, sf_dir, run)
    return miners.template_counts(parsed), truth.select("template").distinct()


def _pa(mode, run=events):
    def query(spark, sf_dir):
        made, true = _lists(spark, sf_dir, run)
        return rounded(metrics.template_accuracy(made, true, mode))

    return query


def _cells(spark, sf_dir, run=events):
    truth, parsed = _pair(spark, sf_dir, run)
    # a parse that errs: two kinds of lines in one group, one kind in two
    parsed = parsed.join(truth.withColumnRenamed("template", "true"), "line_id")
    wrong = F.when(F.col("true").startswith("user"), F.lit("new account created for user <*>")).when(F.col("true").startswith("click") & (F.col("line_id") % 3 == 0), F.lit("click on <*>"))
    parsed = parsed.select("line_id", F.coalesce(wrong, F.col("template")).alias("template"))
    return metrics.contingency(truth, parsed)


def _p06(spark, sf_dir):
    made = miners.template_counts(miners.by_mask(events(spark, sf_dir), MASKS))
    return made.select("template", "n", metrics.complexity(F.col("template")).cast("bigint").alias("complexity"))


_PARSED = f"parsed AS (SELECT line_id, {masked_sql('content')} AS template FROM log)"
_LISTS = f"{_PARSED}, made AS (SELECT template, count(*) AS n, {split_sql('template')} AS k FROM parsed GROUP BY template), true_ AS (SELECT DISTINCT template, {split_sql('template')} AS k FROM log)"
_ERR = f"""{_PARSED}, wrong AS (SELECT l.line_id, l.template AS truth, CASE WHEN l.template LIKE 'user%' THEN 'new account created for user <*>' WHEN l.template LIKE 'click%' AND l.line_id % 3 = 0 THEN 'click on <*>' ELSE p.template END AS parsed FROM log l JOIN parsed p USING (line_id)),
cells AS (SELECT truth, parsed, count(*) AS n FROM wrong GROUP BY 1, 2),
right_ AS (SELECT c.* FROM cells c WHERE (SELECT count(*) FROM cells d WHERE d.truth = c.truth) = 1 AND (SELECT count(*) FROM cells d WHERE d.parsed = c.parsed) = 1)"""
_COUNTS = "(SELECT count(*)::DOUBLE FROM right_) AS ok, (SELECT count(DISTINCT parsed)::DOUBLE FROM cells) AS made, (SELECT count(DISTINCT truth)::DOUBLE FROM cells) AS truths"


def _pa_sql(table, pairs=False):
    hits = "sum((SELECT count(*) FROM true_ t WHERE t.k = made.k))" if pairs else "count(*) FILTER (k IN (SELECT k FROM true_))"
    return with_log(
        table,
        f"{_LISTS} SELECT round((SELECT sum(CASE WHEN k IN (SELECT k FROM true_) THEN n ELSE 0 END)::DOUBLE / sum(n) FROM made), 6)::DOUBLE AS pa, round((SELECT {hits}::DOUBLE / count(*) FROM made), 6)::DOUBLE AS pta, round((SELECT (count(*) FILTER (k IN (SELECT k FROM made)))::DOUBLE / count(*) FROM true_), 6)::DOUBLE AS rta",
    )


QUERIES = {
    "a15_rta_orders": (_pa("entries", orders), _pa_sql("log_orders")),
    "a17_grouping_f1": (
        lambda spark, sf_dir: rounded(metrics.grouping_accuracy(_cells(spark, sf_dir))),
        with_log("log_events", f"{_ERR}, s AS (SELECT {_COUNTS}) SELECT round((SELECT sum(n) FROM right_)::DOUBLE / (SELECT sum(n) FROM cells), 6)::DOUBLE AS ga, round(ok / made, 6)::DOUBLE AS pga, round(ok / truths, 6)::DOUBLE AS rga, round(2 * (ok / made) * (ok / truths) / (ok / made + ok / truths), 6)::DOUBLE AS fga FROM s"),
    ),
    "a17b_grouping_share": (
        lambda spark, sf_dir: rounded(metrics.grouping_accuracy(_cells(spark, sf_dir), ratio_of_truth=True)),
        with_log("log_events", f"{_ERR}, s AS (SELECT {_COUNTS}) SELECT round((SELECT sum(n) FROM right_)::DOUBLE / (SELECT sum(n) FROM cells), 6)::DOUBLE AS ga, round(ok / made, 6)::DOUBLE AS pga, round(ok / truths, 6)::DOUBLE AS rga, round(ok / truths, 6)::DOUBLE AS fga FROM s"),
    ),
    "a18_line_accuracy": (
        lambda spark, sf_dir: rounded(metrics.line_accuracy(*_pair(spark, sf_dir, items))),
        with_log("log_items", f"SELECT round(avg((template = {masked_sql('content')})::INT), 6)::DOUBLE AS pa FROM log"),
    ),
    "a19_template_level": (
        lambda spark, sf_dir: rounded(metrics.template_level(_cells(spark, sf_dir))),
        with_log("log_events", f"{_ERR}, good AS (SELECT parsed FROM wrong GROUP BY parsed HAVING count(DISTINCT truth) = 1 AND min(truth) = parsed), s AS (SELECT (SELECT count(*)::DOUBLE FROM good) AS ok, (SELECT count(DISTINCT parsed)::DOUBLE FROM wrong) AS made, (SELECT count(DISTINCT truth)::DOUBLE FROM wrong) AS truths) SELECT round(ok / made, 6)::DOUBLE AS pta, round(ok / truths, 6)::DOUBLE AS rta, round(CASE WHEN ok = 0 THEN 0 ELSE 2 * (ok / made) * (ok / truths) / (ok / made + ok / truths) END, 6)::DOUBLE AS fta FROM s"),
    ),
    "j01_matched_templates": (
        lambda spark, sf_dir: (lambda made, true: metrics._keyed(made).join(metrics._keyed(true).select("_key"), "_key", "left_semi").select("template", "n"))(*_lists(spark, sf_dir)),
        with_log("log_events", f"{_LISTS} SELECT template, n FROM made WHERE k IN (SELECT k FROM true_)"),
    ),
    "j02_contingency": (
        lambda spark, sf_dir: _cells(spark, sf_dir).select("truth", "parsed", "n"),
        with_log("log_events", f"{_ERR} SELECT truth, parsed, n FROM cells"),
    ),
    "p06_complexity": (
        _p06,
        with_log("log_events", f"{_PARSED} SELECT template, count(*) AS n, (CASE WHEN len(regexp_extract_all(template, {q('<[*]>')})) = 0 THEN 1 WHEN len(regexp_extract_all(template, {q('<[*]>')})) <= 4 THEN 2 ELSE 3 END)::BIGINT AS complexity FROM parsed GROUP BY template"),
    ),
}
