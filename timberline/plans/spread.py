"""Queries over diversity measures and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.operators import diversity

from .shared import SPACED, events, normal_sql, orders, positions_sql, rounded, tokens_sql, with_log


def _scores(spark, sf_dir, run=events):
    return diversity.position_scores(diversity.values_at_variables(run(spark, sf_dir).select("template", "content"), SPACED))


def _report(spark, sf_dir):
    """Group reports made of the events of each user: the counts of event types."""
    lines = events(spark, sf_dir).select((F.col("line_id") % 16).alias("dataset"), (F.col("line_id") % 5).alias("active"), "template", F.length("content").alias("value"))
    counts = lines.groupBy("dataset", "template", "value").agg(F.count("*").alias("n"), F.max("active").alias("active"))
    groups = counts.groupBy("dataset", "template").agg(F.sort_array(F.collect_list("n")).alias("value_counts"), F.sum("n").alias("line_budget"), F.count_distinct("value").alias("kinds"))
    return groups.select(F.concat(F.lit("set"), F.col("dataset").cast("string")).alias("dataset"), "value_counts", "line_budget", F.when(F.col("template").startswith("click"), 0).otherwise(1).alias("active"), F.when(F.col("template").startswith("new"), 0).otherwise(2).alias("placeholder_count"))


def _levels(spark, sf_dir):
    found = diversity.report_diversity(_report(spark, sf_dir))
    return found.withColumn("target_score", (F.substring("dataset", 4, 3).cast("int") % 3 + 6) / 10.0)


def _a12(spark, sf_dir):
    return rounded(diversity.estimated_diversity(diversity.estimated_groups(events(spark, sf_dir), SPACED)))


def _a07(spark, sf_dir):
    rows = diversity.varied_share(events(spark, sf_dir).select("template", "content"), "template", F.split("content", " "))
    return rounded(rows)


def _a07_average(spark, sf_dir):
    # templates of one line, and ones without a variable, are among them
    lines = events(spark, sf_dir).selectExpr("CASE line_id % 5 WHEN 0 THEN concat(template, ' of ', cast(line_id as string)) WHEN 1 THEN replace(template, '<*>', 'x') ELSE template END AS template", "content")
    return rounded(diversity.average_varied_share(diversity.varied_share(lines, "template", F.split("content", " "))))


_VALUES = f"""sizes AS (SELECT template, count(*) AS gs FROM log GROUP BY template),
spread AS (SELECT template, {tokens_sql('content')} AS toks, unnest({positions_sql("string_split(template, ' ')")}) AS pos FROM log),
counts AS (SELECT template, pos, toks[pos + 1] AS v, count(*) AS n FROM spread WHERE pos < len(toks) GROUP BY 1, 2, 3),
totals AS (SELECT template, pos, sum(n) AS total, count(*) AS kinds FROM counts GROUP BY 1, 2),
scores AS (SELECT c.template, c.pos, any_value(gs) AS gs, any_value(kinds) AS kinds,
  CASE WHEN any_value(gs) <= 1 OR any_value(kinds) <= 1 THEN 0 ELSE -sum(n / total::DOUBLE * ln(n / total::DOUBLE)) / ln(any_value(gs)) END AS entropy,
  CASE WHEN any_value(gs) <= 1 THEN 0 ELSE (any_value(kinds) - 1)::DOUBLE / (any_value(gs) - 1) END AS ratio
  FROM counts c JOIN totals t ON c.template = t.template AND c.pos = t.pos JOIN sizes s ON c.template = s.template GROUP BY c.template, c.pos)"""

_GROUPS = f"""keyed AS (SELECT content, array_to_string({tokens_sql(normal_sql('content'))}, ' ') AS key FROM log),
sizes AS (SELECT key, count(*) AS gs FROM keyed GROUP BY key),
spread AS (SELECT key, {tokens_sql('content')} AS toks, unnest({positions_sql("string_split(key, ' ')")}) AS pos FROM keyed),
counts AS (SELECT key, pos, toks[pos + 1] AS v, count(*) AS n FROM spread WHERE pos < len(toks) GROUP BY 1, 2, 3),
ent AS (SELECT c.key, c.pos, CASE WHEN any_value(gs) <= 1 OR count(*) <= 1 THEN 0 ELSE -sum(n::DOUBLE / t * ln(n::DOUBLE / t)) / ln(any_value(gs)) END AS e FROM (SELECT *, sum(n) OVER (PARTITION BY key, pos) AS t FROM counts) c JOIN sizes USING (key) GROUP BY c.key, c.pos),
groups AS (SELECT s.key, gs AS group_size, coalesce(avg(e), 0) AS diversity FROM sizes s LEFT JOIN ent USING (key) GROUP BY s.key, gs)"""

_REPORT = """counts AS (SELECT line_id % 16 AS d, template, length(content) AS v, count(*) AS n FROM log GROUP BY 1, 2, 3),
groups AS (SELECT 'set' || d AS dataset, template, sum(n) AS lines, CASE WHEN sum(n) <= 1 OR template LIKE 'click%' OR template LIKE 'new%' THEN 0 ELSE ln(sum(n)) - sum(n * ln(n)) / sum(n) END AS h FROM counts GROUP BY d, template),
ld AS (SELECT dataset, sum(sqrt(lines) * CASE WHEN lines <= 1 THEN 0 ELSE h / ln(lines) END) / sum(sqrt(lines)) AS ld FROM groups GROUP BY dataset)"""

QUERIES = {
    "a03_position_entropies": (
        lambda spark, sf_dir: rounded(_scores(spark, sf_dir).select("template", F.col("position").cast("bigint").alias("position"), "entropy")),
        with_log("log_events", f"{_VALUES} SELECT template, pos::BIGINT AS position, round(entropy, 6)::DOUBLE AS entropy FROM scores"),
    ),
    "a04_entropy_of_counts": (
        lambda spark, sf_dir: rounded(_report(spark, sf_dir).groupBy("dataset").agg(F.avg(diversity.entropy_of_counts(F.col("value_counts"))).alias("entropy"))),
        with_log("log_events", "counts AS (SELECT line_id % 16 AS d, template, length(content) AS v, count(*) AS n FROM log GROUP BY 1, 2, 3), g AS (SELECT d, template, CASE WHEN sum(n) <= 1 THEN 0 ELSE (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(sum(n)) END AS e FROM counts GROUP BY 1, 2) SELECT 'set' || d AS dataset, round(avg(e), 6)::DOUBLE AS entropy FROM g GROUP BY d"),
    ),
    "a05_shannon_by_position": (
        lambda spark, sf_dir: rounded(diversity.shannon_by_position(events(spark, sf_dir).select("template", "content"), "template", F.split("content", " "))),
        with_log("log_events", "t AS (SELECT template, string_split(content, ' ') AS w FROM log), s AS (SELECT template, max(len(w)) AS width, count(*) AS lines FROM t GROUP BY 1), p AS (SELECT t.template, i, CASE WHEN i <= len(w) THEN w[i] ELSE '%' END AS tok, width, lines FROM t JOIN s USING (template), unnest(range(1, width + 1)) r(i)), c AS (SELECT template, i, tok, any_value(width) AS width, count(*)::DOUBLE / any_value(lines) AS p FROM p GROUP BY 1, 2, 3) SELECT template, round(-sum(p * log2(p)) / any_value(width), 6)::DOUBLE AS entropy FROM c GROUP BY template"),
    ),
    "a06_distinct_ratios": (
        lambda spark, sf_dir: rounded(_scores(spark, sf_dir).select("template", F.col("position").cast("bigint").alias("position"), "distinct_ratio")),
        with_log("log_events", f"{_VALUES} SELECT template, pos::BIGINT AS position, round(ratio, 6)::DOUBLE AS distinct_ratio FROM scores"),
    ),
    "a07_average": (
        _a07_average,
        with_log(
            "log_events",
            "r AS (SELECT CASE line_id % 5 WHEN 0 THEN template || ' of ' || line_id WHEN 1 THEN replace(template, '<*>', 'x') ELSE template END AS template, string_split(content, ' ') AS w FROM log), "
            "s AS (SELECT template, count(*) AS n, max(len(w)) AS width FROM r GROUP BY 1 HAVING count(*) > 1 AND contains(template, '*')), "
            "k AS (SELECT template, i, count(DISTINCT coalesce(w[i], '%')) AS kinds FROM r JOIN s USING (template), unnest(range(1, width + 1)) u(i) GROUP BY 1, 2) "
            "SELECT round(coalesce(avg(share), 0), 6)::DOUBLE AS share, count(*) AS templates FROM (SELECT template, count(*) FILTER (kinds > 1) / count(*)::DOUBLE AS share FROM k GROUP BY 1) x",
        ),
    ),
    "a07_varied_share": (
        _a07,
        with_log("log_events", "t AS (SELECT template, string_split(content, ' ') AS w FROM log), s AS (SELECT template, max(len(w)) AS width, count(*) AS lines FROM t GROUP BY 1), p AS (SELECT t.template, i, count(DISTINCT CASE WHEN i <= len(w) THEN w[i] ELSE '%' END) AS kinds FROM t JOIN s USING (template), unnest(range(1, width + 1)) r(i) GROUP BY 1, 2) SELECT s.template, any_value(lines) AS lines, round((count(*) FILTER (kinds > 1))::DOUBLE / any_value(width), 6)::DOUBLE AS share FROM p JOIN s USING (template) GROUP BY s.template"),
    ),
    "a08_summary": (
        lambda spark, sf_dir: rounded(diversity.summary(_scores(spark, sf_dir))),
        with_log("log_events", f"{_VALUES} SELECT round(avg(entropy), 6)::DOUBLE AS mean_entropy, round(sum(entropy * gs) / sum(gs), 6)::DOUBLE AS weighted_entropy, round(avg(ratio), 6)::DOUBLE AS mean_ratio, round(sum(ratio * gs) / sum(gs), 6)::DOUBLE AS weighted_ratio, round(avg(kinds), 6)::DOUBLE AS mean_values, max(kinds) AS most_values, count(*) AS positions FROM scores"),
    ),
    "a09_with_average": (
        lambda spark, sf_dir: rounded(diversity.with_average(_scores(spark, sf_dir).groupBy("template").agg(F.avg("entropy").alias("entropy"), F.avg("distinct_ratio").alias("ratio")), "template", ["entropy", "ratio"])),
        with_log("log_events", f"{_VALUES}, m AS (SELECT template, avg(entropy) AS entropy, avg(ratio) AS ratio FROM scores GROUP BY 1) SELECT template, round(entropy, 6)::DOUBLE AS entropy, round(ratio, 6)::DOUBLE AS ratio FROM m UNION ALL SELECT 'AVERAGE', round(avg(entropy), 6)::DOUBLE, round(avg(ratio), 6)::DOUBLE FROM m"),
    ),
    "a10_report_diversity": (lambda spark, sf_dir: rounded(diversity.report_diversity(_report(spark, sf_dir))), with_log("log_events", f"{_REPORT} SELECT dataset, round(ld, 6)::DOUBLE AS ground_truth_ld FROM ld")),
    "a11_calibration": (
        lambda spark, sf_dir: rounded(diversity.calibration(_levels(spark, sf_dir))),
        with_log("log_events", f"{_REPORT}, t AS (SELECT *, (substr(dataset, 4, 3)::INT % 3 + 6) / 10.0::DOUBLE AS target FROM ld) SELECT round(target, 6)::DOUBLE AS target_score, round(avg(ld), 6)::DOUBLE AS actual, round(avg(ld) - target, 6)::DOUBLE AS target_error, round(avg(abs(ld - target)), 6)::DOUBLE AS mean_absolute_error, round(min(ld), 6)::DOUBLE AS least, round(max(ld), 6)::DOUBLE AS most, count(*) AS datasets FROM t GROUP BY target"),
    ),
    "a12_estimated_diversity": (_a12, with_log("log_events", f"{_GROUPS} SELECT round(sum(sqrt(group_size) * diversity) / sum(sqrt(group_size)), 6)::DOUBLE AS global_ld, (count(*) FILTER (diversity < 0.35))::BIGINT AS low_groups, count(*) AS groups FROM groups")),
}
