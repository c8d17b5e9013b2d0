"""Queries over reports and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.operators import classify, diversity, metrics, miners, reports, sampling

from .shared import MASKS, SPACED, events, masked_sql, orders, positions_sql, q, rounded, texts, tokens_sql, with_log


def _runs(spark, sf_dir):
    """A run for each of 12 data sets: failed ones have an error."""
    rows = orders(spark, sf_dir).select((F.col("line_id") % 12).alias("dataset"), F.length("content").alias("n"))
    by = rows.groupBy("dataset").agg((F.avg("n") / 50).alias("pa"), F.max("n").cast("double").alias("pta"))
    failed = F.col("dataset") % 5 == 4
    return by.select(F.concat(F.lit("d"), F.col("dataset").cast("string")).alias("dataset"), *[F.when(~failed, F.col(c)).alias(c) for c in ("pa", "pta")], F.when(failed, "failed").alias("error"))


def _e04(spark, sf_dir):
    return rounded(reports.metric_table(_runs(spark, sf_dir), "dataset", ["pa", "pta"]))


def _e02(spark, sf_dir):
    names = spark.range(15).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("dataset"))
    return rounded(reports.with_missing(_runs(spark, sf_dir), names, "dataset").select("dataset", "pa", "pta", "error"))


def _e03(spark, sf_dir):
    rows = orders(spark, sf_dir).select((F.col("line_id") % 8 + 1).alias("scale"), F.length("content").cast("double").alias("pa"))
    return rounded(reports.scale_averages(rows, "scale", ["pa"]))


def _j07(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    after = runs.where("dataset != 'd3'").withColumn("pa", F.col("pa") * 1.5)
    return rounded(reports.deltas(runs, after, "dataset", ["pa"]))


def _j05(spark, sf_dir):
    runs = _runs(spark, sf_dir).select("dataset", "pa")
    ld = spark.range(0, 12, 2).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("dataset"), (F.col("id") / 10).alias("ld"))
    return rounded(reports.with_diversity(runs, ld, ["dataset"]))


def _k06(spark, sf_dir):
    runs = _runs(spark, sf_dir).select("dataset", "pa")
    new = runs.where("dataset in ('d1', 'd2')").withColumn("pa", F.lit(0.5))
    return rounded(reports.merged(runs, new, ["dataset"]))


def _p13(spark, sf_dir):
    lines = events(spark, sf_dir)
    scores = diversity.position_scores(diversity.values_at_variables(lines.select("template", "content"), SPACED)).groupBy("template").agg(F.avg("entropy").alias("entropy"))
    groups = lines.groupBy("template").agg(F.count("*").alias("n")).join(scores, "template", "left").withColumn("entropy", F.round(F.coalesce("entropy", F.lit(0.0)), 6))
    return groups.select("template", "n", classify.entropy_level(groups, 0.8).alias("level"))


def _t37(spark, sf_dir):
    rows = texts(spark, sf_dir).select("line_id", "content")
    dictionary = spark.createDataFrame([("the",), ("of",), ("license",)], "word string")
    return classify.meaningful(rows, dictionary, "line_id", "content").select("line_id", classify.english(F.col("content")).alias("english"))


def _b09(spark, sf_dir):
    made = classify.round_robin(events(spark, sf_dir), "template", 3, 8)
    return made.select("template", F.col("slot").cast("bigint").alias("slot"), "content")


def _t34(spark, sf_dir):
    from timberline.operators.clean import spaced

    return events(spark, sf_dir).select("line_id", classify.joined_again(spaced(F.col("content"), ("=", "("))).alias("text"))


#: Collections by line, and spaced lines with something for each of their rules.
_SETS = ("HealthApp", "Hadoop", "Android", "BGL", "Proxifier", "HPC", "Windows", "Zookeeper", "Spark")
_SET = "CASE line_id % 9 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_SETS)) + " END"
_SPREAD = "content || ' | 12: 03: 44 part_ 1 f( a ) to.. b= c [ d ] |e'"


def _t34d(spark, sf_dir):
    rows = events(spark, sf_dir).selectExpr("line_id", f"{_SET} AS dataset", f"{_SPREAD} AS t")
    return rows.select("line_id", "dataset", F.coalesce(*[F.when(F.col("dataset") == d, classify.detokenized(F.col("t"), d)) for d in _SETS]).alias("text"))


_SPREAD_T = f"spread AS (SELECT line_id, {_SET} AS dataset, {_SPREAD} AS t FROM log)"
_ROUND, _EQUALS = "replace(replace({}, '( ', '('), ' )', ')')", "replace({}, '= ', '=')"
_DETOKENIZED = f"""CASE dataset WHEN 'HealthApp' THEN {_EQUALS.format(r"regexp_replace(regexp_replace(t, '\s*[|]\s*', '|', 'g'), '(\d{2}):\s+(\d{2}):\s+(\d{2})', '\1:\2:\3', 'g')")}
 WHEN 'Hadoop' THEN {_EQUALS.format("replace(t, '_ ', '_')")} WHEN 'Android' THEN {_EQUALS.format(_ROUND.format('t'))} WHEN 'BGL' THEN {_EQUALS.format(f"replace({_ROUND.format('t')}, '.. ', '..')")}
 WHEN 'Proxifier' THEN {_ROUND.format('t')} WHEN 'Windows' THEN replace(replace({_EQUALS.format('t')}, '[ ', '['), ' ]', ']') WHEN 'Spark' THEN t ELSE {_EQUALS.format('t')} END"""


def _p06b(spark, sf_dir):
    made = miners.template_counts(miners.by_mask(texts(spark, sf_dir), (r"\b\d+\b",)))
    return made.groupBy(metrics.complexity(F.col("template")).cast("bigint").alias("complexity")).agg(F.sum("n").alias("n"), F.count("*").alias("templates"))


_RUNS = "runs AS (SELECT 'd' || line_id % 12 AS dataset, CASE WHEN line_id % 12 % 5 <> 4 THEN avg(length(content)) / 50 END AS pa, CASE WHEN line_id % 12 % 5 <> 4 THEN max(length(content))::DOUBLE END AS pta, CASE WHEN line_id % 12 % 5 = 4 THEN 'failed' END AS error FROM log GROUP BY line_id % 12)"

QUERIES = {
    "e02_missing_runs": (_e02, with_log("log_orders", f"{_RUNS} SELECT n.dataset, round(pa, 6)::DOUBLE AS pa, round(pta, 6)::DOUBLE AS pta, CASE WHEN r.dataset IS NULL THEN 'missing' ELSE error END AS error FROM (SELECT 'd' || i AS dataset FROM range(15) t(i)) n LEFT JOIN runs r ON n.dataset = r.dataset")),
    "e03_scale_averages": (_e03, with_log("log_orders", "s AS (SELECT line_id % 8 + 1 AS scale, avg(length(content)) AS pa FROM log GROUP BY 1) SELECT scale, round(pa, 6)::DOUBLE AS pa FROM s UNION ALL SELECT NULL, round(avg(pa), 6)::DOUBLE FROM s")),
    "e04_metric_table": (_e04, with_log("log_orders", f"{_RUNS} SELECT dataset, round(pa, 6)::DOUBLE AS pa, round(pta, 6)::DOUBLE AS pta, error FROM runs UNION ALL SELECT 'AVERAGE', round(avg(pa), 6)::DOUBLE, round(avg(pta), 6)::DOUBLE, NULL FROM runs")),
    "j05_diversity_of_runs": (_j05, with_log("log_orders", f"{_RUNS} SELECT r.dataset, round(pa, 6)::DOUBLE AS pa, round(ld, 6)::DOUBLE AS ld FROM runs r LEFT JOIN (SELECT 'd' || i AS dataset, i / 10.0::DOUBLE AS ld FROM range(0, 12, 2) t(i)) l ON r.dataset = l.dataset")),
    "j07_deltas": (_j07, with_log("log_orders", f"{_RUNS} SELECT dataset, round(pa, 6)::DOUBLE AS pa_before, round(pa * 1.5::DOUBLE, 6)::DOUBLE AS pa_after, round(pa * 1.5::DOUBLE - pa, 6)::DOUBLE AS pa_delta FROM runs WHERE dataset <> 'd3'")),
    "k06_merged_levels": (_k06, with_log("log_orders", f"{_RUNS} SELECT dataset, round(CASE WHEN dataset IN ('d1', 'd2') THEN 0.5 ELSE pa END, 6)::DOUBLE AS pa FROM runs")),
    "p06_by_complexity": (_p06b, with_log("log_text", f"m AS (SELECT regexp_replace(content, {q(chr(92) + 'b[0-9]+' + chr(92) + 'b')}, '<*>', 'g') AS t, count(*) AS n FROM log GROUP BY 1), c AS (SELECT n, len(regexp_extract_all(t, '<[*]>')) AS k FROM m) SELECT (CASE WHEN k = 0 THEN 1 WHEN k <= 4 THEN 2 ELSE 3 END)::BIGINT AS complexity, sum(n)::BIGINT AS n, count(*) AS templates FROM c GROUP BY 1")),
    "p13_entropy_levels": (
        _p13,
        with_log("log_events", f"""spread AS (SELECT template, {tokens_sql('content')} AS toks, unnest({positions_sql("string_split(template, ' ')")}) AS pos FROM log),
counts AS (SELECT template, pos, toks[pos + 1] AS v, count(*) AS n FROM spread WHERE pos < len(toks) GROUP BY 1, 2, 3), sizes AS (SELECT template, count(*) AS gs FROM log GROUP BY 1),
ent AS (SELECT c.template, pos, -sum(n::DOUBLE / t * ln(n::DOUBLE / t)) / ln(any_value(gs)) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY template, pos) AS t FROM counts) c JOIN sizes USING (template) GROUP BY c.template, pos)
SELECT s.template, gs AS n, CASE WHEN gs = 1 THEN 'high' WHEN NOT contains(s.template, '<*>') THEN 'none' WHEN round(coalesce(avg(e), 0), 6) <= 0.8 THEN 'medium' ELSE 'high' END AS level FROM sizes s LEFT JOIN ent USING (template) GROUP BY s.template, gs"""),
    ),
    "t34_joined_again": (_t34, with_log("log_events", r"SELECT line_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '(=|\(|,)', '\1 ', 'g'), '([(\[=_]) ', '\1', 'g'), ' ([,)\]])', '\1', 'g'), ': ([0-9])', ':\1', 'g') AS text FROM log")),
    "t34_detokenized": (_t34d, with_log("log_events", f"{_SPREAD_T} SELECT line_id, dataset, {_DETOKENIZED} AS text FROM spread")),
    "t37_meaningful_lines": (
        _t37,
        with_log("log_text", r"SELECT line_id, regexp_matches(content, '^[A-Za-z\s]+$') AS english FROM log WHERE len(list_intersect(regexp_split_to_array(lower(content || ' ' || regexp_replace(content, '([a-z])([A-Z])', '\1 \2', 'g')), '[^a-z]+'), ['the', 'of', 'license'])) > 0"),
    ),
    "b09_round_robin": (
        _b09,
        with_log("log_events", "f AS (SELECT template, content, min(line_id) AS first_line FROM log GROUP BY 1, 2), g AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY first_line) - 1 AS k FROM f), t AS MATERIALIZED (SELECT * FROM g WHERE g.k < 3), s AS (SELECT template, count(*) AS kinds FROM t GROUP BY 1), n AS (SELECT template, kinds, unnest(range(8)) AS place FROM s) SELECT n.template, n.place::BIGINT AS slot, t.content FROM n JOIN t ON t.template = n.template AND t.k = n.place % n.kinds"),
    ),
}
