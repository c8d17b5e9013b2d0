"""Queries over whole data sets that are built, levels of repetition, and lines that lie far apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.operators import augment, build, diversity, sampling
from timberline.operators.clean import masked

from .shared import MASKS, events, masked_sql, rounded, with_log

_TARGETS = (0.1, 0.3, 0.5, 0.9)

#: Four data sets with some 35 events each, whose ids are numbers out of order.
_DATASET, _STEP = "concat('set', cast(line_id % 4 as string))", "concat(' step', cast(line_id % 7 as string))"
_EVENT = "concat('E', cast(ascii(template) * 10 + line_id % 7 as string))"


def _source(spark, sf_dir):
    lines = events(spark, sf_dir).selectExpr(f"{_DATASET} AS dataset", "line_id", f"{_EVENT} AS event_id", f"concat(line, {_STEP}) AS line", f"concat(content, {_STEP}) AS content", f"concat(template, {_STEP}) AS template")
    return lines, build.chosen_events(lines, lines.select("dataset", "event_id", "template").distinct())


def _chosen(spark, sf_dir):
    return _source(spark, sf_dir)[1].select("dataset", "event_id", "event_number", "template", "line_id", "placeholder_count")


def _report(spark, sf_dir):
    return build.level_report(_source(spark, sf_dir)[1], _TARGETS)


def _b17(spark, sf_dir):
    report = _report(spark, sf_dir)
    near = (F.abs(F.col("achieved_entropy_per_active_slot") - F.col("target_entropy_per_active_slot")) <= 0.03).alias("near")
    sums = (F.aggregate("value_counts", F.lit(0), lambda s, c: s + c) == F.col("line_budget")).alias("counted")
    columns = ["dataset", "target_score", "construction_mode", "selection_rank", "requested_activation_ratio", "activation_ratio", "event_id", "active", "line_budget", "start_line_id", "end_line_id", "target_entropy_per_active_slot", "placeholder_count", "template"]
    return rounded(report.select(*[F.col(c).cast("bigint").alias(c) if c in ("active", "line_budget", "placeholder_count") else c for c in columns], near, sums))


def _b17_label(spark, sf_dir):
    """The label of each data set and level: from its report, and from the lines that were built."""
    _, chosen = _source(spark, sf_dir)
    report = build.level_report(chosen, _TARGETS)
    keyed = report.withColumn("dataset", F.concat_ws("@", "dataset", "target_score"))
    labels = diversity.report_diversity(keyed)
    lines = build.built_lines(report, chosen).withColumn("dataset", F.concat_ws("@", "dataset", "target_score"))
    sizes = lines.groupBy("dataset").agg(F.count("*").alias("lines"), F.count_distinct("line_id").alias("numbers"), F.max("line_id").alias("last"), F.count_if(~F.endswith("line", "content")).alias("elsewhere"))
    near = (F.abs(F.col("ground_truth_ld") - F.split("dataset", "@")[1].cast("double")) <= 0.01).alias("near")
    return labels.join(sizes, "dataset").select("dataset", near, "lines", "numbers", "last", "elsewhere")


def _b17_nested(spark, sf_dir):
    """Of each level the active events, and those among them that the next level lacks."""
    active = _report(spark, sf_dir).where("active = 1").select("dataset", "target_score", "event_id")
    order = {t: k for k, t in enumerate(_TARGETS)}
    level = F.coalesce(*[F.when(F.col("target_score") == t, F.lit(k)) for t, k in order.items()])
    named = active.select(level.cast("bigint").alias("level"), F.concat_ws(":", "dataset", "event_id").alias("template"))
    lost = build.not_nested(named).groupBy("level").agg(F.count("*").alias("lost"))
    return named.groupBy("level").agg(F.count("*").alias("active")).join(lost, "level", "left").select("level", "active", F.coalesce("lost", F.lit(0)).cast("bigint").alias("lost"))


_CHOSEN_SQL = (
    f"l AS (SELECT {_DATASET} AS dataset, line_id, {_EVENT} AS event_id, concat(template, {_STEP}) AS template FROM log), "
    "c AS (SELECT dataset, event_id, min(line_id) AS line_id, any_value(template) AS template FROM l GROUP BY 1, 2), "
    "chosen AS (SELECT *, regexp_extract(event_id, '([0-9]+)', 1)::BIGINT AS event_number, len(regexp_extract_all(template, '<[*]>')) AS placeholder_count FROM c)"
)
_REPORT_SQL = (
    f"{_CHOSEN_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5('1:' || dataset || ':' || event_id), event_number) AS selection_rank, count(*) OVER (PARTITION BY dataset) AS g FROM chosen), "
    f"p AS (SELECT *, least(g, greatest(1, round_even(g * sqrt(t), 0)))::BIGINT AS active_count FROM r, unnest([{', '.join(map(str, _TARGETS))}]::DOUBLE[]) u(t))"
)


def _b09(spark, sf_dir):
    lines = events(spark, sf_dir).select("template", "line_id", "content")
    built = build.with_tails(lines, (0.2, 0.5, 0.8), key=["template"])
    keyed = built.select(F.concat_ws("|", "target_score", "template").alias("key"), "content")
    found = diversity.varied_share(keyed, "key", F.split("content", " "))
    return rounded(found.select("key", "lines", "share", (F.abs(F.col("share") - F.split("key", r"\|")[0].cast("double")) <= 0.05).alias("meets")))


_B09 = with_log(
    "log_events",
    "t AS (SELECT template, string_split(content, ' ') AS w FROM log), s AS (SELECT template, count(*) AS lines, avg(len(w)) AS mean, max(len(w)) AS width FROM t GROUP BY 1), "
    "v AS (SELECT template, count(*) FILTER (kinds > 1) AS varied FROM (SELECT template, i, count(DISTINCT w[i]) AS kinds FROM t, unnest(range(1, len(w) + 1)) u(i) GROUP BY 1, 2) a GROUP BY 1), "
    "n AS (SELECT *, greatest(60, ceil(x * (mean + 1) / (1 - x)) + 80) AS total FROM s JOIN v USING (template), unnest([0.2, 0.5, 0.8]::DOUBLE[]) u(x)), "
    "k AS (SELECT *, greatest(1, least(total, round_even(x * (mean + 1 + total), 0))) AS tail FROM n) "
    "SELECT x || '|' || template AS key, lines, round((varied + tail) / (width + 1 + total), 6)::DOUBLE AS share, abs((varied + tail) / (width + 1 + total) - x) <= 0.05 AS meets FROM k",
)


def _levels(spark, sf_dir):
    return augment.by_level(events(spark, sf_dir), masked(F.col("content"), MASKS[:2]), 8)


def _b10_levels(spark, sf_dir):
    return _levels(spark, sf_dir).groupBy("level").agg(F.count("*").alias("n"), F.count_distinct("shape").alias("shapes"), F.sum("line_id").alias("numbers")).withColumn("level", F.col("level").cast("bigint"))


def _b10_oracle(spark, sf_dir):
    found = augment.shape_oracle(augment.counted_by_level(events(spark, sf_dir), masked(F.col("content"), MASKS[:2])))
    return found.groupBy("level", "size").agg(F.count("*").alias("n"), F.count_distinct("content").alias("seeds"))


def _l06(candidates, k):
    def query(spark, sf_dir):
        found = sampling.adaptive_sample(events(spark, sf_dir), k, candidates)
        return rounded(found.select("rank", "line_id", "gap"))

    return query


def _l06_sql(k: int) -> str:
    """Each pick written out; the least distance goes from pick to pick."""
    shared = "list_sum(list_transform(list_distinct(w), lambda t: least(len(list_filter(w, lambda x: x = t)), len(list_filter(p.pw, lambda x: x = t)))))"
    ctes = [
        r"once AS (SELECT content, min(line_id) AS line_id, count(*) AS n, string_split(content, ' ') AS w FROM log GROUP BY content)",
        "p1 AS (SELECT 1 AS rank, line_id, NULL::DOUBLE AS gap, w AS pw FROM once ORDER BY len(w) DESC, n DESC, line_id LIMIT 1)",
        "g1 AS MATERIALIZED (SELECT *, 2.0::DOUBLE AS gap FROM once)",
    ]
    for r in range(2, k + 1):
        apart = f"(1 - coalesce({shared}, 0)::DOUBLE / (len(w) + len(p.pw) - coalesce({shared}, 0)))"
        ctes.append(f"g{r} AS MATERIALIZED (SELECT g.content, g.line_id, g.n, g.w, round(least(g.gap, {apart}), 12) AS gap FROM g{r - 1} g, p{r - 1} p WHERE g.line_id <> p.line_id)")
        ctes.append(f"p{r} AS MATERIALIZED (SELECT {r} AS rank, line_id, gap, w AS pw FROM g{r} ORDER BY gap DESC, n DESC, line_id LIMIT 1)")
    every = " UNION ALL ".join(f"SELECT rank, line_id, gap FROM p{r}" for r in range(1, k + 1))
    return with_log("log_events", f"{', '.join(ctes)} SELECT rank::BIGINT AS rank, line_id, round(gap, 6)::DOUBLE AS gap FROM ({every}) x")


QUERIES = {
    "b01_chosen_events": (_chosen, with_log("log_events", f"{_CHOSEN_SQL} SELECT dataset, event_id, event_number, template, line_id, placeholder_count::INT AS placeholder_count FROM chosen")),
    "b17_level_report": (
        _b17,
        with_log(
            "log_events",
            f"{_REPORT_SQL} SELECT dataset, t AS target_score, 'ground-truth' AS construction_mode, selection_rank, round(sqrt(t), 6)::DOUBLE AS requested_activation_ratio, round(active_count / g::DOUBLE, 6)::DOUBLE AS activation_ratio, event_id, "
            "(selection_rank <= active_count)::BIGINT AS active, 64::BIGINT AS line_budget, (selection_rank - 1) * 64 + 1 AS start_line_id, selection_rank * 64 AS end_line_id, "
            "round(least(1.0::DOUBLE, t / (active_count / g::DOUBLE)), 6)::DOUBLE AS target_entropy_per_active_slot, placeholder_count::BIGINT AS placeholder_count, template, true AS near, true AS counted FROM p",
        ),
    ),
    "b17_labels": (
        _b17_label,
        with_log("log_events", f"{_REPORT_SQL} SELECT dataset || '@' || t AS dataset, true AS near, count(*) * 64 AS lines, count(*) * 64 AS numbers, count(*) * 64 AS last, 0::BIGINT AS elsewhere FROM p GROUP BY dataset, t"),
    ),
    "b17_nested": (
        _b17_nested,
        with_log("log_events", f"{_REPORT_SQL} SELECT (list_position([{', '.join(map(str, _TARGETS))}]::DOUBLE[], t) - 1)::BIGINT AS level, count(*) AS active, 0::BIGINT AS lost FROM p WHERE selection_rank <= active_count GROUP BY t"),
    ),
    "b09_tails": (_b09, _B09),
    "b10_levels": (
        _b10_levels,
        with_log(
            "log_events",
            f"s AS (SELECT line_id, {masked_sql('content', MASKS[:2])} AS shape FROM log), r AS (SELECT *, row_number() OVER (PARTITION BY shape ORDER BY line_id) AS k FROM s) "
            "SELECT level::BIGINT AS level, count(*) AS n, count(DISTINCT shape) AS shapes, sum(line_id)::BIGINT AS numbers FROM r, range(1, 9) u(level) WHERE k <= level GROUP BY 1",
        ),
    ),
    "b10_level_oracle": (_b10_oracle, None),
    "l06_farthest_lines": (_l06(None, 5), _l06_sql(5)),
    "l06_adaptive_draws": (_l06(128, 8), None),
}
