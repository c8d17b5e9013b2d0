"""Queries over building, sampling and augmenting logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.operators import augment, build, clean, miners, sampling

from .shared import MASKS, events, masked_sql, orders, q, rounded, texts, with_log

_COUNTS = build.target_counts(64, 0.35)
_TARGETS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def _p01(spark, sf_dir):
    made = miners.by_mask(events(spark, sf_dir), MASKS).select("template").distinct()
    return build.select_templates(made, most=3, longest=60)


def _b03(spark, sf_dir):
    groups = events(spark, sf_dir).select("template").distinct().count()
    rows = [(t, *build.parameters(groups, t)) for t in _TARGETS]
    return rounded(spark.createDataFrame(rows, "target double, active int, ratio double, slot_target double"))


def _ranked_templates(spark, sf_dir):
    names = events(spark, sf_dir).select("template").distinct()
    return names.select("template", (F.length("template") % 97).cast("int").alias("rank"), F.when(F.col("template").contains("="), 0).otherwise(1).alias("active"))


def _b07(spark, sf_dir):
    return build.lines_of(_ranked_templates(spark, sf_dir), _COUNTS)


def _b08(spark, sf_dir):
    levels = orders(spark, sf_dir).select((F.col("line_id") % 9 + 1).alias("level"), (F.col("line_id") % 16).cast("string").alias("dataset"), F.length("content").alias("n"))
    by = levels.groupBy("level", "dataset").agg((F.avg("n") / 100).alias("ground_truth_ld"), F.count("*").alias("expected_lines"), (F.count("*") - F.max((F.col("level") == 3).cast("int"))).alias("actual_lines"))
    return build.validated(by.withColumn("target_score", F.lit(0.36)), 0.004).select("dataset", "within", "lines_match").groupBy("dataset").agg(F.sum(F.col("within").cast("bigint")).alias("within"), F.sum(F.col("lines_match").cast("bigint")).alias("matching"))


def _b08n(spark, sf_dir):
    active = events(spark, sf_dir).select((F.col("line_id") % 5 + 1).alias("level"), F.concat(F.lit("u"), (F.col("line_id") % 40).cast("string")).alias("template")).distinct()
    return build.not_nested(active)


def _b06(spark, sf_dir):
    rows = events(spark, sf_dir)
    return rows.select("line_id", build.replaced_last(F.col("line"), F.col("content"), F.lit("<new>")).alias("line"))


def _variants(spark, sf_dir):
    seeds = orders(spark, sf_dir).select("line_id", "content")
    changed = F.translate("content", "0123456789", "1234567890")
    other = F.concat("content", F.lit(" twice 7"))
    third = F.regexp_replace("content", "order", "request")
    return seeds.select(F.col("line_id").alias("origin"), "content", F.explode(F.array(changed, other, third)).alias("variant"))


def _b12(spark, sf_dir):
    return augment.ranked(_variants(spark, sf_dir), 2).select("origin", "variant", F.col("distance").cast("bigint").alias("distance"), F.col("rank").cast("bigint").alias("rank"))


def _p12(spark, sf_dir):
    rows = _variants(spark, sf_dir).select(augment.types_match(F.split("content", " "), F.split("variant", " ")).alias("types"), (F.size(F.array_except(F.filter(F.split("content", " "), lambda t: ~clean.is_variable(t)), F.split("variant", " "))) > 0).alias("lost"))
    return rows.groupBy("types", "lost").agg(F.count("*").alias("n"))


def _e14(spark, sf_dir):
    v = _variants(spark, sf_dir)
    first = v.where("variant like '%twice%'")
    return augment.pooled([first, v], 2).select("origin", "variant", F.col("source").cast("bigint").alias("source"))


def _e15(spark, sf_dir):
    return augment.budgeted(events(spark, sf_dir).select("line_id", F.length("content").cast("bigint").alias("size")), 100, [F.desc("size"), F.col("line_id")])


def _l02(spark, sf_dir):
    v = _variants(spark, sf_dir)
    return rounded(v.select("origin", "variant", sampling.levenshtein_ratio(F.col("content"), F.col("variant")).alias("distance")))


def _l04(spark, sf_dir):
    v = _variants(spark, sf_dir)
    return rounded(v.select("origin", "variant", sampling.multiset_jaccard(F.split("content", " "), F.split("variant", " ")).alias("similarity")))


def _a27(spark, sf_dir):
    return sampling.top_tokens(texts(spark, sf_dir).select("line_id", "content"), F.split(F.lower("content"), " ")).select("line_id", F.col("rank").cast("bigint").alias("rank"), "token")


def _l07(spark, sf_dir):
    return sampling.clusters(orders(spark, sf_dir)).groupBy("coarse", "fine").agg(F.count("*").alias("n"))


def _l08(spark, sf_dir):
    groups = events(spark, sf_dir).groupBy("template").agg(F.count("*").alias("n"))
    return sampling.quotas(groups, 32, [F.desc("n"), F.col("template")]).select("template", "n", F.col("quota").cast("bigint").alias("quota"))


def _s07(spark, sf_dir):
    listed = miners.template_counts(miners.by_mask(events(spark, sf_dir), MASKS)).select(F.concat_ws(" ", "template", F.col("n").cast("string")).alias("value"))
    from timberline.sources.files import parsed_counts

    return parsed_counts(listed)


_VAR = "v AS (SELECT line_id AS origin, content, unnest([translate(content, '0123456789', '1234567890'), content || ' twice 7', replace(content, 'order', 'request')]) AS variant FROM log)"
_SKEL = r"trim(regexp_replace(regexp_replace(regexp_replace(trim({t}), '\b\d{6}\b', '<NUM>', 'g'), '\b\d+\b', '<NUM>', 'g'), '\s+', ' ', 'g'))"
_VARIABLE = r"(t = '' OR contains(t, '<*>') OR t = '*' OR regexp_matches(t, '\d+\.\d+\.\d+\.\d+') OR contains(t, '://') OR regexp_matches(t, '^-?\d+$') OR regexp_matches(t, '^\d{2}:\d{2}:\d{2}$') OR starts_with(t, '/'))"
_NUMERIC = "list_filter(range(1, least(len(a), len(b)) + 1), lambda i: regexp_matches(rtrim(ltrim(a[i], '[](),;:'), '[](),;:'), '^[+]?[0-9]+$'))"
_TYPES = f"len(list_filter({_NUMERIC}, lambda i: NOT regexp_matches(rtrim(ltrim(b[i], '[](),;:'), '[](),;:'), '^[+]?[0-9]+$'))) = 0"
_LOST = f"len(list_filter(a, lambda t: NOT {_VARIABLE} AND NOT list_contains(b, t))) > 0"
_DIST = "(len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) + abs(len(a) - len(b)))"
_AB = "w AS (SELECT *, string_split(content, ' ') AS a, string_split(variant, ' ') AS b FROM v)"
_SUM = [sum(_COUNTS[: k + 1]) for k in range(len(_COUNTS))]

QUERIES = {
    "p01_selected_templates": (
        _p01,
        with_log("log_events", f"m AS (SELECT DISTINCT {masked_sql('content')} AS template FROM log) SELECT template FROM m WHERE len(regexp_extract_all(template, '<[*]>')) BETWEEN 1 AND 3 AND length(template) <= 60 AND NOT regexp_matches(template, '[0-9A-Za-z_]<[*]>|<[*]>[0-9A-Za-z_]')"),
    ),
    "b03_parameters": (
        _b03,
        with_log("log_events", "g AS (SELECT count(DISTINCT template)::DOUBLE AS n FROM log), t AS (SELECT i / 10.0::DOUBLE AS target, n, least(n, greatest(1, round_even(n * sqrt(i / 10.0::DOUBLE), 0))) AS active FROM g, range(1, 10) r(i)) SELECT round(target, 6)::DOUBLE AS target, active::INT AS active, round(active / n, 6)::DOUBLE AS ratio, round(least(1, target / (active / n)), 6)::DOUBLE AS slot_target FROM t"),
    ),
    "b06_replaced_last": (_b06, with_log("log_events", "SELECT line_id, left(line, length(line) - length(content)) || '<new>' AS line FROM log")),
    "b07_built_lines": (
        _b07,
        with_log(
            "log_events",
            "t AS (SELECT DISTINCT template, string_split(template, '<*>') AS p, length(template) % 97 AS rank, CASE WHEN contains(template, '=') THEN 0 ELSE 1 END AS active FROM log), "
            f"x AS (SELECT *, len(list_filter({_SUM}, lambda s: s <= k)) AS variant FROM t, range(0, 64) r(k)) "
            "SELECT (rank * 64 + k)::BIGINT AS line_id, array_to_string(list_transform(p, lambda s, i: CASE WHEN i = 1 THEN s WHEN active = 1 THEN (100000 + (i - 2) * 10000 + variant)::VARCHAR || s ELSE chr((97 + i - 2)::INT) || chr((97 + i - 2)::INT) || 'alpha' || s END), '') AS content, template FROM x",
        ),
    ),
    "b08_validated": (
        _b08,
        with_log("log_orders", "l AS (SELECT line_id % 9 + 1 AS level, (line_id % 16)::VARCHAR AS dataset, avg(length(content)) / 100 AS ld, max((line_id % 9 + 1 = 3)::INT) AS off FROM log GROUP BY 1, 2) SELECT dataset, (count(*) FILTER (abs(ld - 0.36::DOUBLE) <= 0.004::DOUBLE))::BIGINT AS within, (count(*) FILTER (off = 0))::BIGINT AS matching FROM l GROUP BY dataset"),
    ),
    "b08_not_nested": (
        _b08n,
        with_log("log_events", "a AS (SELECT DISTINCT line_id % 5 + 1 AS level, 'u' || (line_id % 40) AS template FROM log) SELECT level, template FROM a x WHERE level < (SELECT max(level) FROM a) AND NOT EXISTS (SELECT 1 FROM a y WHERE y.level = x.level + 1 AND y.template = x.template)"),
    ),
    "b12_ranked_candidates": (
        _b12,
        with_log("log_orders", f"{_VAR}, {_AB}, d AS (SELECT origin, variant, {_DIST} AS distance FROM w) SELECT * FROM (SELECT origin, variant, distance::BIGINT AS distance, row_number() OVER (PARTITION BY origin ORDER BY distance, variant) AS rank FROM d) x WHERE rank <= 2"),
    ),
    "p12_fixed_and_types": (_p12, with_log("log_orders", f"{_VAR}, {_AB} SELECT {_TYPES} AS types, {_LOST} AS lost, count(*) AS n FROM w GROUP BY 1, 2")),
    "e14_pooled": (
        _e14,
        with_log("log_orders", f"{_VAR}, u AS (SELECT DISTINCT origin, variant, CASE WHEN variant LIKE '%twice%' THEN 0 ELSE 1 END AS source FROM v) SELECT origin, variant, source::BIGINT AS source FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY source, variant) AS rn FROM u) x WHERE rn <= 2"),
    ),
    "e15_budget": (_e15, with_log("log_events", "SELECT line_id, length(content)::BIGINT AS size FROM log ORDER BY size DESC, line_id LIMIT 100")),
    "l02_levenshtein": (_l02, with_log("log_orders", f"{_VAR} SELECT origin, variant, round(levenshtein(content, variant)::DOUBLE / greatest(length(content), length(variant)), 6)::DOUBLE AS distance FROM v")),
    "l04_multiset_jaccard": (
        _l04,
        with_log("log_orders", f"{_VAR}, {_AB}, s AS (SELECT origin, variant, len(a) + len(b) AS total, list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda x: x = t)), len(list_filter(b, lambda x: x = t))))) AS k FROM w) SELECT origin, variant, round(k::DOUBLE / (total - k), 6)::DOUBLE AS similarity FROM s"),
    ),
    "l07_clusters": (
        _l07,
        with_log(
            "log_orders",
            r"c AS (SELECT line_id, array_to_string(list_sort(list_distinct(list_filter(string_split(regexp_replace(content, '[0-9A-Za-z, ]+', '', 'g'), ''), lambda c: c <> ''))), '') AS fine, list_filter(regexp_split_to_array(trim(regexp_replace(content, ':|\(|\)|=|,|\[|\]|\||;', ' ', 'g')), '\s+'), lambda w: NOT regexp_matches(w, '\d')) AS w FROM log), "
            f"t AS (SELECT line_id, unnest(w) AS tok FROM c), f AS (SELECT * FROM t WHERE length(tok) > 2 AND tok NOT IN ({', '.join(q(s) for s in sampling.STOP_WORDS)})), k AS (SELECT tok, count(*) AS n FROM f GROUP BY 1), "
            "r AS (SELECT line_id, tok, row_number() OVER (PARTITION BY line_id ORDER BY n DESC, tok) AS rn FROM (SELECT DISTINCT line_id, tok FROM f) d JOIN k USING (tok)), "
            "g AS (SELECT line_id, string_agg(tok, ' ' ORDER BY rn) AS coarse FROM r WHERE rn <= 3 GROUP BY 1) SELECT coalesce(coarse, '') AS coarse, fine, count(*) AS n FROM c LEFT JOIN g USING (line_id) GROUP BY 1, 2",
        ),
    ),
    "l08_quotas": (_l08, with_log("log_events", "g AS (SELECT template, count(*) AS n FROM log GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, template) - 1 AS k, count(*) OVER () AS m FROM g) SELECT template, n, (32 // m + (k < 32 % m)::INT)::BIGINT AS quota FROM k")),
    "a27_top_tokens": (
        _a27,
        with_log("log_text", f"t AS (SELECT line_id, unnest(string_split(lower(content), ' ')) AS tok FROM log), f AS (SELECT * FROM t WHERE length(tok) > 2 AND tok NOT IN ({', '.join(q(s) for s in sampling.STOP_WORDS)})), k AS (SELECT tok, count(*) AS n FROM f GROUP BY 1) SELECT line_id, rn AS rank, tok AS token FROM (SELECT line_id, tok, row_number() OVER (PARTITION BY line_id ORDER BY n DESC, tok) AS rn FROM (SELECT DISTINCT line_id, tok FROM f) d JOIN k USING (tok)) r WHERE rn <= 3"),
    ),
    "s07_parsed_counts": (_s07, with_log("log_events", f"SELECT {masked_sql('content')} AS template, count(*) AS n FROM log GROUP BY 1")),
}
