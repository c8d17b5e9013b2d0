"""Queries over lines and their events, groups that are chosen, reports by level, and logs told apart by a key."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.operators import augment, build, clean, diversity, metrics, miners, online, reports, sampling
from timberline.streaming import templates as streams

from .checks import _ERRING, _ROUGH, _t25_sql
from .mining import _BRAIN, _LOGRAM
from .shared import MASKS, SPACED, events, masked_sql, orders, q, rounded, spaced_sql, split_sql, texts, with_log
from .spread import _GROUPS

def _erring(spark, sf_dir):
    return events(spark, sf_dir).selectExpr("line_id", "content", "template AS truth", f"{_ERRING} AS template")


def _pa(mode, doubled=False):
    def query(spark, sf_dir):
        lines = _erring(spark, sf_dir)
        true = lines.select(F.col("truth").alias("template")).distinct()
        if doubled:  # templates that are equal by tokens
            true = true.unionByName(true.select(F.replace("template", F.lit(":"), F.lit("")).alias("template"))).distinct()
        return rounded(metrics.template_accuracy(miners.template_counts(lines), true, mode))

    return query


def _a16(spark, sf_dir):
    lines = _erring(spark, sf_dir)
    return rounded(metrics.set_grouping_accuracy(lines.select("line_id", F.col("truth").alias("template")), lines.select("line_id", "template")))


def _j10(spark, sf_dir):
    lines = _erring(spark, sf_dir)
    more = lines.select(F.concat("truth", F.when(F.col("line_id") % 2 == 0, F.lit(" !")).otherwise(F.lit(" more"))).alias("template")).distinct()
    return metrics.unmatched(lines.select(F.col("truth").alias("template")).distinct().unionByName(more), miners.template_counts(lines))


def _j04(spark, sf_dir):
    return metrics.first_of_event(events(spark, sf_dir)).select("event_id", "first_content", "n")


def _rough(spark, sf_dir):
    lines = events(spark, sf_dir).selectExpr("line_id", f"{_ROUGH} AS template")
    return lines.withColumn("event_id", clean.template_id(F.col("template")))


def _j08(spark, sf_dir):
    return metrics.corrected_events(_rough(spark, sf_dir).select("event_id", "template").distinct(), ["button"])


def _e11(spark, sf_dir):
    return metrics.corrected_lines(_rough(spark, sf_dir), ["button"]).groupBy("event_id", "template").agg(F.count("*").alias("n"))


def _e08(spark, sf_dir):
    lines = orders(spark, sf_dir)
    return metrics.back_projected(lines.select("line_id", "content"), miners.by_mask(lines, MASKS)).select("line_id", "content", "event_id", "template")


def _a24(spark, sf_dir):
    runs = orders(spark, sf_dir).select((F.col("line_id") % 9).alias("level"), F.when(F.col("line_id") % 11 != 0, F.length("content").cast("double")).alias("pa"))
    return rounded(reports.parser_averages(runs, "level", ["pa"], 9))


def _a25(spark, sf_dir):
    rows = events(spark, sf_dir).select((F.col("line_id") % 9).alias("level"), (F.col("line_id") % 97 / 97.0).alias("truth"), (F.length("content") / 100.0).alias("guess"))
    return rounded(reports.estimate_errors(rows, "level", "truth", "guess"))


def _a26(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.length("content").alias("content"), F.length("line").alias("line"), "line_id")
    return reports.means_transposed(rows, ["content", "line", "line_id"])


def _a28(spark, sf_dir):
    rows = texts(spark, sf_dir).select("line_id", "content", F.pmod(F.length("content"), F.lit(20)).cast("bigint").alias("event"))
    return sampling.shape_clusters(rows, "event", 3)


def _p02(spark, sf_dir):
    return rounded(diversity.low_groups(diversity.estimated_groups(events(spark, sf_dir), SPACED), 0.8))


def _m03g(spark, sf_dir):
    found = miners.chosen_groups(events(spark, sf_dir), SPACED, 0.95, 3)
    return rounded(found.select(F.col("rank").cast("bigint").alias("rank"), "key", "group_size", "diversity", "line_id", "content"))


def _m03a(spark, sf_dir):
    found, told = miners.adaptive(events(spark, sf_dir), literals=SPACED, source=augment.NumberVariants(), trigger=0.99, variants=3)
    lines = found.groupBy("template").agg(F.count("*").alias("n"))
    return lines.crossJoin(told.select("generated_lines", "enabled"))  # one row


def _m03e(spark, sf_dir):
    _, told = miners.adaptive(events(spark, sf_dir), literals=SPACED, trigger=0.5)
    return rounded(told.withColumn("triggers", diversity.triggers(F.col("global_ld"), 0.99)))


def _two(spark, sf_dir):
    """Two logs in one table, with line numbers that meet."""
    a, b = (run(spark, sf_dir).select(F.lit(name).alias("dataset"), "line_id", "content") for run, name in ((events, "events"), (orders, "orders")))
    return a.unionByName(b)


def _m01k(spark, sf_dir):
    return miners.brain(_two(spark, sf_dir), MASKS[:2], (), (":", "="), 4, key=["dataset"]).groupBy("dataset", "template").agg(F.count("*").alias("n"))


def _keyed(run):
    def query(spark, sf_dir):
        return run(_two(spark, sf_dir)).groupBy("dataset", "template").agg(F.count("*").alias("n"))

    return query


#: Answers whose lines a cleaner must tell from those of logs.
_ANSWER = "concat('Here are lines:', chr(10), '1. \"', content, '\"', chr(10), 'Output buffer full ', cast(line_id as string), chr(10), '  - ', content, chr(10), '```text', chr(10), '2) Sure ', content, chr(10), '--- ', content, chr(10), '# ', content, chr(10), '** ', content, chr(10), '> ', content, chr(10), '10、 ', content, chr(10), chr(10), '说明 ', content)"


def _e12(mode):
    def query(spark, sf_dir):
        answers = orders(spark, sf_dir).select(F.col("line_id").alias("id"), F.expr(_ANSWER).alias("answer"))
        return augment.answer_lines(answers, mode).groupBy("id", "line").agg(F.count("*").alias("n"))

    return query


def _e12_sql(*forms) -> str:
    each = ", ".join(forms)
    return with_log("log_orders", f"l AS (SELECT line_id AS id, unnest([{each}]) AS line FROM log) SELECT id, line, count(*) AS n FROM l GROUP BY 1, 2")


def _e16(spark, sf_dir):
    lines = events(spark, sf_dir)
    return sampling.unknown_groups(miners.by_mask(lines, (r"\b\d\b",)).join(lines.select("line_id", "content"), "line_id"))


def _l05(spark, sf_dir):
    lines = events(spark, sf_dir)
    return sampling.similar_examples(lines, lines.select("line_id", "content"), 2).select("template", "line_id", F.col("rank").cast("bigint").alias("rank"), "similarity")


def _l03(spark, sf_dir):
    rows = orders(spark, sf_dir).select("line_id", "content", F.concat("content", F.lit(" order pending")).alias("other"))
    return rounded(rows.select("line_id", sampling.cosine(F.split("content", " "), F.split("other", " ")).alias("cosine")))


def _l03b(spark, sf_dir):
    names = events(spark, sf_dir).select("template").distinct()
    pairs = names.select(F.col("template").alias("a"), F.substring("template", 1, 2).alias("k")).join(names.select(F.col("template").alias("b")), F.col("a") < F.col("b"))
    return rounded(sampling.matching_blocks_ratio(pairs.drop("k"), "a", "b"))


def _b04(spark, sf_dir):
    rows = [(t, k, c) for t in (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9) for k, c in enumerate(build.target_counts(64, t))]
    return spark.createDataFrame(rows, "target double, place int, lines int")


def _t24(spark, sf_dir):
    return _rough(spark, sf_dir).select("line_id", "template", clean.corrected(F.col("template")).alias("corrected"))


def _t10(spark, sf_dir):
    from timberline.settings import SETTINGS

    s = SETTINGS["Proxifier"]
    return texts(spark, sf_dir).select("line_id", miners.brain_text(F.col("content"), (r"\d{2}:\d{2}(:\d{2})*",), s.removed, (*s.spaced, ":", ",", "(", ")")).alias("text"))


def _windows(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("line_id"), "ts").join(events(spark, sf_dir).select("line_id", "content"), "line_id")
    found = streams.windowed_counts(rows.withColumn("ts", F.col("ts").cast("timestamp")), MASKS, "ts", "1 day")
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "template", "n")


_MADE = f"wrong AS (SELECT line_id, template AS truth, {_ERRING} AS template FROM log), made AS (SELECT template, count(*) AS n, {split_sql('template')} AS k FROM wrong GROUP BY template)"


def _pa_sql(pairs=False, doubled=False):
    true = "SELECT DISTINCT truth AS t FROM wrong" + (" UNION SELECT replace(truth, ':', '') FROM wrong" if doubled else "")
    hits = "sum((SELECT count(*) FROM true_ t WHERE t.k = made.k))" if pairs else "count(*) FILTER (k IN (SELECT k FROM true_))"
    return with_log(
        "log_events",
        f"{_MADE}, true_ AS (SELECT t, {split_sql('t')} AS k FROM ({true}) x) SELECT round((SELECT sum(CASE WHEN k IN (SELECT k FROM true_) THEN n ELSE 0 END)::DOUBLE / sum(n) FROM made), 6)::DOUBLE AS pa, round((SELECT {hits}::DOUBLE / count(*) FROM made), 6)::DOUBLE AS pta, round((SELECT (count(*) FILTER (k IN (SELECT k FROM made)))::DOUBLE / count(*) FROM true_), 6)::DOUBLE AS rta",
    )


_ROUGH_T = f"r AS (SELECT line_id, {_ROUGH} AS t FROM log), e AS (SELECT DISTINCT substr(md5(t), 1, 8) AS event_id, {_t25_sql()} AS corrected FROM r)"


def _two_sql(found):
    """A miner's SQL over each of two logs, put together."""
    parts = []
    for name, table in (("events", "log_events"), ("orders", "log_orders")):
        parts.append(f"SELECT '{name}' AS dataset, template, count(*) AS n FROM ({with_log(table, f'{found} SELECT template FROM found')}) x GROUP BY template")
    return " UNION ALL ".join(parts)


_ESTIMATE = "SELECT (SELECT count(*) FROM log) AS input_lines, round(sum(sqrt(group_size) * diversity) / sum(sqrt(group_size)), 6)::DOUBLE AS global_ld, (count(*) FILTER (diversity < 0.35))::BIGINT AS low_groups, count(*) AS coarse_groups FROM groups"

QUERIES = {
    "a13_pa_pta_rta": (_pa("entries"), _pa_sql()),
    "a14b_pta_pairs": (_pa("pairs", True), _pa_sql(True, True)),
    "a16_set_grouping": (
        _a16,
        with_log("log_events", f"{_MADE}, g AS (SELECT list(line_id ORDER BY line_id) AS ids FROM wrong GROUP BY template), t AS (SELECT list(line_id ORDER BY line_id) AS ids FROM wrong GROUP BY truth) SELECT round(sum(CASE WHEN ids IN (SELECT ids FROM t) THEN len(ids) ELSE 0 END)::DOUBLE / sum(len(ids)), 6)::DOUBLE AS ga FROM g"),
    ),
    "j04_first_of_event": (_j04, with_log("log_events", "SELECT substr(md5(template), 1, 8) AS event_id, arg_min(content, line_id) AS first_content, count(*) AS n FROM log GROUP BY template")),
    "j08_first_event_ids": (_j08, with_log("log_events", f"{_ROUGH_T} SELECT event_id, min(event_id) OVER (PARTITION BY corrected) AS first_id, corrected FROM e")),
    "e11_corrected_lines": (_e11, with_log("log_events", f"{_ROUGH_T} SELECT f.first_id AS event_id, f.corrected AS template, count(*) AS n FROM r JOIN (SELECT event_id, corrected, min(event_id) OVER (PARTITION BY corrected) AS first_id FROM e) f ON f.event_id = substr(md5(t), 1, 8) GROUP BY 1, 2")),
    "j10_unmatched_templates": (
        _j10,
        with_log("log_events", f"{_MADE}, s AS (SELECT truth AS t FROM wrong UNION SELECT truth || CASE WHEN line_id % 2 = 0 THEN ' !' ELSE ' more' END FROM wrong) SELECT t AS template FROM s WHERE {split_sql('t')} NOT IN (SELECT k FROM made)"),
    ),
    "e08_back_projection": (_e08, with_log("log_orders", f"p AS (SELECT line_id, content, {masked_sql('content')} AS template FROM log), f AS (SELECT template, 'E' || row_number() OVER (ORDER BY min(line_id)) AS event_id FROM p GROUP BY template) SELECT line_id, content, event_id, template FROM p JOIN f USING (template)")),
    "a24_parser_averages": (
        _a24,
        with_log("log_orders", "r AS (SELECT line_id % 9 AS level, CASE WHEN line_id % 11 <> 0 THEN length(content) END AS pa FROM log) SELECT coalesce(level::VARCHAR, 'AVERAGE') AS level, round(avg(pa), 6)::DOUBLE AS pa, count(pa) AS runs FROM r GROUP BY ROLLUP (level)"),
    ),
    "a25_estimate_errors": (
        _a25,
        with_log("log_events", "r AS (SELECT line_id % 9 AS level, (line_id % 97)::DOUBLE / 97 AS truth, length(content)::DOUBLE / 100 AS guess FROM log) SELECT level, count(*) AS datasets, round(avg(truth), 6)::DOUBLE AS mean_truth, round(avg(guess), 6)::DOUBLE AS mean_estimate, round(avg(abs(truth - guess)), 6)::DOUBLE AS mae, round(avg(((truth <= 0.35::DOUBLE) = (guess <= 0.35::DOUBLE))::INT), 6)::DOUBLE AS agreement FROM r GROUP BY level"),
    ),
    "a26_means_transposed": (
        _a26,
        with_log("log_events", "SELECT 'content' AS measure, round(avg(length(content)), 3)::DOUBLE AS mean FROM log UNION ALL SELECT 'line', round(avg(length(line)), 3)::DOUBLE FROM log UNION ALL SELECT 'line_id', round(avg(line_id), 3)::DOUBLE FROM log"),
    ),
    "a28_shape_clusters": (_a28, None),
    "p02_low_groups": (_p02, with_log("log_events", f"{_GROUPS} SELECT key, group_size, round(diversity, 6)::DOUBLE AS diversity FROM groups WHERE diversity < 0.8")),
    "m03_chosen_groups": (_m03g, None),
    "m03_adaptive": (_m03a, None),
    "m03_estimate": (
        _m03e,
        with_log("log_events", f"{_GROUPS}, s AS ({_ESTIMATE}) SELECT input_lines, global_ld, global_ld AS estimated_ld, low_groups, coarse_groups, 0::BIGINT AS generated_lines, false AS enabled, 0.5::DOUBLE AS trigger, global_ld <= 0.99::DOUBLE AS triggers FROM s"),
    ),
    "m01_brain_two_logs": (_m01k, _two_sql(_BRAIN)),
    "m02_anchors_two_logs": (_keyed(lambda rows: miners.by_anchors(rows, (r"blk_\d+",), (), (":",), 0.4, key=["dataset"])), None),
    "m04_drain_two_logs": (_keyed(lambda rows: online.drain(rows, (r"blk_\d+", r"(\d+\.){3}\d+"), key=["dataset"])), None),
    "m05_spell_two_logs": (_keyed(lambda rows: online.spell(rows, (r"blk_\d+", r"(\d+\.){3}\d+", r"\b\d+\b"), 0.5, key=["dataset"])), None),
    "m06_logram_two_logs": (_keyed(lambda rows: miners.logram(rows, (r"\b\d+\b",), 15, 10, key=["dataset"])), _two_sql(_LOGRAM)),
    "e12_answer_lines": (
        _e12("variants"),
        _e12_sql("'Here are lines:'", "content", "'Output buffer full ' || line_id", "content", "'Sure ' || content", "'-- ' || content", "'# ' || content", "'* ' || content", "'> ' || content", "'10、 ' || content", "'说明 ' || content"),
    ),
    "e12_answer_lines_of_logs": (
        _e12("logs"),
        _e12_sql("'Here are lines:'", "'\"' || content || '\"'", "'Output buffer full ' || line_id", "'- ' || content", "'Sure ' || content", "content"),
    ),
    "e16_unknown_groups": (_e16, with_log("log_events", r"SELECT regexp_replace(content, '\b\d\b', '<*>', 'g') AS template, count(*) AS n FROM log GROUP BY 1 HAVING count(*) = 1 OR min(content) = max(content)")),
    "l05_similar_examples": (
        _l05,
        with_log("log_events", "e AS (SELECT min(line_id) AS line_id, string_split(content, ' ') AS b FROM log GROUP BY content), a AS (SELECT DISTINCT template, string_split(template, ' ') AS a FROM log), s AS (SELECT template, line_id, len(a) + len(b) AS total, list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda x: x = t)), len(list_filter(b, lambda x: x = t))))) AS k FROM a, e), r AS (SELECT template, line_id, round(k::DOUBLE / (total - k), 6)::DOUBLE AS similarity FROM s WHERE k > 0) SELECT * FROM (SELECT template, line_id, row_number() OVER (PARTITION BY template ORDER BY similarity DESC, line_id) AS rank, similarity FROM r) x WHERE rank <= 2"),
    ),
    "l03_cosine": (
        _l03,
        with_log("log_orders", "p AS (SELECT line_id, string_split(content, ' ') AS a, string_split(content || ' order pending', ' ') AS b FROM log) SELECT line_id, round(list_sum(list_transform(list_distinct(a), lambda t: least(len(list_filter(a, lambda x: x = t)), len(list_filter(b, lambda x: x = t))))) / sqrt(len(a) * len(b)::DOUBLE), 6)::DOUBLE AS cosine FROM p"),
    ),
    "l03_matching_blocks": (_l03b, None),
    "b04_target_counts": (_b04, None),
    "t24_corrected": (_t24, None),
    "t10_spaced_proxifier": (_t10, with_log("log_text", f"SELECT line_id, regexp_replace({spaced_sql(r"regexp_replace(regexp_replace(content, '\d{2}:\d{2}(:\d{2})*', '<*>', 'g'), '\(.*?\)', '', 'g')", (':', ',', '(', ')'))}, ' +', ' ', 'g') AS text FROM log")),
    "s_windowed_counts": (
        _windows,
        with_log("log_events", f"SELECT strftime(e.ts, '%Y-%m-%d') AS day, {masked_sql('content')} AS template, count(*) AS n FROM log JOIN events e ON e.event_id = log.line_id GROUP BY 1, 2"),
    ),
}
