"""Queries over template miners."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from timberline.functions.ordering import with_checkpoints
from timberline.operators import answers, cache, extract, grams, miners, online

from .shared import MASKS, SPACED, events, items, masked_sql, normal_sql, orders, q, rounded, spaced_sql, split_sql, texts, with_log


def _counts(assigned):
    return miners.template_counts(assigned)


def _brain(spark, sf_dir, run=events):
    return miners.brain(run(spark, sf_dir), MASKS[:2], (), (":", "="), threshold=4)


def _logram(spark, sf_dir, run=orders):
    return miners.logram(run(spark, sf_dir), (r"\b\d+\b",), 15, 10)


def _a01n(spark, sf_dir):
    rows = texts(spark, sf_dir).selectExpr("line_id", "content", "array(line_id, line_id + 1000000) AS line_ids")
    return miners.merged_numbers(rows, F.lower("content")).select("text", "place", "line_id", F.explode("line_ids").alias("number"))


def _a21(spark, sf_dir):
    lines = orders(spark, sf_dir)
    grouped = miners.distinct_contents(lines, miners.brain_text(F.col("content"), MASKS[3:], (), (":",)))
    return miners.positional_frequencies(grouped).select(F.col("pos").cast("bigint").alias("pos"), "tok", "freq")


def _a22(width):
    def query(spark, sf_dir):
        lines = texts(spark, sf_dir).select(F.trim(F.regexp_replace("content", r"\s+", " ")).alias("text"))
        return grams.counts(lines, [width]).groupBy("freq").agg(F.count("*").alias("grams"))

    return query


def _a23(spark, sf_dir):
    distinct = events(spark, sf_dir).select(F.col("content").alias("text")).distinct()
    return miners.anchor_frequencies(distinct).groupBy("width", "pos").agg(F.count("*").alias("words"), F.min("freq").alias("least"), F.max("freq").alias("most")).select(F.col("width").cast("bigint").alias("width"), F.col("pos").cast("bigint").alias("pos"), "words", "least", "most")


def _m07(spark, sf_dir):
    return miners.consensus(events(spark, sf_dir).select("content", F.length(F.regexp_replace("content", "[^ ]", "")).cast("bigint").alias("key")), "key")


def positional_text_sql(content: str, masks=MASKS[:2], literals=SPACED) -> str:
    return f"regexp_replace({spaced_sql(masked_sql(content, masks), literals)}, ' +', ' ', 'g')"


#: Tokens that the positional miner takes for variables by themselves.
_VARIES = "contains(g.tok, '/') OR contains(g.tok, '<*>') OR regexp_matches(g.tok, '^-?[0-9]+$')"


def positional_sql(text: str, threshold: int = 4, digits_vary: bool = False, varies: str = _VARIES) -> str:
    """CTEs up to ``found`` over ``log``."""
    digits = " OR regexp_matches(g.tok, '[0-9]')" if digits_vary else ""
    return f"""texts AS (SELECT line_id, string_split({text}, ' ') AS w FROM log),
toks AS (SELECT line_id, len(w) AS width, i - 1 AS pos, w[i] AS tok FROM texts, unnest(range(1, len(w) + 1)) r(i)),
freq AS (SELECT pos, tok, count(*) AS f FROM toks GROUP BY 1, 2),
placed AS (SELECT t.*, f FROM toks t JOIN freq USING (pos, tok)),
times AS (SELECT line_id, f, count(*) AS k, min(pos) AS first_at FROM placed GROUP BY 1, 2),
root AS (SELECT line_id, f AS root, k AS root_k FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY k DESC, first_at) AS rn FROM times) x WHERE rn = 1),
g AS (SELECT p.*, root, root_k FROM placed p JOIN root USING (line_id)),
lead_ AS (SELECT width, root, root_k, min(line_id) AS line_id FROM g GROUP BY 1, 2, 3),
open_ AS (SELECT g.width, g.root, g.root_k, g.pos FROM g JOIN lead_ l ON g.line_id = l.line_id AND g.width = l.width AND g.root = l.root AND g.root_k = l.root_k WHERE f <> g.root),
vary AS (SELECT DISTINCT g.width, g.root, g.root_k, g.tok FROM g JOIN (SELECT g.width, g.root, g.root_k, g.pos FROM g JOIN open_ o ON g.width = o.width AND g.root = o.root AND g.root_k = o.root_k AND g.pos = o.pos GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT tok) >= {threshold}) m ON g.width = m.width AND g.root = m.root AND g.root_k = m.root_k AND g.pos = m.pos),
said AS (SELECT line_id, pos, CASE WHEN {varies}{digits} OR v.tok IS NOT NULL THEN '<*>' ELSE g.tok END AS tok FROM g LEFT JOIN vary v ON g.width = v.width AND g.root = v.root AND g.root_k = v.root_k AND g.tok = v.tok),
found AS (SELECT line_id, string_agg(tok, ' ' ORDER BY pos) AS template FROM said GROUP BY line_id)"""


_BRAIN = positional_sql(positional_text_sql("content"))


def ngram_sql(text: str, bigrams: int = 15, trigrams: int = 10) -> str:
    """CTEs up to ``found`` over ``log``."""
    return rf"""texts AS (SELECT line_id, string_split(trim(regexp_replace({text}, '\s+', ' ', 'g')), ' ') AS w FROM log),
two AS (SELECT a, b, count(*) AS f FROM (SELECT w[i] AS a, w[i % len(w) + 1] AS b FROM texts, unnest(range(1, len(w) + 1)) r(i)) x GROUP BY 1, 2),
three AS (SELECT a, b, c, count(*) AS f FROM (SELECT w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM texts, unnest(range(1, len(w) - 1)) r(i)) x GROUP BY 1, 2, 3),
rare AS (SELECT DISTINCT line_id, w, unnest([i, i + 1, i + 2]) AS p FROM (SELECT line_id, w, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM texts, unnest(range(1, len(w) - 1)) r(i)) x JOIN three USING (a, b, c) WHERE f < {trigrams}),
judged AS (SELECT r.line_id, r.p, x.f AS rf, y.f AS lf FROM rare r JOIN two x ON x.a = w[p] AND x.b = w[p % len(w) + 1] LEFT JOIN two y ON y.a = w[p - 1] AND y.b = w[p] AND p > 1),
vary AS (SELECT line_id, list(p) AS ps FROM judged WHERE NOT (CASE WHEN p = 1 THEN rf > {bigrams} ELSE lf >= {bigrams} OR rf >= {bigrams} END) GROUP BY 1),
found AS (SELECT t.line_id, replace(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_transform(w, lambda x, i: CASE WHEN list_contains(ps, i) THEN '<*>' ELSE x END) END, ' '), ',', '') AS template FROM texts t LEFT JOIN vary USING (line_id))"""


_LOGRAM = ngram_sql(r"regexp_replace(' ' || content, '\b\d+\b', '<*>', 'g')")

def _cleaned_sql(text: str, masks, literals) -> str:
    """The anchor miner's cleaning."""
    tokens = f"string_split(trim(regexp_replace({spaced_sql(masked_sql(text, masks), (*literals, '='))}, ' +', ' ', 'g')), ' ')"
    digits, slashes = r"length(regexp_replace(t, '[^0-9]', '', 'g'))", r"length(regexp_replace(t, '[^/]', '', 'g'))"
    varies = f"contains(t, '<*>') OR ({digits} > 0 AND {digits}::DOUBLE / length(t) >= 0.3) OR {slashes} >= 3"
    return f"array_to_string(list_transform({tokens}, lambda t: CASE WHEN {varies} THEN '<*>' ELSE t END), ' ')"


def anchors_sql(key: str = "", threshold: str = "0.4", together: bool = False) -> str:
    """CTEs after ``texts`` (key, text): ``passes``, recursive, of which ``leaves`` rows hold the templates; ``together``:
    each pass takes the least frequency over all widths."""
    key_, on = (f"{key}, ", f"PARTITION BY {key}") if key else ("", "")
    within = f"PARTITION BY {key_}width"
    least = f"min(freq) OVER ({on})" if together else f"CASE WHEN step = 0 AND max(freq) OVER ({within}) IS NOT NULL THEN min(freq) OVER ({on}) ELSE min(freq) OVER ({within}) END"
    return f"""passes AS (
  SELECT {key_}0 AS step, text, text AS now, regexp_extract_all(text, '\\S+=|\\S+') AS words, false AS leaves, 0::BIGINT AS low FROM (SELECT DISTINCT {key_}text FROM texts) a
  UNION ALL
  SELECT {key_}step + 1, text, CASE WHEN gone THEN now ELSE array_to_string(new, ' ') END, new, gone, low FROM (
    SELECT {key_}step, text, now, new, low, low IS NULL OR len(list_filter(new, lambda w: w = '<*>'))::DOUBLE / len(new) > {threshold} AS gone FROM (
      SELECT {key_}any_value(step) AS step, text, any_value(now) AS now, list(CASE WHEN freq = least_ THEN '<*>' ELSE w END ORDER BY i) AS new, any_value(least_) AS low FROM (
        SELECT *, {least} AS least_ FROM (
          SELECT *, CASE WHEN w <> '<*>' THEN count(DISTINCT now) OVER (PARTITION BY {key_}width, i, w) END AS freq FROM (
            SELECT {key_}step, text, now, len(words) AS width, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM passes WHERE NOT leaves) a) b) c
      GROUP BY {key_}text) d) e)"""


def _anchored_sql(select: str, together: bool = False) -> str:
    texts_ = f"texts AS (SELECT line_id, content, {_cleaned_sql('content', ANCHOR_MASKS, (':',))} AS text FROM log)"
    return with_log("log_events", f"{texts_}, {anchors_sql(together=together)} {select}").replace("WITH ", "WITH RECURSIVE ", 1)


#: Masks of the anchor miner's queries.
ANCHOR_MASKS = (r"blk_\d+",)

TRACE_SQL = _anchored_sql(
    "SELECT 'initial' AS step, count(DISTINCT content) AS n FROM log UNION ALL SELECT 'cleaned', count(DISTINCT text) FROM texts "
    "UNION ALL SELECT 'pass ' || step, count(DISTINCT now) FILTER (NOT leaves) FROM passes WHERE step > 0 GROUP BY step",
    together=True,
)

_SWEEP_SQL = with_log(
    "log_events",
    f"texts AS (SELECT line_id, unnest([0.2, 0.4, 0.6])::DOUBLE AS threshold, {_cleaned_sql('content', ANCHOR_MASKS, (':',))} AS text FROM log), {anchors_sql('threshold', 'threshold')}, "
    f"made AS (SELECT threshold, p.now AS template, count(*) AS n FROM texts JOIN passes p USING (threshold, text) WHERE p.leaves GROUP BY 1, 2), "
    f"mk AS (SELECT *, {split_sql('template')} AS k FROM made), sk AS (SELECT DISTINCT template, {split_sql('template')} AS k FROM log), known AS (SELECT DISTINCT k FROM sk), "
    "hits AS (SELECT m.*, s.k IS NOT NULL AS hit FROM mk m LEFT JOIN known s ON m.k = s.k), "
    "ours AS (SELECT threshold, sum(n) FILTER (hit) / sum(n)::DOUBLE AS pa, count(*) FILTER (hit) / count(*)::DOUBLE AS pta, count(*) AS templates FROM hits GROUP BY 1), "
    "theirs AS (SELECT t.threshold, avg((EXISTS (SELECT 1 FROM mk m WHERE m.threshold = t.threshold AND m.k = s.k))::INT) AS rta FROM (SELECT unnest([0.2, 0.4, 0.6])::DOUBLE AS threshold) t, sk s GROUP BY 1) "
    "SELECT threshold, round(coalesce(pa, 0), 6)::DOUBLE AS pa, round(pta, 6)::DOUBLE AS pta, round(rta, 6)::DOUBLE AS rta, templates FROM ours JOIN theirs USING (threshold)",
).replace("WITH ", "WITH RECURSIVE ", 1)

#: Answers to be read: by line_id % 6 one with a name, one with a back-tick only, one in quotation marks, one without a template,
#: one that is too general, and one that doesn't match its line.
_SLOTTED = "replace(template, '<*>', '{slot}')"
_ANSWERS = (
    f"CASE line_id % 6 WHEN 0 THEN concat('Well:', chr(10), 'Log template: `', {_SLOTTED}, '`', chr(10), 'or `x`') WHEN 1 THEN concat('I think `', {_SLOTTED}, '`') "
    f"WHEN 2 THEN concat('Log template: \"', {_SLOTTED}, '\"') WHEN 3 THEN concat('it is ', template) WHEN 4 THEN 'Log template: `{{a}} - {{b}}`' ELSE concat('Log template: `', {_SLOTTED}, ' no more`') END"
)


def _m08_answers(spark, sf_dir):
    lines = events(spark, sf_dir)
    # a content that several lines have gets the answer of the first one
    first = lines.groupBy("content").agg(F.min_by(F.struct("line_id", "template"), "line_id").alias("x")).select("content", "x.*")
    said = first.select(F.col("content").alias("message"), F.expr(_ANSWERS).alias("answer"))
    return answers.templates(lines.select("line_id", "content"), said).select("line_id", "template", "source")


#: What masking leaves of a content of each kind.
_MASKED_KINDS = (
    "CASE WHEN content LIKE 'user %' THEN 'user <*> viewed item <*> from <*>' WHEN content LIKE 'click %' THEN 'click on button <*> by user=<*>' WHEN content LIKE 'order %' THEN 'order <*> paid by user <*>, amount: <*> cents' "
    "WHEN content LIKE 'new %' THEN 'new account created for user <*>' ELSE 'request failed with code <*> path /srv/app/<*>/run' END"
)
_ANSWERED_SQL = with_log(
    "log_events",
    "first_ AS (SELECT content, min(line_id) % 6 AS k FROM log GROUP BY content) SELECT line_id, CASE WHEN k < 3 THEN template ELSE "
    f"{_MASKED_KINDS} END AS template, CASE k WHEN 3 THEN 'no template' WHEN 4 THEN 'too general' WHEN 5 THEN 'no match' ELSE 'answer' END AS source FROM log JOIN first_ USING (content)",
)


def _s12(spark, sf_dir):
    """The log of orders read in three parts by kind, the second one twice: what has been read, by template."""
    with_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir() or spark.conf.get('spark.checkpoint.dir')}/read-on-{uuid.uuid4().hex}"
    lines = orders(spark, sf_dir).selectExpr("line_id", "regexp_replace(content, ' priority .*', '') AS content", "concat('log', line_id % 8) AS log")
    low, high = lines.agg(F.min("line_id"), F.max("line_id")).first()
    cuts = [low, low + (high - low) // 3, low + (high - low) * 2 // 3, high + 1]
    for a, b in ((0, 1), (1, 2), (1, 2), (2, 3)):
        found = cache.read_on(lines.where((F.col("line_id") >= cuts[a]) & (F.col("line_id") < cuts[b])), path, key="log")
    return found.select("cache", "line_id", "template")


_COUNT = "SELECT template, count(*) AS n FROM found GROUP BY template"

QUERIES = {
    "m09_masked_templates": (lambda spark, sf_dir: _counts(miners.by_mask(events(spark, sf_dir), MASKS)), with_log("log_events", f"SELECT {masked_sql('content')} AS template, count(*) AS n FROM log GROUP BY 1")),
    "a01_distinct_contents": (
        lambda spark, sf_dir: miners.distinct_contents(texts(spark, sf_dir), F.lower("content")),
        with_log("log_text", "SELECT lower(content) AS text, count(*) AS n, min(line_id) AS first_line FROM log GROUP BY 1"),
    ),
    "a01_merged_numbers": (
        _a01n,
        with_log("log_text", "SELECT lower(content) AS text, min(line_id) OVER (PARTITION BY lower(content)) AS place, line_id, unnest([line_id, line_id + 1000000]) AS number FROM log"),
    ),
    "a21_positional_frequencies": (
        _a21,
        with_log("log_orders", f"t AS (SELECT string_split(regexp_replace({spaced_sql(masked_sql('content', MASKS[3:]), (':',))}, ' +', ' ', 'g'), ' ') AS w FROM log) SELECT (i - 1)::BIGINT AS pos, w[i] AS tok, count(*)::BIGINT AS freq FROM t, unnest(range(1, len(w) + 1)) r(i) GROUP BY 1, 2"),
    ),
    "a22_bigrams": (
        _a22(2),
        with_log("log_text", r"t AS (SELECT string_split(trim(regexp_replace(content, '\s+', ' ', 'g')), ' ') AS w FROM log), c AS (SELECT w[i] AS a, w[i % len(w) + 1] AS b, count(*) AS f FROM t, unnest(range(1, len(w) + 1)) r(i) GROUP BY 1, 2) SELECT f::BIGINT AS freq, count(*) AS grams FROM c GROUP BY 1"),
    ),
    "a22_trigrams": (
        _a22(3),
        with_log("log_text", r"t AS (SELECT string_split(trim(regexp_replace(content, '\s+', ' ', 'g')), ' ') AS w FROM log), c AS (SELECT w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, count(*) AS f FROM t, unnest(range(1, len(w) - 1)) r(i) GROUP BY 1, 2, 3) SELECT f::BIGINT AS freq, count(*) AS grams FROM c GROUP BY 1"),
    ),
    "a23_anchor_frequencies": (
        _a23,
        with_log("log_events", r"t AS (SELECT DISTINCT regexp_extract_all(content, '\S+=|\S+') AS w, content FROM log), f AS (SELECT len(w) AS width, i - 1 AS pos, w[i] AS word, count(*) AS f FROM t, unnest(range(1, len(w) + 1)) r(i) WHERE w[i] <> '<*>' GROUP BY 1, 2, 3) SELECT width::BIGINT AS width, pos::BIGINT AS pos, count(*) AS words, min(f) AS least, max(f) AS most FROM f GROUP BY 1, 2"),
    ),
    "m01_brain_events": (lambda spark, sf_dir: _counts(_brain(spark, sf_dir)), with_log("log_events", f"{_BRAIN} {_COUNT}")),
    "m01_brain_lines": (lambda spark, sf_dir: _brain(spark, sf_dir, orders), with_log("log_orders", f"{_BRAIN} SELECT line_id, template FROM found")),
    "m06_logram_orders": (lambda spark, sf_dir: _counts(_logram(spark, sf_dir)), with_log("log_orders", f"{_LOGRAM} {_COUNT}")),
    "m06_logram_text": (lambda spark, sf_dir: _logram(spark, sf_dir, texts), with_log("log_text", f"{_LOGRAM} SELECT line_id, template FROM found")),
    "m07_consensus": (
        _m07,
        with_log("log_events", f"t AS (SELECT length(regexp_replace(content, '[^ ]', '', 'g')) AS key, {split_sql(normal_sql('content'))} AS w FROM log), s AS (SELECT key, count(*) AS n FROM t GROUP BY 1), p AS (SELECT key, i, count(*) AS k, min(w[i]) AS lo, max(w[i]) AS hi FROM t, unnest(range(1, len(w) + 1)) r(i) GROUP BY 1, 2), o AS (SELECT key, n, i, CASE WHEN k = n AND lo = hi AND lo NOT IN ('<*>', '*') THEN lo ELSE '<*>' END AS tok FROM p JOIN s USING (key)), c AS (SELECT *, lag(tok) OVER (PARTITION BY key ORDER BY i) AS before FROM o) SELECT key::BIGINT AS key, string_agg(tok, ' ' ORDER BY i) AS template, any_value(n) AS n FROM c WHERE NOT (tok = '<*>' AND before IS NOT DISTINCT FROM '<*>') GROUP BY key"),
    ),
    "m02_anchor_fixpoint": (
        lambda spark, sf_dir: _counts(miners.by_anchors(events(spark, sf_dir), ANCHOR_MASKS, (), (":",), 0.4)),
        _anchored_sql("SELECT p.now AS template, count(*) AS n FROM texts JOIN passes p USING (text) WHERE p.leaves GROUP BY 1"),
    ),
    "e07_trace": (lambda spark, sf_dir: miners.trace(events(spark, sf_dir), ANCHOR_MASKS, (), (":",), 0.4), TRACE_SQL),
    "m03_normalised_anchors": (lambda spark, sf_dir: _counts(miners.by_normalised_anchors(events(spark, sf_dir), (), (), (":",), 0.4)), None),
    "m08_template_cache": (lambda spark, sf_dir: _counts(cache.cached(events(spark, sf_dir))), None),
    "m08_answers": (_m08_answers, _ANSWERED_SQL),
    "s12_read_in_parts": (_s12, with_log("log_orders", "SELECT 'log' || line_id % 8 AS cache, line_id, CASE WHEN content LIKE '%opened%' THEN 'order <*> opened for customer <*>' WHEN content LIKE '%pending' THEN 'order <*> pending' ELSE 'order <*> fulfilled, customer: <*>' END AS template FROM log")),
    "e01_threshold_sweep": (
        lambda spark, sf_dir: rounded(miners.sweep(events(spark, sf_dir), events(spark, sf_dir).select("template").distinct(), (0.2, 0.4, 0.6), masks=ANCHOR_MASKS, literals=(":",))),
        _SWEEP_SQL,
    ),
    "t22_parameters": (
        lambda spark, sf_dir: extract.parameters(orders(spark, sf_dir), "content", "template").select("line_id", F.array_join("parameter_list", "|").alias("parameters")),
        with_log("log_orders", r"SELECT line_id, CASE WHEN template LIKE '%opened%' THEN regexp_extract(content, '^order (.*?) opened', 1) || '|' || regexp_extract(content, 'customer (.*)$', 1) WHEN template LIKE '%fulfilled%' THEN regexp_extract(content, '^order (.*?) fulfilled', 1) || '|' || regexp_extract(content, 'customer: (.*?) priority', 1) || '|' || regexp_extract(content, 'priority (.*)$', 1) ELSE regexp_extract(content, '^order (.*?) pending', 1) END AS parameters FROM log"),
    ),
    "m04_drain": (lambda spark, sf_dir: _counts(online.drain(events(spark, sf_dir), (r"blk_\d+", r"(\d+\.){3}\d+"))), None),
    "m05_spell": (lambda spark, sf_dir: _counts(online.spell(events(spark, sf_dir), (r"blk_\d+", r"(\d+\.){3}\d+", r"\b\d+\b"), 0.5)), None),
    "m09_masked_items": (lambda spark, sf_dir: _counts(miners.by_mask(items(spark, sf_dir), (r"\b\d+\b",))), with_log("log_items", f"SELECT regexp_replace(content, {q(chr(92) + 'b[0-9]+' + chr(92) + 'b')}, '<*>', 'g') AS template, count(*) AS n FROM log GROUP BY 1")),
}
