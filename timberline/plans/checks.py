"""Queries over outcomes, filters, corrections, and the checks of lines that are generated."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.operators import augment, classify, clean, metrics, miners

from .shared import MASKS, events, items, masked_sql, orders, q, rounded, with_log

#: A parse that errs in every way, as an expression that both engines read: more general (once over two truths), more
#: special, unlike, and of several truths that don't agree.
_ERRING = """CASE WHEN template LIKE 'user%' AND line_id % 4 = 0 THEN 'user <*> <*> item <*> from <*>'
 WHEN template LIKE 'user%' AND line_id % 4 = 1 THEN '<*> <*> <*> <*> <*> <*> <*>'
 WHEN template LIKE 'request%' AND line_id % 4 = 1 THEN '<*> <*> <*> <*> <*> <*> <*>'
 WHEN template LIKE 'click%' AND line_id % 3 = 0 THEN 'click on button 7 by user=<*>'
 WHEN template LIKE 'new%' AND line_id % 2 = 0 THEN 'new <*> made'
 WHEN template LIKE 'order%' AND line_id % 5 = 0 THEN 'new <*> made'
 WHEN template LIKE 'order%' AND line_id % 5 = 1 THEN 'request failed with code <*> path <*>'
 ELSE template END"""

#: Lines of which each is what one rule or another is about.
_HARD = f"""CASE line_id % 18 WHEN 1 THEN content || ' see https://example.org/a' WHEN 2 THEN content || ' id 123e4567-e89b-12d3-a456-426614174000'
 WHEN 3 THEN content || ' /{"abcdefghij" * 4}ab' WHEN 4 THEN content || ' {{a: 1}}' WHEN 5 THEN content || ' {{{{0, 0}}, {{26, 87}}}} a: b'
 WHEN 6 THEN '# ' || content WHEN 7 THEN '{"日志" * 9}' || substr(content, 1, 9) WHEN 8 THEN content || repeat(' long', 90)
 WHEN 9 THEN content || ' a.b@c.org' WHEN 10 THEN content || ' 0xdeadbeef 0xdeadbee0' WHEN 11 THEN content || ' (((((((((((((' WHEN 12 THEN '  ** ' || content
 WHEN 13 THEN content || ' WindowServer: authw' WHEN 14 THEN content || ' by ksfetch' WHEN 15 THEN content || ' Internal name did not resolve to internal address!'
 WHEN 16 THEN '{"日志" * 2}' || content WHEN 17 THEN repeat('long ', 45) || content ELSE content END"""
_WILD = "CASE line_id % 5 WHEN 0 THEN '<*> <*> <*> <*> <*> <*> <*> <*> <*> a' WHEN 1 THEN '<*> <*> <*> <*> <*> <*> <*> a' ELSE template END"
_HEAD = "'Jul  1 09:00:55 host-1 kernel[0]: '"
_TOLD = f"""CASE line_id % 7 WHEN 1 THEN 'Jul  1 09:10:55 host-1 other.part[0]: ' || h WHEN 2 THEN h WHEN 3 THEN {_HEAD} || h || ' more'
 ELSE 'Jul  2 10:01:02 host-1 kernel[7]: ' || translate(h, '0123456789', '1234567890') END"""


def _hard(spark, sf_dir):
    return events(spark, sf_dir).selectExpr("line_id", f"{_HARD} AS h", f"{_WILD} AS template")


def _mac(spark, sf_dir):
    return _hard(spark, sf_dir).selectExpr("line_id", "template", f"{_HEAD} || h AS origin", f"{_TOLD} AS h")


def _erring(spark, sf_dir):
    lines = events(spark, sf_dir)
    return metrics.contingency(lines.select("line_id", "template"), lines.selectExpr("line_id", f"{_ERRING} AS template"))


def _a20r(spark, sf_dir):
    return rounded(metrics.outcome_rates(metrics.outcome(_erring(spark, sf_dir)), events(spark, sf_dir).select("template").distinct().count()))


def _a18l(spark, sf_dir):
    lines = events(spark, sf_dir)
    parsed = lines.selectExpr("line_id", "CASE WHEN line_id % 3 = 0 THEN replace(replace(template, 'user=<*>', '<*>'), '<*>,', '<*>') ELSE template END AS template")
    return rounded(metrics.line_accuracy(lines.select("line_id", "template"), parsed, lenient=True))


def _p05(spark, sf_dir):
    made = miners.template_counts(miners.by_mask(events(spark, sf_dir), MASKS)).select("template")
    made = made.unionByName(events(spark, sf_dir).selectExpr(f"{_ERRING} AS template").distinct()).distinct()
    width = F.size(F.split("template", " ")).alias("w")
    pairs = made.select(F.col("template").alias("general"), width).join(made.select(F.col("template").alias("special"), width), "w")
    return classify.abstracts(pairs, "general", "special").select("general", "special", "abstract")


def _p06(percent):
    def query(spark, sf_dir):
        made = miners.template_counts(miners.by_mask(items(spark, sf_dir), (r"\b\d\d\b",)))
        return metrics.by_frequency(made, percent).select("template", "n")

    return query


#: (data set, a line of its form)
_SAMPLES = (
    ("Android", "03-17 16:13:38.811  1702  2395 D WindowManager: printing "), ("Apache", "[Sun Dec 04 04:47:44 2005] [notice] worker "),
    ("BGL", "- 1117838570 2005.06.03 R02-M1-N0-C:J12-U11 2005-06-03-15.42.50.363779 R02-M1-N0-C:J12-U11 RAS KERNEL INFO cache "),
    ("HDFS", "081109 203615 148 INFO dfs.DataNode: Packet "), ("Hadoop", "2015-10-18 18:01:47,978 INFO [main] org.apache.App: Created "),
    ("HealthApp", "20171223-22:15:29:606|Step_LSC|30002312|"), ("Mac", "Jul  1 09:00:55 host-1 kernel[0]: "), ("OpenSSH", "Dec 10 06:55:46 LabSZ sshd[24200]: "),
    ("OpenStack", "nova-api.log 2017-05-16 00:00:00.008 25746 INFO nova.api [req-38101a0b] "), ("Proxifier", "[10.30 16:49:06] chrome.exe - "),
    ("Spark", "17/06/09 20:10:40 INFO executor.Backend: "), ("Zookeeper", "2015-07-29 17:41:44,747 - INFO  [QuorumPeer:Fast@774] - "), ("Other", ""),
)
_SAMPLE = "CASE line_id % 13 " + " ".join(f"WHEN {k} THEN '{x}'" for k, (_, x) in enumerate(_SAMPLES)) + " END"
_SET = "CASE line_id % 13 " + " ".join(f"WHEN {k} THEN '{x}'" for k, (x, _) in enumerate(_SAMPLES)) + " END"
_FORMED = f"CASE line_id % 7 WHEN 1 THEN substr({_SAMPLE}, 4) || content WHEN 2 THEN {_SAMPLE} || 'Output ' || content WHEN 3 THEN '|' || {_SAMPLE} || content WHEN 4 THEN {_SAMPLE} || content || ' 日志' ELSE {_SAMPLE} || content END"


def _p08(spark, sf_dir):
    rows = events(spark, sf_dir).selectExpr("line_id", f"{_SET} AS dataset", f"{_FORMED} AS line")
    ok = F.coalesce(*[F.when(F.col("dataset") == d, augment.format_ok(d, F.col("line"))) for d, _ in _SAMPLES])
    return rows.select("line_id", "dataset", ok.alias("ok"))


def _p09(spark, sf_dir):
    rows = events(spark, sf_dir).selectExpr("line_id", f"{_SAMPLES[3][1]!r} || content AS origin", "CASE line_id % 4 WHEN 0 THEN translate(content, '0123456789', '1234567890') WHEN 1 THEN content || ' x' ELSE content END AS c")
    candidate = F.when(F.col("line_id") % 8 > 5, F.col("c")).otherwise(F.concat(F.lit("081110 203616 148 INFO dfs.DataNode: Packet "), "c"))
    return rows.select("line_id", augment.same_template(F.col("origin"), candidate, "HDFS").alias("same"))


def _p10(spark, sf_dir):
    return _hard(spark, sf_dir).select("line_id", augment.reject_reason(F.col("h")).alias("reason"))


def _p10m(spark, sf_dir):
    return _mac(spark, sf_dir).select("line_id", augment.reject_reason(F.col("h"), F.col("origin"), "Mac").alias("reason"))


def _p11(spark, sf_dir):
    found = _hard(spark, sf_dir).select("line_id", "h", "template", augment.risk(F.col("h"), F.col("template")).alias("risk"))
    ok = augment.auto_pass(F.col("h"), F.col("template"), F.col("risk.score"))
    return found.select("line_id", F.col("risk.score").cast("bigint").alias("score"), F.array_join("risk.reasons", "; ").alias("reasons"), ok["ok"].alias("ok"))


def _p11m(spark, sf_dir):
    found = _mac(spark, sf_dir).select("line_id", "origin", "template", augment.risk(F.col("origin"), F.col("template"), "Mac").alias("risk"))
    ok = augment.auto_pass(F.col("origin"), F.col("template"), F.col("risk.score"), "Mac")
    return found.select("line_id", F.col("risk.score").cast("bigint").alias("score"), F.array_join("risk.reasons", "; ").alias("reasons"), ok["ok"].alias("ok"), ok["reason"].alias("reason"))


#: Templates with something for every rule of correction.
_ROUGH = """CASE line_id % 8 WHEN 1 THEN content || ' enabled=TRUE (root)' WHEN 2 THEN content || ' null,false;Admin' WHEN 3 THEN content || ' 12.34.56  a' WHEN 4 THEN content || ' <*>.<*>.<*> <*><*> a<*>b'
 WHEN 5 THEN content || ' "/var/log/x.y" /one /a//b' WHEN 6 THEN content || ' a/<*> <*>/<*> <*>/9' WHEN 7 THEN content || ' v1.2-3+4@5#6$7%8&9 true/false' ELSE content END"""


def _t25(spark, sf_dir):
    return events(spark, sf_dir).selectExpr("line_id", f"{_ROUGH} AS t").select("line_id", clean.fully_corrected(F.col("t"), ["button"]).alias("template"))


def _t26(spark, sf_dir):
    rows = events(spark, sf_dir).selectExpr("line_id", "CASE line_id % 4 WHEN 1 THEN '{name} - {id}: 5' WHEN 2 THEN content || ' {user} 0xab 10.2.3.4' ELSE content END AS t")
    return rows.select("line_id", "t", clean.post_processed(F.col("t")).alias("template"))


_CAMEL = "CASE line_id % 4 WHEN 1 THEN 'HTTPServer started OK: ' || content WHEN 2 THEN content || ' $dollar $end$' WHEN 3 THEN 'getUserById(x1) ' || content ELSE content END"


def _t28(spark, sf_dir):
    return events(spark, sf_dir).selectExpr("line_id", f"{_CAMEL} AS t").select("line_id", clean.bare_words(F.col("t")).alias("words"))


def _t30(spark, sf_dir):
    rows = _mac(spark, sf_dir)
    return rows.select("line_id", clean.content_skeleton(F.col("origin")).alias("whole"), clean.content_skeleton(F.col("h"), mac=True).alias("content"))


_BARE = "CASE line_id % 5 WHEN 1 THEN '[warn] ' || content WHEN 2 THEN 'jk2_init() Found child ' || content WHEN 3 THEN '[Sun Dec 04 04:47:44 2005] [error] ' || content ELSE content END"


def _e13(spark, sf_dir):
    rows = events(spark, sf_dir).selectExpr("line_id", f"{_BARE} AS t").select("line_id", augment.with_apache_header(F.col("t")).alias("line"))
    return rows.select("line_id", F.substring("line", 1, 26).isin(*augment.APACHE_TIMES).alias("timed"), F.expr("substr(line, 28)").alias("rest"))


def _e15(spark, sf_dir):
    rows = events(spark, sf_dir).select("line_id", F.length("content").cast("bigint").alias("size"), F.when(F.col("line_id") % 3 == 0, "high").otherwise("medium").alias("priority"))
    return augment.budgeted(rows, 50, [F.desc("size"), F.col("line_id")], high_only=True)


def _b10(spark, sf_dir):
    return augment.StructuralVariants().variants(orders(spark, sf_dir).select("line_id", "content"), 2).select("origin", "variant")


# ---- SQL ------------------------------------------------------------------------------------------


def _abstract(general, special):
    escaped = f"replace(regexp_escape({general}), '\\<\\*\\>', '(\\S+?)')"
    return rf"regexp_full_match({special}, replace({escaped}, '\ ', '\s+'))"


_KINDS = f"""cells AS (SELECT DISTINCT template AS truth, {_ERRING} AS parsed FROM log),
kinds AS (SELECT parsed, truth, CASE WHEN {_abstract('parsed', 'truth')} THEN 'OG' WHEN {_abstract('truth', 'parsed')} THEN 'UG' ELSE 'MX' END AS kind FROM cells),
found AS (SELECT parsed, CASE WHEN bool_and(parsed = truth) THEN 'SM' WHEN count(DISTINCT kind) = 1 THEN any_value(kind) ELSE 'MX' END AS outcome FROM kinds GROUP BY parsed)"""

_GARBAGE = "(trim(h) = '' OR regexp_matches(trim(h), '^(#|```|---|[*][*]|>)') OR (len(regexp_extract_all(h, '[一-鿿]')) > 0 AND len(regexp_extract_all(h, '[一-鿿]')) >= length(trim(h)) * 0.3::DOUBLE))"
_UUID = r"'\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b'"
_REASONS = rf"""CASE WHEN {_GARBAGE} THEN 'garbage/markdown line' WHEN regexp_matches(h, 'https?://') THEN 'generated log contains URL'
 WHEN regexp_matches(h, {_UUID}) THEN 'generated log contains UUID' WHEN regexp_matches(h, '/[A-Za-z0-9_./-]{{40,}}') THEN 'generated log contains very long path'
 WHEN (contains(h, '{{') OR contains(h, '}}')) AND contains(h, ':') AND NOT regexp_matches(h, '\{{\{{[0-9]+,\s*[0-9]+\}},\s*\{{[0-9]+,\s*[0-9]+\}}\}}') THEN 'generated log contains JSON'
 WHEN length(h) > 400 THEN 'generated log too long (>400 chars)'"""
_COMPONENT = r"nullif(regexp_extract({}, '^[A-Z][a-z]{{2}}\s+\d{{1,2}}\s+\d{{2}}:\d{{2}}:\d{{2}}\s+[\w-]+\s+([\w.]+)\[\d+\]:', 1), '')"
_LINE = r"'^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+[\w-]+\s+[\w. ]+\[\d+\]:\s+(.+)'"


def _replaced(text, steps):
    for pattern, by in steps:
        text = f"regexp_replace({text}, {q(pattern)}, {q(by)}, 'g')"
    return text


def _skeleton(text, mac=False):
    if mac:
        text = f"(CASE WHEN regexp_matches({text}, {_LINE}) THEN regexp_extract({text}, {_LINE}, 1) ELSE {text} END)"
    steps = [(r"\b\d+(\.\d+)?\b", "<*>"), ("0x[0-9a-fA-F]+", "<*>"), (r"(\d+\.){3}\d+", "<*>"), (r"\ben\d+\b", "<*>"), (_UUID[1:-1], "<*>"), (r"\(\d+\)", "(<*>)"), (r"\(\d+/\d+\)", "(<*>)"), (" +", " ")]
    return f"trim({_replaced(text, steps)})"


def _refused(s, t, word, test):
    """The refusals of a line, in order, that these data can have; others would be null on both sides."""
    words = "list_transform(['ksfetch', 'CalDAV', 'NSLayoutConstraint'], lambda w: CASE WHEN contains(%s, w) THEN '%s' || w END)" % (s, word)
    tests = [
        ("WindowServer+authw", f"contains({s}, 'WindowServer') AND contains({s}, 'authw')"),
        ("contains URL", f"regexp_matches({s}, 'https?://')"),
        ("contains UUID", f"regexp_matches({s}, {_UUID})"),
        ("0x count >=2", f"len(regexp_extract_all({s}, '0x')) >= 2"),
        ("length >180", f"length({s}) > 180"),
        ("template <*> >6", f"len(regexp_extract_all({t}, '<[*]>')) > 6"),
    ]
    return f"list_filter(list_concat({words}, [{', '.join(f"CASE WHEN {c} THEN '{test}{n}' END" for n, c in tests)}]), lambda r: r IS NOT NULL)"


def _risk(s, t):
    def over(c, most):
        return f"greatest(0, length({s}) - length(replace({s}, '{c}', '')) - {most})"

    excess = "(" + " + ".join(over(c, n) for c, n in (("(", 4), (")", 4), ("[", 4), ("]", 4), ("{", 2), ("}", 2), ("<", 2), (">", 2))) + ")"
    stars = f"len(regexp_extract_all({t}, '<[*]>'))"
    rules = [
        (2, f"regexp_matches({s}, 'https?://')", "'contains URL'"),
        (2, f"regexp_matches({s}, {_UUID})", "'contains UUID'"),
        (2, f"regexp_matches({s}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{{2,}}')", "'contains email'"),
        (1, f"regexp_matches({s}, '[{{}}]') AND contains({s}, ':')", "'contains JSON-like braces'"),
        (1, f"regexp_matches({s}, '/[A-Za-z0-9_./-]{{40,}}')", "'contains very long path'"),
        (2, f"regexp_matches({s}, '0x[0-9a-fA-F]{{6,}}')", "'contains hex object address'"),
        (1, f"length({s}) > 220", f"'origin length > 220 (' || length({s}) || ')'"),
        (1, f"{stars} > 6", f"'template <*> count > 6 (' || {stars} || ')'"),
        (1, f"{excess} > 4", f"'excessive brackets (' || {excess} || ')'"),
    ]
    score = " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for n, c, _ in rules)
    reasons = ", ".join(f"CASE WHEN {c} THEN {r} END" for _, c, r in rules)
    return f"({score})", f"list_filter([{reasons}], lambda r: r IS NOT NULL)"


_HARD_T = f"hard AS (SELECT line_id, {_HARD} AS h, {_WILD} AS template FROM log)"
_MAC_T = f"{_HARD_T}, mac AS (SELECT line_id, template, {_HEAD} || h AS origin, {_TOLD} AS h FROM hard)"
_SAFE = "contains(origin, 'Internal name did not resolve to internal address!')"
_ENDS = r"""\s,!;:=|"''\[\](){}"""
_ALL_ENDS = _ENDS + r".\-+@#$%&"


def _t25_sql():
    def by(text, ends, rule):
        return f"array_to_string(list_transform(regexp_extract_all({text}, '[{ends}]|[^{ends}]+'), lambda x: CASE WHEN {rule} THEN '<*>' ELSE x END), '')"

    t = by("trim(regexp_replace(t, '\\s+', ' ', 'g'))", _ENDS, "regexp_full_match(x, '(/[^/]+)+')")
    t = by(t, _ALL_ENDS, "lower(x) IN ('true', 'false', 'null', 'root', 'admin', 'button') OR regexp_full_match(x, '[0-9]+') OR regexp_full_match(x, '[^/]*<[*]>[^/]*')")
    return _replaced(t, [(r"<[*]>([.]<[*]>)+", "<*>"), (r"(<[*]>){2,}", "<*>")])


_PUNCT = r"[!-/:-@\[-`{-~]"
_T28 = f"""w AS (SELECT line_id, string_split(trim(regexp_replace(regexp_replace({_CAMEL}, '[:()=,"{{}}@\\[\\]|;.]', ' ', 'g'), '\\s+', ' ', 'g')), ' ') AS w FROM log),
s AS (SELECT line_id, array_to_string(list_transform(w, lambda x: CASE WHEN upper(x) = x AND lower(x) <> x THEN lower(x) ELSE x END), ' ') AS s FROM w),
p AS (SELECT line_id, regexp_split_to_array(trim(regexp_replace(regexp_replace(s, '([A-Z]+)', ' \\1', 'g'), '([A-Z][a-z]+)', ' \\1', 'g')), '\\s+') AS w FROM s)
SELECT line_id, array_to_string(list_filter(list_transform(list_filter(w, lambda x: NOT regexp_matches(x, '[0-9]')), lambda x: lower(regexp_replace(x, '{_PUNCT}', '', 'g'))), lambda x: x <> ''), ' ') AS words FROM p"""
_EXPLAINED = "(line = '' OR regexp_matches(line, '^(```|#|[*][*]|>|[|])') OR regexp_matches(line, '[一-鿿]') OR regexp_matches(lower(line), 'markdown|here are|example|output'))"
_PATTERNS = " ".join(f"WHEN '{d}' THEN regexp_matches(line, {q(p)})" for d, p in augment.FORMATS)
_SKEL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '\b\d{{6}}\b', '<NUM>', 'g'), '\b\d{{10,}}\b', '<NUM>', 'g'), '\bblk_-?\d+\b', 'blk_<NUM>', 'g'), '(\d+\.){{3}}\d+', '<IP>', 'g'), '-?\b\d+(\.\d+)?\b', '<NUM>', 'g')"
_RANKED = f"""m AS (SELECT regexp_replace(content, {q(r'\b[0-9][0-9]\b')}, '<*>', 'g') AS template, count(*) AS n FROM log GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n, template) AS k, count(*) OVER () AS total FROM m)"""

QUERIES = {
    "a20_outcomes": (lambda spark, sf_dir: metrics.outcome(_erring(spark, sf_dir)), with_log("log_events", f"{_KINDS} SELECT parsed, outcome FROM found")),
    "a20_rates": (
        _a20r,
        with_log("log_events", f"{_KINDS}, s AS (SELECT (count(*) FILTER (outcome = 'SM'))::DOUBLE AS sm, count(*)::DOUBLE AS n, (SELECT count(DISTINCT template) FROM log)::DOUBLE AS t, (count(*) FILTER (outcome = 'OG'))::DOUBLE AS og, (count(*) FILTER (outcome = 'UG'))::DOUBLE AS ug, (count(*) FILTER (outcome = 'MX'))::DOUBLE AS mx FROM found) SELECT round(CASE WHEN sm = 0 THEN 0 ELSE 2 * (sm / n) * (sm / t) / (sm / n + sm / t) END, 6)::DOUBLE AS f1, round(sm / n, 6)::DOUBLE AS pta, round(sm / t, 6)::DOUBLE AS rta, round(og / n, 6)::DOUBLE AS og, round(ug / n, 6)::DOUBLE AS ug, round(mx / n, 6)::DOUBLE AS mx FROM s"),
    ),
    "a18_lenient": (
        _a18l,
        with_log("log_events", "p AS (SELECT template AS t, CASE WHEN line_id % 3 = 0 THEN replace(replace(template, 'user=<*>', '<*>'), '<*>,', '<*>') ELSE template END AS p FROM log) SELECT round(avg((list_transform(string_split(t, ' '), lambda x: CASE WHEN contains(x, '<*>') THEN '<*>' ELSE x END) = string_split(p, ' '))::INT), 6)::DOUBLE AS pa FROM p"),
    ),
    "p05_abstract_pairs": (
        _p05,
        with_log("log_events", f"m AS (SELECT {masked_sql('content')} AS t FROM log UNION SELECT {_ERRING} FROM log) SELECT a.t AS general, b.t AS special, {_abstract('a.t', 'b.t')} AS abstract FROM m a JOIN m b ON len(string_split(a.t, ' ')) = len(string_split(b.t, ' '))"),
    ),
    "p06_rarest": (_p06(30), with_log("log_items", f"{_RANKED} SELECT template, n FROM r WHERE k <= floor(total / 100.0 * 30)")),
    "p06_most_frequent": (_p06(-10), with_log("log_items", f"{_RANKED} SELECT template, n FROM r WHERE k > total - floor(total / 100.0 * 10)")),
    "p07_garbage": (lambda spark, sf_dir: _hard(spark, sf_dir).select("line_id", augment.garbage(F.col("h")).alias("garbage")), with_log("log_events", f"{_HARD_T} SELECT line_id, {_GARBAGE} AS garbage FROM hard")),
    "p08_format_ok": (_p08, with_log("log_events", f"f AS (SELECT line_id, {_SET} AS dataset, {_FORMED} AS line FROM log) SELECT line_id, dataset, NOT {_EXPLAINED} AND CASE dataset {_PATTERNS} ELSE true END AS ok FROM f")),
    "p09_same_template": (
        _p09,
        with_log("log_events", f"o AS (SELECT line_id, '{_SAMPLES[3][1]}' || content AS origin, CASE line_id % 4 WHEN 0 THEN translate(content, '0123456789', '1234567890') WHEN 1 THEN content || ' x' ELSE content END AS c FROM log), d AS (SELECT line_id, origin, CASE WHEN line_id % 8 > 5 THEN c ELSE '081110 203616 148 INFO dfs.DataNode: Packet ' || c END AS line FROM o) SELECT line_id, origin <> line AND regexp_matches(line, '^[0-9]{{6}} [0-9]{{6}} ') AND {_SKEL.format(t='origin')} = {_SKEL.format(t='line')} AS same FROM d".replace("{{", "{").replace("}}", "}")),
    ),
    "p10_reject_reasons": (_p10, with_log("log_events", f"{_HARD_T} SELECT line_id, {_REASONS} END AS reason FROM hard")),
    "p10_reject_mac": (
        _p10m,
        with_log("log_events", f"{_MAC_T}, c AS (SELECT *, {_COMPONENT.format('origin')} AS own, {_COMPONENT.format('h')} AS other, {_refused('h', chr(39) * 2, 'Mac reject keyword in generated: ', 'Mac reject: ')} AS r, {_skeleton('origin', True)} AS a, {_skeleton('h', True)} AS b FROM mac) SELECT line_id, {_REASONS} WHEN NOT regexp_matches(h, {_LINE}) THEN 'not a complete Mac log line' WHEN own <> other THEN 'Component mismatch: ' || own || ' vs ' || other WHEN len(r) > 0 THEN r[1] WHEN a <> b THEN 'skeleton mismatch:' || chr(10) || '  ORI: ' || left(a, 120) || chr(10) || '  GEN: ' || left(b, 120) END AS reason FROM c"),
    ),
    "p11_risk_scores": (_p11, with_log("log_events", f"{_HARD_T}, r AS (SELECT line_id, {_risk('h', 'template')[0]} AS score, {_risk('h', 'template')[1]} AS reasons FROM hard) SELECT line_id, score::BIGINT AS score, array_to_string(reasons, '; ') AS reasons, score <= 2 AS ok FROM r")),
    "p11_risk_mac": (
        _p11m,
        with_log(
            "log_events",
            f"{_MAC_T}, r AS (SELECT *, {_risk('origin', 'template')[0]} AS s0, {_risk('origin', 'template')[1]} AS r0, {_refused('origin', chr(39) * 2, 'keyword: ', '')} AS no, {_refused('origin', 'template', 'strong_reject_keyword: ', 'strong_reject: ')} AS never, {_SAFE} AS safe, len(regexp_extract_all(template, '<[*]>')) AS stars FROM mac), "
            "t AS (SELECT *, CASE WHEN safe THEN greatest(0, s0 + CASE WHEN len(no) > 0 THEN 3 ELSE 0 END - 2) ELSE s0 + CASE WHEN len(no) > 0 THEN 3 ELSE 0 END END AS score FROM r), u AS (SELECT *, score <= 1 AND length(origin) <= 220 AND stars <= 8 AS good FROM t) "
            "SELECT line_id, score::BIGINT AS score, array_to_string(list_concat(list_concat(r0, no), CASE WHEN safe THEN ['Mac whitelist: risk lowered'] ELSE [] END), '; ') AS reasons, safe OR (len(never) = 0 AND good) AS ok, CASE WHEN safe THEN 'mac_whitelist' WHEN len(never) > 0 THEN 'strong_reject: ' || array_to_string(never, '; ') WHEN good THEN 'quality_pass' ELSE 'quality_fail: risk=' || score || ' len=' || length(origin) || ' stars=' || stars END AS reason FROM u",
        ),
    ),
    "t25_fully_corrected": (_t25, with_log("log_events", f"r AS (SELECT line_id, {_ROUGH} AS t FROM log) SELECT line_id, {_t25_sql()} AS template FROM r")),
    "t26_post_processed": (_t26, None),
    "t28_bare_words": (_t28, with_log("log_events", _T28)),
    "t30_content_skeletons": (_t30, with_log("log_events", f"{_MAC_T} SELECT line_id, {_skeleton('origin')} AS whole, {_skeleton('h', True)} AS content FROM mac")),
    "e13_apache_headers": (
        _e13,
        with_log("log_events", f"b AS (SELECT line_id, {_BARE} AS t FROM log) SELECT line_id, true AS timed, CASE WHEN starts_with(t, '[Sun Dec') THEN substr(t, 28) WHEN starts_with(t, '[warn] ') THEN t WHEN starts_with(t, 'jk2_init') THEN '[notice] ' || t ELSE '[error] ' || t END AS rest FROM b"),
    ),
    "e15_high_only": (_e15, with_log("log_events", "SELECT line_id, length(content)::BIGINT AS size, 'high' AS priority FROM log WHERE line_id % 3 = 0 ORDER BY size DESC, line_id LIMIT 50")),
    "b10_structural_variants": (_b10, None),
}
