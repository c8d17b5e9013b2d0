"""Queries over lines of many collections, each with its own rules and thresholds, in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline import api
from timberline.operators import augment, chinese, miners, rules
from timberline.settings import LEGACY_MASKS, SETTINGS

from .mining import _cleaned_sql, anchors_sql, ngram_sql, positional_sql, positional_text_sql
from .shared import events, masked_sql, q, rounded, spaced_sql, split_sql, with_log

#: A raw line of each collection and the fields that it has: {c} the content, {n} a number, {d} two digits.
LINES = {
    "HDFS": ("0811{d} 2035{d} {n} INFO dfs.DataNode: {c}", "0811{d}|2035{d}|{n}|INFO|dfs.DataNode|{c}"),
    "Hadoop": ("2015-10-18 18:01:{d},978 INFO [main] org.App: {c}", "2015-10-18|18:01:{d},978|INFO|main|org.App|{c}"),
    "Spark": ("17/06/09 20:10:{d} INFO storage.Block: {c}", "17/06/09|20:10:{d}|INFO|storage.Block|{c}"),
    "Zookeeper": ("2015-07-29 19:04:{d},234 - WARN  [SendWorker:QuorumCnx@{n}] - {c}", "2015-07-29|19:04:{d},234|WARN|SendWorker|QuorumCnx|{n}|{c}"),
    "BGL": ("- 11{n} 2005.06.03 R02-M1 2005-06-03-15.42.{d}.36 R02-M1 RAS KERNEL INFO {c}", "-|11{n}|2005.06.03|R02-M1|2005-06-03-15.42.{d}.36|R02-M1|RAS|KERNEL|INFO|{c}"),
    "HPC": ("{n} node-{d} unix.hw state_change 1{n} 1 {c}", "{n}|node-{d}|unix.hw|state_change|1{n}|1|{c}"),
    "Thunderbird": ("- 11{n} 2005.11.09 dn{d} Nov 9 12:01:{d} dn{d}/dn crond[{n}]: {c}", "-|11{n}|2005.11.09|dn{d}|Nov|9|12:01:{d}|dn{d}/dn|crond|{n}|{c}"),
    "Windows": ("2016-09-28 04:30:{d}, Info                  CBS    {c}", "2016-09-28|04:30:{d}|Info|CBS|{c}"),
    "Linux": ("Jun 14 15:16:{d} combo sshd[{n}]: {c}", "Jun|14|15:16:{d}|combo|sshd|{n}|{c}"),
    "Android": ("03-17 16:13:{d}.811  {n}  2{n} D Power: {c}", "03-17|16:13:{d}.811|{n}|2{n}|D|Power|{c}"),
    "HealthApp": ("20171223-22:15:{d}:606|Step_LSC|{n}|{c}", "20171223-22:15:{d}:606|Step_LSC|{n}|{c}"),
    "Apache": ("[Sun Dec 04 04:47:{d} 2005] [notice] {c}", "Sun Dec 04 04:47:{d} 2005|notice|{c}"),
    "OpenSSH": ("Dec 10 06:55:{d} LabSZ sshd[{n}]: {c}", "Dec|10|06:55:{d}|LabSZ|{n}|{c}"),
    "OpenStack": ("nova-api.log 2017-05-16 00:00:{d}.008 {n} INFO nova.osapi [req-{n}] {c}", "nova-api.log|2017-05-16|00:00:{d}.008|{n}|INFO|nova.osapi|req-{n}|{c}"),
    "Mac": ("Jul  1 09:00:{d} calvisitor kernel[{n}]: {c}", "Jul|1|09:00:{d}|calvisitor|kernel|{n}||{c}"),
    "Proxifier": ("[10.30 16:49:{d}] chrome.exe - {c}", "10.30 16:49:{d}|chrome.exe|{c}"),
}

#: What both engines put in for {c}, {n} and {d}; every tenth line of a collection has another form.
_PARTS = {"c": "content", "n": "cast(line_id as string)", "d": "lpad(cast(line_id % 60 as string), 2, '0')"}
_ODD, _ODD_LINE = "line_id % 10 = 3", "concat('odd-', cast(line_id as string))"

#: Variables of many kinds, behind a content.
_TAIL = "concat(content, ' core.', cast(line_id % 9 as string), ' from /10.1.2.', cast(line_id % 200 as string), ':50010 took 12 KB at host.example.org:80 (pid=', cast(line_id as string), ') 0xff1', cast(line_id % 7 as string), ' on Jan 12:01:05, a_b [x] y-z..')"


def _filled(form: str) -> str:
    """A form as SQL of either engine."""
    import re

    parts = [_PARTS[p[1]] if p.startswith("{") else q(p) for p in re.split(r"(\{[cnd]\})", form) if p]
    return f"concat({', '.join(parts)})"


def _of_all(lines: DataFrame) -> DataFrame:
    """Every line once for each collection."""
    return lines.select(F.explode(F.array(*[F.lit(d) for d in LINES])).alias("dataset"), "line_id", "content")


def _t35(spark, sf_dir):
    lines = _of_all(events(spark, sf_dir))
    form = reduce(lambda out, d: out.when(F.col("dataset") == d, F.expr(_filled(LINES[d][0]))), LINES, F)
    raw = lines.withColumn("line", F.when(F.expr(_ODD), F.expr(_ODD_LINE)).otherwise(form)).drop("content")
    found = rules.split_headers(raw, rules.header_table(spark))
    return found.select("dataset", "line_id", "format_ok", "content", F.array_join(F.map_values("fields"), "|").alias("fields"))


def _t35_sql() -> str:
    fields = " ".join(f"WHEN '{d}' THEN {_filled(f)}" for d, (_, f) in LINES.items())
    names = ", ".join(q(d) for d in LINES)
    return with_log("log_events", f"SELECT dataset, line_id, NOT ({_ODD}) AS format_ok, CASE WHEN {_ODD} THEN {_ODD_LINE} ELSE content END AS content, CASE WHEN NOT ({_ODD}) THEN CASE dataset {fields} END END AS fields FROM log, unnest([{names}]) u(dataset)")


def _ruled(*kinds):
    def query(spark, sf_dir):
        lines = _of_all(events(spark, sf_dir)).withColumn("content", F.expr(_TAIL))
        return lines.select("dataset", "line_id", rules.rewritten_by(F.col("content"), rules.read(None, kinds), *kinds).alias("text"))

    return query


def _ruled_sql(each) -> str:
    branches = " ".join(f"WHEN '{d}' THEN {each(d)}" for d in LINES)
    names = ", ".join(q(d) for d in LINES)
    return with_log("log_events", f"tailed AS (SELECT line_id, {_TAIL} AS content FROM log) SELECT dataset, line_id, CASE dataset {branches} END AS text FROM tailed, unnest([{names}]) u(dataset)")


def _masks_sql(dataset: str) -> str:
    return masked_sql(masked_sql("content", SETTINGS[dataset].masks), SETTINGS[dataset].removed, "")


def _legacy_sql(dataset: str) -> str:
    """RE2 has no look-behind: what stands before is captured and put back."""
    import re

    text = "content"
    for p in LEGACY_MASKS.get(dataset, ()):
        before = re.match(r"\(\?<=((?:\\.|\[[^\]]*\]|[^()])*)\)", p)
        rest = p[before.end() :] if before else p
        after = re.search(r"\(\?=((?:\\.|[^()])*)\)$", rest)
        rest = rest[: after.start()] if after else rest
        kept = re.sub(r"(?<!\\)\((?!\?)", "(?:", rest)
        pattern = f"({before[1] if before else ''}){kept}({after[1] if after else ''})"
        text = f"regexp_replace({text}, {q(pattern)}, {q(chr(92) + '1<*>' + chr(92) + '2')}, 'g')"
    return text


def _p08(spark, sf_dir):
    """Lines in their collection's form, in another one's, and behind marks of an answer."""
    names = [d for d, _ in augment.FORMATS]
    lines = events(spark, sf_dir).select(F.explode(F.array(*[F.lit(d) for d in names])).alias("dataset"), "line_id", "content")
    form = reduce(lambda out, d: out.when(F.col("dataset") == d, F.expr(_filled(LINES[d][0]))), names, F)
    line = F.when(F.expr("line_id % 5 = 1"), F.concat(F.lit("odd "), "content")).when(F.expr("line_id % 5 = 2"), F.concat(F.lit("> "), form)).when(F.expr("line_id % 5 = 3"), F.concat(form, F.lit(" for example"))).otherwise(form)
    ok = reduce(lambda out, d: out.when(F.col("dataset") == d, augment.format_ok(d, F.col("line"))), names, F)
    return lines.withColumn("line", line).select("dataset", "line_id", ok.alias("ok"))


_P08 = with_log(
    "log_events",
    "SELECT dataset, line_id, line_id % 5 IN (0, 4) AS ok FROM log, unnest(['Android', 'Apache', 'BGL', 'HDFS', 'Hadoop', 'HealthApp', 'Mac', 'OpenSSH', 'OpenStack', 'Proxifier', 'Spark', 'Zookeeper']) u(dataset)",
)


def _s08(spark, sf_dir):
    rows = events(spark, sf_dir).selectExpr("line_id AS LineId", "CASE line_id % 4 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN NULL ELSE concat(template, ' ') END AS EventTemplate")
    return miners.structured_counts(rows)


# ---- levels, miners and collections in one run -------------------------------------------------------

_DATASETS = ("HDFS", "Zookeeper", "Spark")
_LEVELS = ("0.1", "0.9")
_MINERS = ("mask", "positional", "ngram", "anchor")
_DATASET = "CASE line_id % 3 WHEN 0 THEN 'HDFS' WHEN 1 THEN 'Zookeeper' ELSE 'Spark' END"
_LEVEL = "CASE WHEN line_id % 2 = 0 THEN '0.1' ELSE '0.9' END"


def _levelled(spark, sf_dir):
    """Lines of three collections at two levels."""
    return events(spark, sf_dir).selectExpr(f"{_LEVEL} AS level", f"{_DATASET} AS dataset", "line_id", "content", "template")


def _e18(spark, sf_dir):
    lines = _levelled(spark, sf_dir)
    standard = lines.select("level", "dataset", "template").distinct()
    return rounded(api.evaluate_all(lines, standard, _MINERS, key=("level", "dataset")))


def _mined(spark, sf_dir):
    lines = _levelled(spark, sf_dir)
    each = [api.mine_all(lines, m, key=("level", "dataset")).groupBy("level", "dataset", "template").agg(F.count("*").alias("n")).withColumn("miner", F.lit(m)) for m in _MINERS]
    return reduce(DataFrame.unionByName, each)


#: Thresholds of the three collections: positional, digits vary, bigrams, trigrams, anchors; and literals that are spaced.
_SET = {"HDFS": (2, False, 15, 10, 0.4, (":",)), "Zookeeper": (3, True, 15, 10, 0.3, (":", "=")), "Spark": (4, False, 15, 10, 0.86, (":",))}
_MASKS = {
    "HDFS": (r"blk_-?\d+", r"(\d+\.){3}\d+(:\d+)?"),
    "Zookeeper": (r"(/|)(\d+\.){3}\d+(:\d+)?",),
    "Spark": (r"(\d+\.){3}\d+", r"\b[KGTM]?B\b", r"([\w-]+\.){2,}[\w-]+"),
}


def _miner_sql(miner: str, dataset: str) -> tuple[str, str]:
    """CTEs over ``log``, and what selects (line_id, template)."""
    k, digits, two, three, share, literals = _SET[dataset]
    masks = _MASKS[dataset]
    if miner == "mask":
        return "", f"SELECT line_id, {masked_sql('content', masks)} AS template FROM log"
    if miner == "positional":
        return positional_sql(positional_text_sql("content", masks, literals), k, digits), "SELECT line_id, template FROM found"
    if miner == "ngram":
        masked = masked_sql("(' ' || content)", masks[-1:])
        return ngram_sql(masked, two, three), "SELECT line_id, template FROM found"
    texts = f"texts AS (SELECT line_id, {_cleaned_sql('content', masks, literals)} AS text FROM log)"
    return f"{texts}, {anchors_sql(threshold=str(share))}", "SELECT line_id, p.now AS template FROM texts JOIN passes p USING (text) WHERE p.leaves"


def _mined_sql() -> str:
    parts = []
    for level in _LEVELS:
        for d in _DATASETS:
            for m in _MINERS:
                ctes, select = _miner_sql(m, d)
                log = f"log AS (SELECT * FROM whole WHERE level = '{level}' AND dataset = '{d}')"
                own = f"WITH RECURSIVE {', '.join(x for x in (log, ctes) if x)} {select}"
                parts.append(f"SELECT '{m}' AS miner, '{level}' AS level, '{d}' AS dataset, template, count(*) AS n FROM ({own}) x GROUP BY template")
    return f"whole AS (SELECT {_LEVEL} AS level, {_DATASET} AS dataset, line_id, content, template FROM log), made AS MATERIALIZED ({' UNION ALL '.join(parts)})"


_E18 = with_log(
    "log_events",
    f"{_mined_sql()}, mk AS (SELECT *, {split_sql('template')} AS k FROM made), sk AS (SELECT level, dataset, {split_sql('template')} AS k FROM (SELECT DISTINCT level, dataset, template FROM whole) a), "
    "ours AS (SELECT miner, level, dataset, coalesce(sum(n) FILTER (hit), 0) / sum(n)::DOUBLE AS pa, count(*) FILTER (hit) / count(*)::DOUBLE AS pta FROM (SELECT *, (level, dataset, k) IN (SELECT (level, dataset, k) FROM sk) AS hit FROM mk) a GROUP BY ALL), "
    "theirs AS (SELECT miner, s.level, s.dataset, avg(((miner, s.level, s.dataset, s.k) IN (SELECT (miner, level, dataset, k) FROM mk))::INT) AS rta FROM sk s, (SELECT DISTINCT miner FROM made) m GROUP BY ALL) "
    "SELECT miner, level, dataset, round(pa, 6)::DOUBLE AS pa, round(pta, 6)::DOUBLE AS pta, round(rta, 6)::DOUBLE AS rta FROM ours JOIN theirs USING (miner, level, dataset)",
)

# ---- alarms in Chinese -------------------------------------------------------------------------------

#: A small dictionary, and the words that a line of each kind is made of.
_WORDS = (("虚拟", 50), ("虚拟机", 40), ("机", 9), ("告警", 60), ("发生", 30), ("生告", 2), ("磁盘", 25), ("使用", 20), ("使用率", 12), ("率", 3), ("，", 100), ("请", 30), ("检查", 40))
_NUMBER, _NAME = "cast(line_id % 90 as string)", "concat('vm', cast(line_id % 40 as string))"
_VIEW = "content like 'user %'"
_ALARM = f"case when {_VIEW} then concat('虚拟机', {_NAME}, '发生告警，使用率', {_NUMBER}, '%') else concat('磁盘 /dev/sd', cast(line_id % 3 as string), ' 请检查') end"
_ALARM_WORDS = f"case when {_VIEW} then concat_ws(' ', '虚拟机', {_NAME}, '发生', '告警', '，', '使用率', concat({_NUMBER}, '%')) else concat_ws(' ', '磁盘', '␣', concat('/dev/sd', cast(line_id % 3 as string)), '␣', '请', '检查') end"


def _alarms(spark, sf_dir):
    return events(spark, sf_dir).selectExpr("line_id", f"{_ALARM} AS content"), spark.createDataFrame(list(_WORDS), "word string, freq bigint")


def _t33(spark, sf_dir):
    lines, dictionary = _alarms(spark, sf_dir)
    cut = chinese.tokens(lines.select(F.col("content").alias("text")), dictionary)
    return lines.join(cut, F.col("content") == F.col("text")).select("line_id", F.regexp_replace(F.array_join("tokens", " "), " {3}", " ␣ ").alias("words"))


def _m01z(spark, sf_dir):
    return miners.template_counts(chinese.brain(*_alarms(spark, sf_dir), threshold=4))


_VARIES_Z = "contains(g.tok, '%') OR contains(g.tok, '*') OR regexp_matches(g.tok, '^-?[0-9]+$')"
_M01Z = with_log(
    "log_events",
    f"{positional_sql(_ALARM_WORDS, 4, varies=_VARIES_Z)} SELECT replace(replace(replace(template, '<*>', '*'), ' ', ''), '␣', ' ') AS template, count(*) AS n FROM found GROUP BY 1",
)

QUERIES = {
    "t33_chinese_words": (_t33, with_log("log_events", f"SELECT line_id, {_ALARM_WORDS} AS words FROM log")),
    "m01_brain_chinese": (_m01z, _M01Z),
    "e18_runs": (_e18, _E18),
    "e18_mined": (_mined, with_log("log_events", f"{_mined_sql()} SELECT miner, level, dataset, template, n FROM made")),
    "p08_formats_by_collection": (_p08, _P08),
    "s08_structured_counts": (_s08, with_log("log_events", "SELECT template, count(*) AS n FROM log WHERE line_id % 4 = 3 GROUP BY 1")),
    "t35_headers": (_t35, _t35_sql()),
    "t36_masks": (_ruled("mask", "removed"), _ruled_sql(_masks_sql)),
    "t36_legacy_masks": (_ruled("legacy mask"), _ruled_sql(_legacy_sql)),
    "t09_spaced_collections": (_ruled("spaced"), _ruled_sql(lambda d: spaced_sql("content", SETTINGS[d].spaced))),
}
