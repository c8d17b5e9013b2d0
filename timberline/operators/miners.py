"""Template miners: each gives (line_id, template) for lines of (line_id, content)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.ordering import with_checkpoints

from . import grams
from .clean import WILDCARD, anchor_text, coarse_key, last_masked, masked, normalised, one_spaced, spaced, without
from .counted import with_counts
from .tokens import message_split, plain_tokens


def by_mask(lines: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """The masked content is the template."""
    return lines.select("line_id", masked(F.col("content"), patterns).alias("template"))


def template_counts(assigned: DataFrame) -> DataFrame:
    """(template, n)."""
    return assigned.groupBy("template").agg(F.count("*").alias("n"))


def structured_counts(structured: DataFrame, template: str = "EventTemplate") -> DataFrame:
    """(template, n) of a structured table; rows whose template is null or blank don't count."""
    return template_counts(structured.select(F.trim(F.col(template)).alias("template")).where(F.col("template") != ""))


def distinct_contents(lines: DataFrame, text: Column, key: Sequence[str] = ()) -> DataFrame:
    """(text, n, first_line) of equal texts (of equal ``key``, such as a data set): what miners work on, so that
    repeated lines cost nothing."""
    return lines.groupBy(*key, text.alias("text")).agg(F.count("*").alias("n"), F.min("line_id").alias("first_line"))


def merged_numbers(lines: DataFrame, text: Column, key: Sequence[str] = ()) -> DataFrame:
    """(text, place, line_ids) of rows with an array ``line_ids``: equal texts merged, ``place`` their first row by
    line_id, and one row for each array that was merged, so that a text of very many lines is in no single row.
    Rows of one text by line_id hold its numbers as they were first seen; a null text is a text of its own."""
    keyed = lines.select(*key, "line_id", "line_ids", text.alias("text"))
    first = keyed.groupBy(*key, "text").agg(F.min("line_id").alias("place"))
    a, b = keyed.alias("a"), first.alias("b")
    same = reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*key, "text")])
    return a.join(b, same).select(*[f"a.{c}" for c in key], "a.text", "place", "line_id", "line_ids")


# ---- positional frequencies -------------------------------------------------------------------------


def brain_text(text: Column, masks: Sequence[str] = (), removed: Sequence[str] = (), literals: Sequence[str] = ()) -> Column:
    return one_spaced(spaced(without(masked(text, masks), removed), literals))


def positional_frequencies(texts: DataFrame) -> DataFrame:
    """(pos, tok, freq) over (text, n)."""
    return texts.select("n", F.posexplode(F.split("text", " ")).alias("pos", "tok")).groupBy("pos", "tok").agg(F.sum("n").alias("freq"))


def brain(lines: DataFrame, masks: Sequence[str] = (), removed: Sequence[str] = (), literals: Sequence[str] = (), threshold: int | Column = 4, digits_vary: bool | Column = False, key: Sequence[str] = (), text: Column | None = None, variable: Callable[[Column], Column] | None = None) -> DataFrame:
    """Positional-frequency mining over masked, de-duplicated contents, for each log that ``key`` tells apart.

    Each content's root is the frequency that most of its tokens have (of equals, the one that comes
    first); contents with equal length, root and root count are a group. Where the group's first content
    has another frequency than the root, a position with ``threshold`` distinct tokens or more makes all
    of them variable, anywhere in the group. Tokens with a slash or a mask, and numbers, are variable too.

    Masking comes before de-duplication, so that frequencies are sums of counts. Contents travel by the number of
    their first line: one join by (pos, tok) finds frequencies, one regrouping puts the tokens of a content into
    one row, and the rest works on rows and on small tables by group.

    ``text``: the masked content, where its rules come from a table; thresholds may be columns of the key then.
    ``variable``: which tokens are variable by themselves, in place of those with a slash or a mask, and numbers.
    """
    key = list(key)
    keyed = lines.select(*key, "line_id", (brain_text(F.col("content"), masks, removed, literals) if text is None else text).alias("text"))
    texts = distinct_contents(keyed, F.col("text"), key)
    spread = texts.select(*key, "n", F.col("first_line").alias("id"), F.posexplode(F.split("text", " ")).alias("pos", "tok"))
    freq = spread.groupBy(*key, "pos", "tok").agg(F.sum("n").alias("freq"))
    placed = with_counts(spread.drop("n"), freq, [*key, "pos", "tok"], "freq")
    rows = placed.groupBy(*key, "id").agg(F.array_sort(F.collect_list(F.struct("pos", "tok", "freq"))).alias("t"))
    rows = rows.withColumn("freqs", F.transform("t", lambda x: x["freq"])).withColumn("kinds", F.array_distinct("freqs"))
    rows = rows.withColumn("times", F.transform("kinds", lambda f: F.size(F.filter("freqs", lambda x: x == f))))
    rows = rows.withColumn("root_times", F.array_max("times")).withColumn("root", F.expr("kinds[array_position(times, root_times) - 1]"))
    with_checkpoints(lines.sparkSession)
    rows = rows.select(*key, "id", "t", F.size("t").alias("width"), "root", "root_times").checkpoint()
    group = [*key, "width", "root", "root_times"]
    # where the first content of each group leaves the root
    leaves = F.filter(F.transform("t", lambda x: F.when(x["freq"] != F.col("root"), x["pos"])), lambda p: p.isNotNull())
    leads = rows.groupBy(*group).agg(F.min(F.struct("id", leaves.alias("open"))).alias("lead")).select(*group, F.explode("lead.open").alias("pos"))
    spots = leads.groupBy(*group).agg(F.collect_list("pos").alias("open"))
    digits = F.lit(digits_vary) if isinstance(digits_vary, bool) else digits_vary
    plainly = variable or (lambda tok: tok.contains("/") | tok.contains(WILDCARD) | tok.rlike(r"^-?\d+$"))
    own = lambda tok: plainly(tok) | (digits & tok.rlike(r"\d"))
    # the tokens of a group by place, once each: those at open places, and those that may be variable elsewhere; what is known
    # of groups is sent to the rows, as a large group would stand in one task
    opened = rows.join(F.broadcast(spots), group, "left").withColumn("open", F.coalesce("open", F.array().cast("array<int>")))
    spread = opened.select(*group, "open", F.explode(F.filter("t", lambda x: F.array_contains("open", x["pos"]) | ~own(x["tok"]))).alias("x"))
    seen = spread.select(*group, "x.pos", "x.tok", F.array_contains("open", F.col("x.pos")).alias("is_open")).distinct().checkpoint()
    held = seen.where("is_open")
    many = held.groupBy(*group, "pos").agg(F.count("*").alias("kinds")).where(F.col("kinds") >= threshold).select(*group, "pos")
    varying = held.join(F.broadcast(many), [*group, "pos"]).select(*group, "tok").distinct()
    spots = many.groupBy(*group).agg(F.collect_list("pos").alias("many"))
    rows = rows.join(F.broadcast(spots), group, "left").withColumn("many", F.coalesce("many", F.array().cast("array<int>")))
    # tokens that vary at one place of their group and stand at another one too
    others = seen.where(~own(F.col("tok"))).join(F.broadcast(many), [*group, "pos"], "left_anti").select(*group, "tok")
    both = others.distinct().join(varying, [*group, "tok"], "left_semi").checkpoint()
    out = lambda x: F.when(F.array_contains("many", x["pos"]) | own(x["tok"]), WILDCARD).otherwise(x["tok"])
    plain = rows.withColumn("out", F.transform("t", out))
    if not both.isEmpty():
        seen = plain.select(*key, "id", *group[len(key) :], F.posexplode("out").alias("pos", "tok")).join(both, [*group, "tok"], "left_semi")
        seen = seen.groupBy(*key, "id").agg(F.collect_list("pos").alias("more"))
        plain = plain.join(seen, [*key, "id"], "left")
        plain = plain.withColumn("out", F.when(F.col("more").isNull(), F.col("out")).otherwise(F.transform("out", lambda x, i: F.when(F.array_contains("more", i), WILDCARD).otherwise(x))))
    whole = F.array_join(F.transform("t", lambda x: x["tok"]), " ")
    templates = plain.select(*key, whole.alias("text"), F.array_join("out", " ").alias("template"))
    return keyed.join(templates, [*key, "text"]).select(*key, "line_id", "template")


# ---- n-grams ----------------------------------------------------------------------------------------


def logram(lines: DataFrame, masks: Sequence[str] = (), bigram_threshold: int | Column = 15, trigram_threshold: int | Column = 10, key: Sequence[str] = (), text: Column | None = None) -> DataFrame:
    """N-gram mining in two passes, for each log that ``key`` tells apart: a rare trigram makes its tokens candidates,
    and a candidate is variable unless a bigram with a neighbour is frequent (for the first token, above the threshold
    and to the right only; the last one's right neighbour is the first). Only the last mask counts.

    Counted are grams of all lines, first by slots of their hashes; only those whose slot is frequent are counted by themselves. What
    is known of frequent ones is sent to the lines; where they are too many, or two share a hash, they are looked up by a shuffle in the
    distinct texts, which travel by the number of their first line. ``text``: the masked content, where its rules come from a
    table; thresholds may be columns of the key then."""
    key = list(key)
    keyed = lines.select(*key, "line_id", F.array_join(plain_tokens(last_masked(F.col("content"), masks) if text is None else text), " ").alias("text"))
    with_checkpoints(lines.sparkSession)
    pair, triple = (F.lit(t) if isinstance(t, int) else t for t in (bigram_threshold, trigram_threshold))
    fixed = isinstance(bigram_threshold, int) and isinstance(trigram_threshold, int)
    if fixed:
        least = min(bigram_threshold, trigram_threshold)
    else:
        least = lines.agg(F.min(F.least(pair, triple))).first()[0] or 1
    table, sent = grams.often(keyed, (2, 3), int(least), key)
    frequent = F.col("freq") >= F.when(F.col("gram").startswith("3 "), triple).otherwise(pair)
    if fixed:
        held = grams.told(keyed, sent, bigram_threshold, trigram_threshold, key).checkpoint()
    else:
        held = table.select("hash", F.when(frequent, grams.kind(pair)).alias("kind")).groupBy("hash").agg(F.max("kind").alias("kind"), F.count("*").alias("n"))
        held = held.where("kind is not null").checkpoint()
    n, most = held.agg(F.count("*"), F.max("n")).first()
    if n <= grams.SENT and (most or 1) == 1:
        return grams.in_place(keyed, held, sent, key)
    texts = distinct_contents(keyed, F.col("text"), key).select(*key, "text", F.col("first_line").alias("id"))
    known = grams.found(texts, table.where(frequent).select(*key, "gram", "freq"), (2, 3), sent, key).select(*key, "id", grams.mark(pair).alias("mark"))
    marks = known.groupBy(*key, "id").agg(F.collect_list("mark").alias("marks"))
    made = texts.join(marks, [*key, "id"], "left").select(*key, "text", grams.templates("text", "marks").alias("template"))
    return keyed.join(made, [*key, "text"]).select(*key, "line_id", "template")


# ---- word anchors -----------------------------------------------------------------------------------


def anchor_frequencies(texts: DataFrame, key: Sequence[str] = ()) -> DataFrame:
    """(width, pos, word, freq) of distinct texts: how many hold a word at a place; wildcards are none."""
    from .tokens import anchors

    spread = texts.select(*key, F.size(anchors(F.col("text"))).alias("width"), F.posexplode(anchors(F.col("text"))).alias("pos", "word"))
    return spread.where(F.col("word") != WILDCARD).groupBy(*key, "width", "pos", "word").agg(F.count("*").alias("freq"))


def _anchor_texts(lines: DataFrame, masks, removed, literals, clean: bool, key: list[str], text: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Lines with their cleaned texts; (key, text, n) of distinct texts."""
    if text is None:
        text = anchor_text(F.col("content"), masks, removed, literals) if clean else F.col("content")
    keyed = lines.select(*key, "line_id", text.alias("text"))
    return keyed, distinct_contents(keyed, F.col("text"), key).select(*key, "text", "n")


def anchor_fixpoint(texts: DataFrame, threshold: float | Column = 0.4, key: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(key, text, template) of distinct texts (key, text), and (key, width, step, low, left) of the passes.

    In a pass the rarest anchors (words at their place, among texts of one width) become wildcards; a text whose share of
    wildcards exceeds ``threshold`` leaves as it was before the pass, and the others, some of which are equal now, go on.
    The first pass takes the least frequency over all widths; then widths don't meet any more, so that all of
    them take their own passes at the same time. A width without anchors ends.

    Each pass is a few joins over the distinct texts that are left, and a checkpoint; the driver only asks whether any are.
    ``threshold`` may be a column of the key, so that a sweep of thresholds is one run.
    """
    from .tokens import anchors

    key = list(key)
    own = [*key, "width", "words"]
    with_checkpoints(texts.sparkSession)
    words = anchors(F.col("text"))
    held = texts.select(*key, "text", F.col("text").alias("now"), words.alias("words")).withColumn("width", F.size("words")).checkpoint()
    least = anchor_frequencies(texts, key).groupBy(*key).agg(F.min("freq").alias("low"))
    done, told, step = [], [], 0
    while not held.isEmpty():
        distinct = held.select(*own).distinct()
        at = distinct.select(*own, F.posexplode("words").alias("pos", "word")).where(F.col("word") != WILDCARD)
        counts = at.groupBy(*key, "width", "pos", "word").agg(F.count("*").alias("freq"))
        if step == 0:
            known = counts.select(*key, "width").distinct()
            low = known.join(least, key) if key else known.crossJoin(F.broadcast(least))  # one row
        else:
            low = counts.groupBy(*key, "width").agg(F.min("freq").alias("low"))
        rare = counts.join(low, [*key, "width"]).where(F.col("freq") == F.col("low")).select(*key, "width", "pos", "word")
        hits = at.join(rare, [*key, "width", "pos", "word"]).groupBy(*own).agg(F.collect_set("pos").alias("places"))
        moved = distinct.join(hits, own, "left").join(low, [*key, "width"], "left")
        new = F.when(F.col("places").isNull(), F.col("words")).otherwise(F.transform("words", lambda w, i: F.when(F.array_contains("places", i), WILDCARD).otherwise(w)))
        moved = moved.withColumn("new", new)
        share = F.size(F.filter("new", lambda w: w == WILDCARD)) / F.size("new")
        moved = moved.withColumn("leaves", F.col("low").isNull() | (share > threshold)).select(*own, "low", "new", "leaves")
        after = held.join(moved, own).checkpoint()
        done.append(after.where("leaves").select(*key, "text", F.col("now").alias("template")))
        going = after.where("not leaves").select(*key, "width", "low", "new").distinct().groupBy(*key, "width").agg(F.count("*").alias("left"))
        lows = after.groupBy(*key, "width").agg(F.max(F.coalesce("low", F.lit(0))).alias("low"))
        told.append(lows.join(going, [*key, "width"], "left").select(*key, "width", F.lit(step).alias("step"), "low", F.coalesce("left", F.lit(0)).cast("bigint").alias("left")))
        held = after.where("not leaves").select(*key, "text", F.array_join("new", " ").alias("now"), F.col("new").alias("words"), "width")
        step += 1
    if not done:
        return texts.select(*key, "text", F.col("text").alias("template")), texts.select(*key, F.lit(0).alias("width"), F.lit(0).alias("step"), F.lit(0).cast("bigint").alias("low"), F.lit(0).cast("bigint").alias("left")).limit(0)
    return reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, told)


def by_anchors(lines: DataFrame, masks: Sequence[str] = (), removed: Sequence[str] = (), literals: Sequence[str] = (), threshold: float | Column = 0.4, clean: bool = True, key: Sequence[str] = (), text: Column | None = None) -> DataFrame:
    """(key, line_id, template) by :func:`anchor_fixpoint`, for each log that ``key`` tells apart. ``text``: the cleaned
    content, where its rules come from a table; ``threshold`` may be a column of the key then."""
    key = list(key)
    keyed, texts = _anchor_texts(lines, masks, removed, literals, clean, key, text)
    found, _ = anchor_fixpoint(texts, threshold, key)
    return keyed.join(found, [*key, "text"]).select(*key, "line_id", "template")


# ---- column consensus -------------------------------------------------------------------------------


def consensus(lines: DataFrame, key: str) -> DataFrame:
    """(key, template, n): a token that all lines of a group have at a place stays, all else is a wildcard."""
    once = lines.groupBy(key, "content").agg(F.count("*").alias("c"))
    split = once.select(key, "c", message_split(normalised(F.col("content"))).alias("tokens"))
    sizes = split.groupBy(key).agg(F.sum("c").alias("n"))
    at = split.select(key, "c", F.posexplode("tokens").alias("pos", "tok")).groupBy(key, "pos").agg(F.sum("c").alias("there"), F.min("tok").alias("low"), F.max("tok").alias("high"))
    said = at.join(sizes, key).select(key, "pos", F.when((F.col("there") == F.col("n")) & (F.col("low") == F.col("high")) & ~F.col("low").isin(WILDCARD, "*"), F.col("low")).otherwise(WILDCARD).alias("out"))
    rows = said.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "out"))), lambda s: s["out"]).alias("parts"))
    once = F.filter("parts", lambda t, i: ~((t == WILDCARD) & (i > 0) & (F.get(F.col("parts"), i - 1) == WILDCARD)))
    return rows.select(key, F.array_join(once, " ").alias("template")).join(sizes, key)


# ---- anchors over normalised contents ---------------------------------------------------------------


def by_normalised_anchors(lines: DataFrame, masks: Sequence[str] = (), removed: Sequence[str] = (), literals: Sequence[str] = (), threshold: float = 0.4, variants: DataFrame | None = None) -> DataFrame:
    """(line_id, template): anchor mining over normalised contents, then each group's template anew by
    consensus of its own lines.

    ``variants`` (line_id below 0, content) take part in the mining only.
    """
    rows = lines.select("line_id", "content")
    rows = rows.unionByName(variants.select("line_id", "content")) if variants is not None else rows
    found = by_anchors(rows.withColumn("content", normalised(F.col("content"))), masks, removed, literals, threshold)
    own = lines.select("line_id", "content").join(found.where("line_id >= 0").withColumnRenamed("template", "group"), "line_id")
    return own.select("line_id", "group").join(consensus(own, "group").select("group", "template"), "group").select("line_id", "template")


def chosen_groups(lines: DataFrame, literals: Sequence[str] = (), below: float = 0.35, most: int = 8) -> DataFrame:
    """(rank, key, group_size, diversity, line_id, content) of the groups that variants shall be made for: those of
    the lowest diversity, then the smallest, with their first line as a seed."""
    from . import diversity

    groups = diversity.low_groups(diversity.estimated_groups(lines, literals), below)
    keyed = lines.select("line_id", "content", coarse_key(F.col("content"), literals).alias("key"))
    seeds = keyed.groupBy("key").agg(F.min(F.struct("line_id", "content")).alias("seed"))
    best = groups.join(seeds, "key").orderBy("diversity", "group_size", "seed.line_id").limit(most)
    rank = F.row_number().over(Window.orderBy("diversity", "group_size", "seed.line_id"))  # ``most`` rows
    return best.select(rank.alias("rank"), "key", "group_size", "diversity", "seed.line_id", "seed.content")


def adaptive(lines: DataFrame, masks: Sequence[str] = (), removed: Sequence[str] = (), literals: Sequence[str] = (), threshold: float = 0.4, source=None, trigger: float = 0.35, most: int = 8, variants: int = 10, known_ld: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Anchor mining that first estimates the log's diversity: (line_id, template), and one row about the run.

    Where ``source`` (a VariantSource) is given and the diversity (``known_ld``, or the estimate) is at ``trigger``
    or below, variants of the seeds of the lowest groups take part in the mining, under ids below 0: the first
    variant of the first group is -100001. They are in no result.
    """
    from . import diversity

    spark = lines.sparkSession
    estimate = diversity.estimated_diversity(diversity.estimated_groups(lines, literals)).first()  # one row
    ld = estimate["global_ld"] if known_ld is None else known_ld
    enabled, made = source is not None and ld <= trigger, None
    if enabled:
        seeds = chosen_groups(lines, literals, most=most).select(F.col("rank").alias("line_id"), "content")
        each = source.variants(seeds, variants).where(F.trim("variant") != "")
        number = F.row_number().over(Window.partitionBy("origin").orderBy("variant"))
        made = each.select((-(F.col("origin") * 100_000 + number)).cast("bigint").alias("line_id"), F.col("variant").alias("content"))
        with_checkpoints(spark)
        made = made.checkpoint()
    found = by_normalised_anchors(lines, masks, removed, literals, threshold, made)
    row = (lines.count(), float(ld), float(estimate["global_ld"]), estimate["low_groups"], estimate["groups"], made.count() if enabled else 0, enabled, float(trigger))
    names = "input_lines bigint, global_ld double, estimated_ld double, low_groups bigint, coarse_groups bigint, generated_lines bigint, enabled boolean, trigger double"
    return found, spark.createDataFrame([row], names)


def sweep(lines: DataFrame, standard: DataFrame, thresholds: Sequence[float], masks: Sequence[str] = (), removed: Sequence[str] = (), literals: Sequence[str] = ()) -> DataFrame:
    """(threshold, pa, pta, rta, templates) of the anchor miner: one run, in which the threshold tells logs apart."""
    from .metrics import template_accuracy

    each = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    _, texts = _anchor_texts(lines, masks, removed, literals, True, [])
    texts = texts.select(each, "text", "n")
    found, _ = anchor_fixpoint(texts, F.col("threshold"), ["threshold"])
    made = texts.join(found, ["threshold", "text"]).groupBy("threshold", "template").agg(F.sum("n").alias("n"))
    sizes = made.groupBy("threshold").agg(F.count("*").alias("templates"))
    return template_accuracy(made, standard.select(each, "template"), key=["threshold"]).join(sizes, "threshold").select("threshold", "pa", "pta", "rta", "templates")


def trace(lines: DataFrame, masks: Sequence[str] = (), removed: Sequence[str] = (), literals: Sequence[str] = (), threshold: float = 0.4) -> DataFrame:
    """(step, n): distinct texts at first, after cleaning, and after each pass of the anchor miner (pass 1, 2 ...).

    A pass of the whole log is one of those lengths whose minimum is the smallest then; lengths tell their own
    passes, of which there are few, and the driver puts them in order."""
    spark = lines.sparkSession
    keyed, texts = _anchor_texts(lines, masks, removed, literals, True, [])
    by: dict[int, list] = {}
    for r in anchor_fixpoint(texts, threshold)[1].collect():  # a row for each length and pass
        by.setdefault(r["width"], []).append((r["step"], r["low"], r["left"]))
    waiting = {w: sorted(steps) for w, steps in by.items()}
    left, passes, first = {w: 0 for w in by}, [], True
    while any(waiting.values()):
        low = min(steps[0][1] for steps in waiting.values() if steps)
        for w, steps in waiting.items():
            if steps and (first or steps[0][1] == low):
                left[w] = steps.pop(0)[2]
        first = False
        passes.append(sum(left.values()))
    rows = [("initial", lines.select("content").distinct().count()), ("cleaned", keyed.select("text").distinct().count())]
    return spark.createDataFrame(rows + [(f"pass {k}", n) for k, n in enumerate(passes, 1)], "step string, n bigint")


def cleaning_trace(lines: DataFrame, masks: Sequence[str] = (), literals: Sequence[str] = ()) -> DataFrame:
    """(step, n): distinct texts at first and after cleaning, before the first pass."""
    steps = (("initial", F.col("content")), ("cleaned", anchor_text(F.col("content"), masks, (), literals)))
    rows = [lines.select(F.lit(name).alias("step"), text.alias("text")) for name, text in steps]
    return rows[0].unionByName(rows[1]).groupBy("step").agg(F.count_distinct("text").alias("n"))
