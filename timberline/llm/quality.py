"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes for a document (1), against it (-1) or abstains (0). Expectation-maximisation over
the counts of vote patterns of *all* documents that pass the base test estimates, for each rule, how often it votes which way
on good and on bad documents (its accuracies), and the share of good documents. A document's verdict
is its posterior probability of being good, not the conjunction of all rules.

A vote against doesn't refuse a document by itself, nor does its absence keep it: rules that are no better on good
documents than on bad ones come out with no weight, and several weak votes can outweigh one that is lacking.

At most 3 ** len(RULES) vote patterns exist, whatever the number of documents; their counts are all
that reaches the driver.

Cases: null and empty texts have no words, fail the base test and are not kept; repeated rows each get
their own result; a posterior of exactly the threshold keeps; extra columns pass through ``keep_good``; an empty table gives an empty result (the
starting accuracies hold then).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import staged

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Characters that end a sentence.
ENDS = '.!?"'

_BLANKS = "\t\n\x0b\x0c\r"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÉÈÊËÍÎÏÑÓÔÖÚÛÜ"

#: (name, against when, for when): SQL over the columns of :func:`features`. One rule for a signal: what symbols,
#: word lengths, ends of lines, capitals, digits, repeated lines, size and longest word tell.
RULES = (
    ("symbols", "5 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    ("lengths", "10 * word_chars < 44 * n_words or 10 * word_chars > 63 * n_words", "10 * word_chars between 46 * n_words and 58 * n_words"),
    ("ends", "20 * n_ended_lines < 19 * n_lines", "n_ended_lines = n_lines"),
    ("capitals", "100 * n_capitals < word_chars or 100 * n_capitals > 3 * word_chars", "1000 * n_capitals between 12 * word_chars and 25 * word_chars"),
    ("digits", "100 * n_digits > word_chars", "n_digits = 0"),
    ("repeats", "n_dup_lines > 0", "n_lines >= 4"),
    ("size", "n_words < 50", "n_words >= 100"),
    ("longest", "longest_word > 30", "longest_word <= 20"),
)

#: A document is kept at this posterior or above.
THRESHOLD = 0.5

#: The share of its votes that a rule is first taken to cast against, on a good and on a bad document.
START = (0.02, 0.3)

#: Rounds of expectation-maximisation at most, and the change of the good share that ends it.
ROUNDS, CHANGE = 200, 1e-9


def _sql(text: str) -> str:
    return "'" + "".join({"\\": "\\\\", "'": "\\'", "\n": "\\n", "\t": "\\t", "\r": "\\r"}.get(c, c) if c not in "\x0b\x0c" else f"\\u{ord(c):04x}" for c in text) + "'"


def repeat_words(words: str, width: int = 5) -> str:
    """SQL: how many elements of the array ``words`` lie in a run of ``width`` that occurs twice or more.

    Runs are compared by a 64-bit hash within one document. Only a document that has a repeated run
    has its runs sorted.
    """
    run = ", ".join(f"w[i + {k}]" for k in range(width))
    covered = (
        f"aggregate(transform(q, (v, i) -> if(i + 1 < size(q), least({width}, q[i + 1] - v), {width})), 0L, (a, b) -> a + b)"
    )
    places = (
        "sort_array(transform(filter(p, (e, i) -> (i > 0 and p[i - 1].h = e.h) or (i + 1 < size(p) and p[i + 1].h = e.h)), e -> e.at))"
    )
    repeated = (
        f"transform(array(sort_array(transform(g, (h, i) -> struct(h as h, i as at)))), p -> transform(array({places}), q -> {covered})[0])[0]"
    )
    return (
        f"transform(array({words}), w -> if(size(w) < {width}, 0L, "
        f"transform(array(transform(sequence(0, size(w) - {width}), i -> xxhash64({run}))), "
        f"g -> if(size(array_distinct(g)) = size(g), 0L, {repeated}))[0]))[0]"
    )


def _count_of(chars: str, text: str = "t") -> str:
    return f"cast(length({text}) - length(translate({text}, {_sql(chars)}, '')) as bigint)"


def features(text: str = "text") -> Column:
    """A struct of counts over the whole of one text column, named by ``text``."""
    of_words = (
        "struct(cast(size(words) as bigint) as n_words, cast(coalesce(array_max(transform(words, w -> length(w))), 0) as bigint) as longest_word, "
        f"{repeat_words('words')} as n_repeat_words)"
    )
    words = f"array_remove(split(translate(t, {_sql(_BLANKS)}, '     '), ' '), '')"
    ended = f"instr({_sql(ENDS)}, right(trim(trailing {_sql(' ' + _BLANKS)} from l), 1)) > 0"
    of_lines = (
        "struct(cast(size(ls) as bigint) as n_lines, cast(size(ls) - size(array_distinct(ls)) as bigint) as n_dup_lines, "
        f"cast(size(filter(ls, l -> {ended})) as bigint) as n_ended_lines)"
    )
    lines = f"filter(split(t, '\\n'), l -> length(translate(l, {_sql(' ' + _BLANKS)}, '')) > 0)"
    parts = (
        f"struct(transform(array({words}), words -> {of_words})[0] as a, transform(array({lines}), ls -> {of_lines})[0] as b, "
        f"cast(length(translate(t, {_sql(' ' + _BLANKS)}, '')) as bigint) as word_chars, {_count_of(SYMBOLS)} as n_symbols, "
        f"{_count_of(_CAPITALS)} as n_capitals, {_count_of('0123456789')} as n_digits)"
    )
    flat = (
        "struct(f.a.n_words as n_words, f.word_chars as word_chars, f.n_symbols as n_symbols, f.b.n_dup_lines as n_dup_lines, "
        "f.a.n_repeat_words as n_repeat_words, f.b.n_lines as n_lines, f.b.n_ended_lines as n_ended_lines, f.a.longest_word as longest_word, "
        "f.n_capitals as n_capitals, f.n_digits as n_digits)"
    )
    # one-element arrays bind a value, so that no later use computes it again
    return F.expr(f"transform(array(coalesce(`{text}`, '')), t -> transform(array({parts}), f -> {flat})[0])[0]")


def base_failed(prefix: str = "") -> Column:
    return F.expr(f"{prefix}n_words < 10 or 100 * {prefix}n_repeat_words > 20 * {prefix}n_words")


def votes() -> list[Column]:
    """One column for each rule: 1 for, -1 against, 0 abstains; no rule votes on a text without words."""
    return [F.expr(f"cast(case when n_words = 0 then 0 when {bad} then -1 when {good} then 1 else 0 end as int)").alias(f"vote_{name}") for name, bad, good in RULES]


def fit(featured: DataFrame) -> dict:
    """Accuracies and the good share, by expectation-maximisation over the counts of all vote patterns
    of the documents that pass the base test.

    Starts from START, under which votes against tell bad documents from good ones; where no document has a
    word, that stays.
    """
    names = [f"vote_{name}" for name, _, _ in RULES]
    rows = featured.where(~base_failed()).select(*votes()).groupBy(*names).count().collect()  # 3 ** rules rows at most
    patterns = sorted((tuple(r[n] for n in names), r["count"]) for r in rows)
    return estimate(patterns)


def estimate(patterns: list[tuple[tuple[int, ...], int]]) -> dict:
    """The model from vote patterns and how often each occurs. An abstaining rule says nothing."""
    total = sum(n for _, n in patterns)
    model = {"good": 0.8, "against": [START for _ in RULES]}
    for _ in range(ROUNDS if total else 0):
        sums = [{1: [0.5, 1.0], 0: [0.5, 1.0]} for _ in RULES]  # votes against, votes; half a vote each way against zeros
        good = 1.0
        for pattern, n in patterns:
            p = posterior_of(model, pattern)
            good += p * n
            for j, vote in enumerate(pattern):
                for y, share in ((1, p), (0, 1 - p)) if vote else ():
                    sums[j][y][0] += share * n * (vote < 0)
                    sums[j][y][1] += share * n
        moved = abs(good / (total + 2) - model["good"])
        model = {"good": good / (total + 2), "against": [(by[1][0] / by[1][1], by[0][0] / by[0][1]) for by in sums]}
        if moved < CHANGE:
            break
    return model


def _odds(model: dict, j: int, vote: int) -> float:
    on_good, on_bad = model["against"][j]
    return math.log(on_good / on_bad if vote < 0 else (1 - on_good) / (1 - on_bad)) if vote else 0.0


def posterior_of(model: dict, pattern: tuple[int, ...]) -> float:
    x = math.log(model["good"] / (1 - model["good"])) + sum(_odds(model, j, v) for j, v in enumerate(pattern))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def posterior(model: dict) -> Column:
    """The posterior probability of a good document, as an expression over the vote columns."""
    x = F.lit(math.log(model["good"] / (1 - model["good"])))
    for j, (name, _, _) in enumerate(RULES):
        vote = F.col(f"vote_{name}")
        x = x + F.when(vote == 1, _odds(model, j, 1)).when(vote == -1, _odds(model, j, -1)).otherwise(_odds(model, j, 0))
    return 1 / (1 + F.exp(-x))


def verdicts(featured: DataFrame, model: dict) -> DataFrame:
    """Adds votes, posterior, base_failed and kept to the columns of :func:`features`."""
    known = [c for c in featured.columns if c not in {"base_failed", "posterior", "kept"} and not c.startswith("vote_")]
    out = featured.select(*known, *votes()).withColumn("posterior", posterior(model)).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= THRESHOLD))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, the votes, posterior, base_failed and kept for every row of ``docs``.

    The texts are read once: their counts are written to the shared folder, and fitting and scoring
    both work on those.
    """
    featured = staged(docs.select("doc_id", features().alias("f")).select("doc_id", "f.*"), "quality")
    return verdicts(featured, fit(featured))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Rows and counts are written to the shared folder once: a filter on an expression over the counts
    would have them computed again for each of its parts.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    counted = staged(docs.select(whole, features().alias("f")), "counted")
    model = fit(counted.select("f.*"))
    return verdicts(counted.select("row", "f.*"), model).where("kept").select("row.*")
