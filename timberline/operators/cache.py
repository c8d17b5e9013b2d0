"""A cache of templates in front of a costly source of templates.

Templates lie in a trie of tokens; a wildcard takes any run of tokens, an empty one at the end. A line
that no template fits is given to the source; its answer joins the cache, or is merged with the most
similar template among those below the deepest node that the line reached.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.functions.ordering import with_checkpoints
from timberline.sources.versions import Versions

from .clean import WILDCARD
from .online import common
from .streamed import in_order, named

#: Tokens, and the separators that stay.
_TOKEN = re.compile(r"""[=|()]|[^\s!"#$%&'()+,\-/:;=?@.\[\\\]^_`{|}~]+""")

#: Tokens of lists, and numbers of similar templates, that a cache remembers what was found for.
HELD = 2_000_000

#: A log is read in parts while a task finds no more than ``NEW`` lines that change its cache, all of them no more than ``MOST``, in so many ``ROUNDS``.
NEW, MOST, ROUNDS = 5_000, 5_000, 8


def split(text: str) -> list[str]:
    """Tokens and single separators, without punctuation but ``= | ( )``; no two wildcards together."""
    parts = _TOKEN.findall(text)
    if WILDCARD not in text:
        return parts
    out: list[str] = []
    for part in parts:
        token = WILDCARD if WILDCARD in part else part
        if not (token == WILDCARD and out and out[-1] == WILDCARD):
            out.append(token)
    return out


class TemplateOracle(Protocol):
    """Names the template of a line. Network models are left to callers."""

    def template(self, content: str, similar: list[str]) -> str: ...


class Rules:
    """The default source: numbers, addresses, hexadecimal values and paths are variables."""

    #: The forms, in order.
    FORMS = (r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?\b", r"\b0x[0-9a-fA-F]+\b", r"(?:/[\w.\-]+)+", r"\bblk_-?\d+\b", r"\b\d+(?:\.\d+)?\b")

    def template(self, content: str, similar: list[str]) -> str:
        for form in self.FORMS:
            content = re.sub(form, WILDCARD, content)
        content = re.sub(r"[^\s=:,]*<\*>[^\s=:,]*", WILDCARD, content)
        return re.sub(r"(?:<\*>){2,}", WILDCARD, content)


class TemplateCache:
    """Templates by number; ``found`` says which one a line has."""

    def __init__(self, merge_above: float = 0.8):
        self.merge_above = merge_above
        self.root: dict = {}
        self.templates: list[str] = []
        #: templates that were merged into others: their paths stay, and count in how deep a line gets
        self.merged: list[str] = []
        #: the tokens of all paths, and what was found for token lists, others than these left out, since the last change
        self.known: set[str] = set()
        self.held: dict[tuple, tuple[int | None, list[int]]] = {}
        self.room = HELD

    def _leaves(self, node: dict) -> Iterator[int]:
        for step, child in node.items():
            if step is None:
                yield child
            else:
                yield from self._leaves(child)

    def find(self, tokens: list[str]) -> tuple[int | None, list[int]]:
        """The template that fits, with the most fixed tokens and then the fewest wildcards; or none, and the
        numbers of those below the deepest node reached (two steps at least)."""
        fits: set[int] = set()
        deepest, reached = 1, []
        todo, seen = [(self.root, 0, 0)], set()
        while todo:
            node, at, depth = todo.pop()
            if (id(node), at) in seen:
                continue
            seen.add((id(node), at))
            if depth > deepest:
                deepest, reached = depth, [node]
            elif depth == deepest and depth > 1:
                reached.append(node)
            if at == len(tokens):
                if None in node:
                    fits.add(node[None])
                wild = node.get(WILDCARD)
                if wild is not None and None in wild:
                    fits.add(wild[None])
                continue
            if tokens[at] in node:
                todo.append((node[tokens[at]], at + 1, depth + 1))
            wild = node.get(WILDCARD)
            if wild is not None:
                if None in wild:
                    fits.add(wild[None])
                for k in range(at + 1, len(tokens)):
                    if tokens[k] in wild:
                        todo.append((wild, k, depth + 1))
        if len(fits) == 1:
            return fits.pop(), []
        if fits:
            return min(fits, key=lambda k: (-sum(t != WILDCARD for t in split(self.templates[k])), self.templates[k].count(WILDCARD), k)), []
        return None, sorted({k for node in reached for k in self._leaves(node)})

    def _forget(self) -> None:
        self.held.clear()
        self.room = HELD

    def _path(self, template: str) -> dict:
        """The end of a template's path, which is made where it is none."""
        self._forget()
        node = self.root
        for token in split(template):
            self.known.add(token)
            node = node.setdefault(token, {})
        return node

    def _store(self, k: int) -> None:
        self._path(self.templates[k]).setdefault(None, k)

    def _remove(self, k: int) -> None:
        self._forget()
        node = self.root
        for token in split(self.templates[k]):
            node = node.get(token, {})
        if node.get(None) == k:
            del node[None]

    def add(self, template: str, similar: list[int]) -> int:
        """The number of the template, -1 for an empty or bare one. A merge changes what earlier lines' number says."""
        if template.strip() in ("", WILDCARD):
            return -1
        words = template.split()
        best, share = None, 0.0
        for k in similar:
            other = self.templates[k].split()
            if len(other) == len(words):
                now = len(common(words, other)) / len(words)
                if now > share:
                    best, share = k, now
        if best is not None and share > self.merge_above:
            self._remove(best)
            self.merged.append(self.templates[best])
            self.templates[best] = " ".join(a if a == b else WILDCARD for a, b in zip(words, self.templates[best].split(), strict=True))
            self._store(best)
            return best
        self.templates.append(template)
        self._store(len(self.templates) - 1)
        return len(self.templates) - 1

    def restore(self, template: str) -> None:
        """A template that was known before, under the next number."""
        self.templates.append(template)
        self._store(len(self.templates) - 1)

    def restore_merged(self, template: str) -> None:
        """The path of a template that was merged into another one."""
        self._path(template)
        self.merged.append(template)

    def number(self, content: str, source: TemplateOracle) -> int:
        tokens, known = split(content), self.known
        # tokens of no path are alike to all of them
        kind = tuple([t if t in known else None for t in tokens])
        if (told := self.held.get(kind)) is None:
            told = self.find(tokens)
            self.room -= len(kind) + len(told[1]) + 1
            if self.room < 0:
                self._forget()
            self.held[kind] = told
        found, similar = told
        if found is not None:
            return found
        return self.add(source.template(content, [self.templates[k] for k in similar]), similar)


#: The number of rows that hold a merged template's path in a table of templates.
MERGED = -2


def _run(rows: DataFrame, source: TemplateOracle | None, known: DataFrame | None) -> DataFrame:
    """(line_id, number, template, cache) of (line_id, content, cache); merged templates as rows without a line."""
    source = source or Rules()
    lines = rows.select("cache", F.lit(1).alias("step"), "line_id", F.lit(None).cast("bigint").alias("number"), F.col("content").alias("text"))
    if known is not None:
        lines = lines.unionByName(known.select("cache", F.lit(0).alias("step"), F.lit(None).cast("bigint").alias("line_id"), "number", F.col("template").alias("text")))

    def mine(of: Iterator[dict]) -> Iterator[tuple]:
        cache = TemplateCache()
        for row in of:
            if row["step"]:
                yield row["cache"], row["line_id"], cache.number(row["text"], source), None
            else:
                cache.restore_merged(row["text"]) if row["number"] == MERGED else cache.restore(row["text"])
        yield from ((row["cache"], None, k, t) for k, t in enumerate(cache.templates))
        yield from ((row["cache"], None, MERGED, t) for t in cache.merged)

    found = in_order(lines, ["cache"], ["step", "number", "line_id", "text"], mine)
    told = named(found, ["cache"]).withColumn("template", F.coalesce("template", F.lit(WILDCARD)))
    merged = found.where(F.col("line_id").isNull() & (F.col("number") == MERGED))
    return told.unionByName(merged).select("line_id", "number", "template", "cache")


#: The place of a line in its log; lines without a number come first.
Place = tuple[bool, int, str]


class _Reader:
    """The caches of logs at a line, which the lines that change them (``leads``, in order) make."""

    def __init__(self, leads: dict[str | None, list[Place]]):
        self.leads, self.source = leads, Rules()
        self.caches: dict[str | None, TemplateCache] = {}
        #: of each cache how many leads it has read, and the place of its last change
        self.read: dict[str | None, int] = {}
        self.last: dict[str | None, Place] = {}

    def number(self, log: str | None, at: Place) -> tuple[int, bool]:
        """The line's number, and whether it changes the cache without being a lead; a line before the last change starts anew."""
        if log not in self.caches or log in self.last and at < self.last[log]:
            self.caches[log], self.read[log] = TemplateCache(), 0
            self.last.pop(log, None)
        cache, leads = self.caches[log], self.leads.get(log, ())
        while self.read[log] < len(leads) and leads[self.read[log]] <= at:
            self.last[log] = leads[self.read[log]]
            cache.number(self.last[log][2], self.source)
            self.read[log] += 1
        before = len(cache.templates) + len(cache.merged)
        k = cache.number(at[2], self.source)
        new = len(cache.templates) + len(cache.merged) != before
        if new:
            self.last[log] = at
        return k, new


def _placed(batch: pa.RecordBatch) -> list[tuple[Place, str | None]]:
    """(place, cache) of a batch's lines, in order."""
    rows = [((n is not None, n or 0, text), log) for n, text, log in zip(batch["line_id"].to_pylist(), batch["content"].to_pylist(), batch["cache"].to_pylist(), strict=True)]
    rows.sort(key=lambda row: row[0])
    return rows


def _changing(leads: dict[str | None, set[Place]]) -> tuple[dict[str | None, list[Place]], dict[str | None, list[str]]] | None:
    """Of some lines of each log those that change its cache when they are read in order, and the templates it has then. None
    where they are too many, or where a line's template doesn't fit it, as then an equal line would change the cache too."""
    kept, made, source, n = {}, {}, Rules(), 0
    for log, places in leads.items():
        cache, kept[log] = TemplateCache(), []
        for place in sorted(places):
            before = len(cache.templates) + len(cache.merged)
            k = cache.number(place[2], source)
            if len(cache.templates) + len(cache.merged) == before:
                continue
            kept[log].append(place)
            n += 1
            if n > MOST or cache.find(split(place[2]))[0] != k:
                return None
        made[log] = cache.templates
    return kept, made


def _in_parts(rows: DataFrame) -> DataFrame | None:
    """(line_id, template, cache) of (line_id, content, cache) by the default source; None for logs that don't settle.

    A cache changes at few lines; between these a line's number is a matter of the line alone. So tasks read their own lines, in any split
    of the log, with the changes that are known, and tell which further lines would change a cache. When all lines have been read and
    none does, what is known is what one reader of the whole log would have, and lines are numbered by it where they are."""

    def news(leads: dict) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader, found = _Reader(leads), []
            for batch in batches:
                found += [(at, log) for at, log in _placed(batch) if reader.number(log, at)[1]] if len(found) <= NEW else []
            columns = [[at[1] if at[0] else None for at, _ in found], [at[2] for at, _ in found], [log for _, log in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)], ["line_id", "content", "cache"])

        return rows.mapInArrow(run, "line_id bigint, content string, cache string")

    leads: dict[str | None, list[Place]] = {}
    for _ in range(ROUNDS):
        told = news(leads).collect()
        if not told:
            break
        more = {log: set(places) for log, places in leads.items()}
        for r in told:
            more.setdefault(r.cache, set()).add((r.line_id is not None, r.line_id or 0, r.content))
        if (known := _changing(more)) is None:
            return None
        leads, made = known
    else:
        return None
    if not leads:
        made = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(leads)
        for batch in batches:
            placed = _placed(batch)
            numbers = [reader.number(log, at)[0] for at, log in placed]
            columns = [
                pa.array([at[1] if at[0] else None for at, _ in placed], pa.int64()),
                pa.array([WILDCARD if k < 0 else made[log][k] for k, (_, log) in zip(numbers, placed, strict=True)], pa.string()),
                pa.array([log for _, log in placed], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["line_id", "template", "cache"])

    return rows.mapInArrow(run, "line_id bigint, template string, cache string")


def cached(lines: DataFrame, source: TemplateOracle | None = None, key: str | None = None, known: DataFrame | None = None, keep_key: bool = False) -> DataFrame:
    """(line_id, template), one cache for each ``key`` (or for the whole log), lines in order; a line whose
    template is empty or bare has ``<*>``.

    ``known``: (cache, number, template) that caches start with, such as :func:`templates_of` gave before and a table
    has kept; so a log can be read on from where it was left. ``keep_key``: the key is in the result, as ``cache``."""
    rows = lines.select("line_id", "content", (F.col(key).cast("string") if key else F.lit("")).alias("cache"))
    found = _in_parts(rows.withColumn("line_id", F.col("line_id").cast("bigint"))) if source is None and known is None else None
    if found is None:
        found = _run(rows, source, known).where("line_id is not null")
    if known is not None:
        return found.select("line_id", "template", "number", "cache")
    return found.select("line_id", "template", *(["cache"] if keep_key else []))


def templates_of(found: DataFrame, known: DataFrame) -> DataFrame:
    """(cache, number, template): what a cache holds after :func:`cached` with ``known``: of each number its latest
    template, which is that of its last lines, or the one known before."""
    new = found.where("number >= 0").groupBy("cache", "number").agg(F.max("template").alias("new"))
    return known.select("cache", "number", "template").join(new, ["cache", "number"], "full").select("cache", "number", F.coalesce("new", "template").alias("template"))


def read_on(lines: DataFrame, path: str, source: TemplateOracle | None = None, key: str | None = None) -> DataFrame:
    """(cache, line_id, number, template) of all lines read so far, in this run and those before it under ``path``.

    Of each log only the lines behind its last one are read, with the templates that its cache held then. Templates, lines
    and last lines are one version of the state, so that a run that fails, or that is given the same lines again, changes
    nothing; a log that is read in parts has the result of a log that is read at once."""
    spark = lines.sparkSession
    kept = Versions(spark, path)
    at = kept.latest()
    known, done, last = (kept.read(name, at) for name in ("templates", "lines", "last"))
    own = lines.select("line_id", "content", (F.col(key).cast("string") if key else F.lit("")).alias("cache"))
    if last is not None:
        own = own.join(last, "cache", "left").where("last is null or line_id > last").drop("last")
    if at and own.isEmpty():
        return _read(kept, at)
    with_checkpoints(spark)
    held = known if known is not None else spark.createDataFrame([], "cache string, number bigint, template string")
    found = _run(own, source, held)
    new = found.where("line_id is not null").select("cache", "line_id", "number")
    merged = found.where(F.col("number") == MERGED).select("cache", "number", "template").unionByName(held.where(F.col("number") == MERGED)).distinct()
    ends = new.groupBy("cache").agg(F.max("line_id").alias("last"))
    tables = {
        "templates": templates_of(found, held.where("number >= 0")).unionByName(merged),
        "lines": new if done is None else done.unionByName(new),
        "last": ends if last is None else ends.unionByName(last).groupBy("cache").agg(F.max("last").alias("last")),
    }
    return _read(kept, kept.commit(tables, at))


def _read(kept: Versions, at: int) -> DataFrame:
    named = kept.read("lines", at).join(kept.read("templates", at).where("number >= 0"), ["cache", "number"], "left")
    return named.select("cache", "line_id", "number", F.coalesce("template", F.lit(WILDCARD)).alias("template"))
