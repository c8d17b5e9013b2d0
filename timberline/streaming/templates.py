"""Templates of log streams: counts by event-time window, and parse trees kept as state, whole or by path."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from timberline.operators.clean import WILDCARD, masked
from timberline.operators.online import ParseTree
from timberline.operators.tokens import plain_tokens


def windowed_counts(lines: DataFrame, patterns: Sequence[str], time: str = "ts", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, template, n) for each window; lines later than the watermark are dropped by Spark."""
    made = lines.withWatermark(time, late).select(time, masked(F.col("content"), patterns).alias("template"))
    return made.groupBy(F.window(time, width).alias("w"), "template").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "template", "n")


def _keyed(lines: DataFrame, patterns: Sequence[str]) -> DataFrame:
    tokens: Column = plain_tokens(masked(F.col("content"), patterns))
    return lines.select("line_id", tokens.alias("tokens")).withColumn("width", F.size("tokens"))


def parse_stream(lines: DataFrame, patterns: Sequence[str], depth: int = 4, similarity: float = 0.5) -> DataFrame:
    """(line_id, template) of a stream of (line_id, content), one parse tree for each token count as state.

    Within a batch lines go by line_id; a line's template is what its cluster is when it arrives.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tree = pickle.loads(state.get[0]) if state.exists else ParseTree(depth, similarity)
        rows = pd.concat(list(batches)).sort_values("line_id")
        out = [" ".join(tree.templates[tree.add(list(t))]) for t in rows["tokens"]]
        state.update((pickle.dumps(tree),))
        yield pd.DataFrame({"line_id": rows["line_id"], "template": out})

    keyed = _keyed(lines, patterns)
    return keyed.groupBy("width").applyInPandasWithState(step, "line_id bigint, template string", "tree binary", "append", "NoTimeout")


# ---- state by path ----------------------------------------------------------------------------------

#: The state store that state by path needs.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class PathClusters(StatefulProcessor):
    """The clusters of one path of a parse tree, each an entry of a map.

    Lines of a trigger go by line_id. A line joins the cluster with the greatest share of equal tokens (of equals the one
    with the most wildcards, then the oldest), if that is ``similarity`` or more, and is told that cluster's template. A cluster that no
    line has joined for ``idle`` of event time goes; its timer looks after it. With ``ttl``, entries also end by processing time."""

    def __init__(self, similarity: float, idle_ms: int, ttl_ms: int | None):
        self.similarity, self.idle_ms, self.ttl_ms = similarity, idle_ms, ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.clusters = handle.getMapState("clusters", "number int", "tokens array<string>, lines bigint, last bigint", *([self.ttl_ms] if self.ttl_ms else []))
        self.next = handle.getValueState("next", "number int")

    def _best(self, held: dict[int, tuple], tokens: list[str]) -> int | None:
        best, found = (-1.0, -1, 0), None
        for k, (template, _, _) in held.items():
            same = sum(a == b and a != WILDCARD for a, b in zip(template, tokens, strict=True)) / len(tokens)
            score = (same, list(template).count(WILDCARD), -k)
            if score > best:
                best, found = score, k
        return found if found is not None and best[0] >= self.similarity else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows)).sort_values("line_id")
        held = {int(k[0]): (list(v[0]), int(v[1]), int(v[2])) for k, v in self.clusters.iterator()}
        number = int(self.next.get()[0]) if self.next.exists() else 0
        out, touched = [], set()
        for line, tokens, at in zip(given["line_id"], given["tokens"], given["at"], strict=True):
            tokens, k = list(tokens), self._best(held, list(tokens))
            if k is None:
                k, number = number, number + 1
                held[k] = (tokens, 1, int(at))
            else:
                template, n, last = held[k]
                held[k] = ([a if a == b else WILDCARD for a, b in zip(template, tokens, strict=True)], n + 1, max(last, int(at)))
            touched.add(k)
            out.append((line, k, " ".join(held[k][0])))
        for k in touched:
            self.clusters.updateValue((k,), held[k])
            self.handle.registerTimer(held[k][2] + self.idle_ms)
        self.next.update((number,))
        made = pd.DataFrame(out, columns=["line_id", "number", "template"])
        yield made.assign(width=int(key[0]), path=key[1])[["width", "path", "number", "line_id", "template"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for k, v in list(self.clusters.iterator()):
            if int(v[2]) + self.idle_ms <= now:
                self.clusters.removeKey(k)
        return iter(())

    def close(self) -> None:
        pass


def path_of(tokens: Column, depth: int = 4) -> Column:
    """The path of a message: its first ``depth`` - 3 tokens, those with digits as wildcards."""
    steps = F.slice(tokens, 1, max(0, depth - 3))
    return F.array_join(F.transform(steps, lambda t: F.when(t.rlike(r"\d"), WILDCARD).otherwise(t)), " ")


def parse_by_path(lines: DataFrame, patterns: Sequence[str], depth: int = 4, similarity: float = 0.5, time: str = "ts", late: str = "10 minutes", idle_ms: int = 3_600_000, ttl_ms: int | None = None) -> DataFrame:
    """(width, path, number, line_id, template) of a stream of (line_id, content, time).

    Each path of the parse tree (token count, and the tokens that lead to a leaf) is a key with a state of its own, a map of clusters, so that what
    is read and written grows with the clusters of the paths that a trigger touches. Unlike in the batch tree a token without digits never
    goes by the wildcard. Lines later than the watermark are dropped by Spark; the session needs STATE_STORE."""
    tokens = plain_tokens(masked(F.col("content"), patterns))
    keyed = lines.withWatermark(time, late).select("line_id", time, tokens.alias("tokens"), F.unix_millis(time).alias("at"))
    keyed = keyed.withColumn("width", F.size("tokens")).withColumn("path", path_of(F.col("tokens"), depth)).where(F.col(time).isNotNull())
    return keyed.groupBy("width", "path").transformWithStateInPandas(PathClusters(similarity, idle_ms, ttl_ms), "width int, path string, number int, line_id bigint, template string", "Append", "EventTime")
