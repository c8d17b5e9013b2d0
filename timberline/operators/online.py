"""Order-dependent miners: a parse tree of fixed depth, and longest common subsequences.

Both read lines in the order of line_id. The tree splits by token count first, so token counts run in
parallel; the subsequence miner has one state for a whole log.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import WILDCARD, masked
from .streamed import in_order, named
from .tokens import plain_tokens, spell_tokens


class ParseTree:
    """Clusters of token lists of one length. Paths of ``depth - 2`` tokens lead to lists of clusters;
    tokens with digits, and those beyond ``children``, go by the wildcard. Messages shorter than a path
    are never found again."""

    def __init__(self, depth: int = 4, similarity: float = 0.4, children: int = 100):
        self.steps, self.similarity, self.children = depth - 2, similarity, children
        self.branches: dict[tuple[str, ...], set[str]] = {}
        self.leaves: dict[tuple[str, ...], list[int]] = {}
        self.templates: list[list[str]] = []

    def _path(self, tokens: list[str], grow: bool) -> tuple[str, ...] | None:
        path: tuple[str, ...] = ()
        for token in tokens[: self.steps - 1]:
            known = self.branches.get(path, set())
            if token in known:
                step = token
            elif not grow:
                if WILDCARD not in known:
                    return None
                step = WILDCARD
            elif any(c.isdigit() for c in token):
                step = WILDCARD
            elif len(known) + (WILDCARD not in known) < self.children:
                step = token
            else:
                step = WILDCARD
            if grow:
                self.branches.setdefault(path, set()).add(step)
            path = (*path, step)
        return path

    def add(self, tokens: list[str]) -> int:
        """The number of the cluster that takes the message."""
        stored = len(tokens) >= max(1, self.steps)
        path = self._path(tokens, False)
        best, found = (-1.0, -1), None
        for k in self.leaves.get(path, ()) if path is not None else ():
            template = self.templates[k]
            same = sum(a == b and a != WILDCARD for a, b in zip(template, tokens, strict=True)) / len(tokens)
            score = (same, template.count(WILDCARD))
            if score > best:
                best, found = score, k
        if found is not None and best[0] >= self.similarity:
            self.templates[found] = [a if a == b else WILDCARD for a, b in zip(self.templates[found], tokens, strict=True)]
            return found
        self.templates.append(tokens)
        if stored:
            self.leaves.setdefault(self._path(tokens, True), []).append(len(self.templates) - 1)
        return len(self.templates) - 1


def _mined(rows: DataFrame, group: Sequence[str], key: Sequence[str], start: Callable) -> DataFrame:
    """(key, line_id, template) by one state for each group, which reads its lines in order; ``start`` makes it from
    the group's first row, whose key may hold thresholds."""

    def mine(of: Iterator[dict]) -> Iterator[tuple]:
        state = None
        for row in of:
            state = state or start(row)
            own = [row[c] for c in group]
            yield (*own, row["line_id"], state.add(row["tokens"]), None)
        for k, template in enumerate(state.templates):
            yield (*own, None, k, " ".join(template))

    return named(in_order(rows, group, ["line_id"], mine), group).select(*key, "line_id", "template")


def _set(value: float | str, row: dict) -> float:
    """A threshold, or that of the key's column of this name."""
    return row[value] if isinstance(value, str) else value


def drain(lines: DataFrame, masks: Sequence[str] = (), depth: int | str = 4, similarity: float | str = 0.5, key: Sequence[str] = (), text: Column | None = None) -> DataFrame:
    """(line_id, template) by parse trees, one for each token count of each log that ``key`` tells apart.

    ``text``: the masked content, where its rules come from a table; thresholds may be names of the key's columns then."""
    rows = lines.select(*key, "line_id", plain_tokens(masked(F.col("content"), masks) if text is None else text).alias("tokens")).withColumn("width", F.size("tokens"))
    return _mined(rows, [*key, "width"], key, lambda row: ParseTree(int(_set(depth, row)), float(_set(similarity, row))))


def common(a: Sequence[str], b: Sequence[str]) -> list[str]:
    """A longest common subsequence, from the ends back: first dropping from ``a``, then from ``b``."""
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i + 1][j], size[i][j + 1])
    out, i, j = [], len(a), len(b)
    while i and j:
        if size[i][j] == size[i - 1][j]:
            i -= 1
        elif size[i][j] == size[i][j - 1]:
            j -= 1
        else:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
    return out[::-1]


class Subsequences:
    """Clusters found by a prefix tree of constants, then by set containment, then by common subsequences."""

    def __init__(self, tau: float):
        self.tau = tau
        self.templates: list[list[str]] = []
        self.tree: dict = {}

    def _constants(self, k: int) -> list[str]:
        return [t for t in self.templates[k] if t != WILDCARD]

    def _store(self, k: int) -> None:
        node = self.tree
        for token in self._constants(k):
            node = node.setdefault(token, {"": 0})
            node[""] += 1
        if node is not self.tree and None not in node:
            node[None] = k

    def _remove(self, k: int) -> None:
        node = self.tree
        for token in self._constants(k):
            if token not in node:
                return
            child = node[token]
            child[""] -= 1
            if not child[""]:
                del node[token]
                return
            node = child
        if node.get(None) == k:
            del node[None]

    def _by_prefix(self, tokens: list[str]) -> int | None:
        node, at = self.tree, 0
        while True:
            step = None
            for i in range(at, len(tokens)):
                child = node.get(tokens[i])
                if child is None:
                    continue
                if None in child:
                    if len(self._constants(child[None])) >= self.tau * len(tokens):
                        return child[None]
                else:
                    step = (child, i + 1)
                    break
            if step is None:
                return None
            node, at = step

    def add(self, tokens: list[str]) -> int:
        constants = [t for t in tokens if t != WILDCARD]
        found = self._by_prefix(constants)
        if found is None:
            held = set(constants)
            found = next((k for k, t in enumerate(self.templates) if len(t) >= 0.5 * len(constants) and all(x in held or x == WILDCARD for x in t)), None)
        if found is not None:
            return found
        held, best, longest = set(tokens), None, []
        for k, template in enumerate(self.templates):
            if len(held & set(template)) < 0.5 * len(tokens):
                continue
            shared = common(tokens, template)
            if best is None or len(shared) > len(longest) or len(shared) == len(longest) and len(template) < len(self.templates[best]):
                best, longest = k, shared
        if best is None or len(longest) < self.tau * len(tokens):
            self.templates.append(tokens)
            self._store(len(self.templates) - 1)
            return len(self.templates) - 1
        new = refined(longest, self.templates[best])
        if new != self.templates[best]:
            self._remove(best)
            self.templates[best] = new
            self._store(best)
        return best


def refined(shared: Iterable[str], template: Sequence[str]) -> list[str]:
    """The template with wildcards for what is not shared."""
    rest, out = list(shared), []
    for k, token in enumerate(template):
        if not rest:
            if k < len(template):
                out.append(WILDCARD)
            break
        if token == rest[0]:
            out.append(rest.pop(0))
        else:
            out.append(WILDCARD)
    return out


def spell(lines: DataFrame, masks: Sequence[str] = (), tau: float | str = 0.5, key: Sequence[str] = (), text: Column | None = None) -> DataFrame:
    """(line_id, template), one state for each log that ``key`` tells apart (or for all lines); ``text`` and ``tau`` as in :func:`drain`."""
    rows = lines.select(*key, "line_id", spell_tokens(masked(F.col("content"), masks) if text is None else text).alias("tokens"), F.lit(0).alias("log"))
    return _mined(rows, [*key, "log"], key, lambda row: Subsequences(float(_set(tau, row))))
