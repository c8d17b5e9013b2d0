"""Chat formatting with schema fingerprints.

A record's layout is the set of its nested field paths; a hash of that set selects a declarative
mapping, which says where turns, roles and texts are. Mappings for prompt and completion, instruction
(with and without input), message lists, and rows by turn are given; others can be added. Layouts are
told apart by row for JSON records (:func:`canonical`) and by schema for tables (:func:`mapping_of`).
Only paths that some mapping names are hashed, so that further fields (a name, an id) don't change a
layout; a mapping has a fingerprint for each set of paths that its optional ones allow. Any layout may have a
system prompt, which is its first turn. Texts in fields that the mapping doesn't name are told by their paths (``left_out``).

Canonical turns are formatted one by one: ``<|im_start|>role``, a line feed, the text,
``<|im_end|>`` and a line feed. Inside roles and texts a backslash is doubled, and one is put after the
first character of each control string, so that no text holds one; a line feed in a role gets one
before it. Removing single backslashes reverses that. The loss mask covers assistant texts.

A conversation is never gathered into one value: its formatted turns stay rows, and digests over a
conversation are taken as its sorted rows pass by.

Cases: null texts and roles are empty; turns with equal numbers follow each other by role and text,
null turns come first; repeated rows are repeated turns; rows without a conversation form the one with
id null; extra columns are ignored; an empty table gives no conversations (but for added ones). Of JSON
records: a message without a role or a text has an empty one; a message that is no object is a turn with an
empty role and that text; texts that are no strings are their JSON; an empty list has no turns; records
with an unknown layout, or with the fields of two, have no turns and are told by their fingerprint (one
row with turn -1), as are records without turns; JSON that is broken, nested too deep to be read, or with
halves of surrogate pairs has the fingerprint ``invalid``.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import released

#: Fixed strings that mean something to chat templates.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")

_START, _END = "<|im_start|>", "<|im_end|>\n"


@dataclass(frozen=True)
class Mapping:
    """``turns``: (role, path of the text or None) in order, or the path of a list with paths inside it."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    #: roles of this layout by canonical name, where they differ
    roles: tuple[tuple[str, str], ...] = ()
    #: paths that a record of this layout may lack, besides a system prompt
    optional: tuple[str, ...] = ()
    #: the path of a system prompt
    system: str = "system"

    @property
    def fingerprints(self) -> tuple[str, ...]:
        """One for each set of paths that a record of this layout may have."""
        needed = [p for p in self.paths if p not in self.optional]
        free = (*self.optional, *([self.system] if self.system else []))
        return tuple(fingerprint([*needed, *some]) for n in range(len(free) + 1) for some in combinations(free, n))


def fingerprint(paths) -> str:
    """A hash of the sorted distinct field paths; list elements are written ``[]``."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


MAPPINGS = (
    Mapping("prompt", ("prompt", "completion"), (("user", "prompt"), ("assistant", "completion"))),
    Mapping("response", ("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Mapping("instruction", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction with input", ("input", "instruction", "output"), (("user", "instruction\n\ninput"), ("assistant", "output"))),
    Mapping("messages", ("messages", "messages[]", "messages[].role", "messages[].content"), each="messages", role="role", text="content", optional=("messages[]", "messages[].role", "messages[].content")),
    Mapping("shared", ("conversations", "conversations[]", "conversations[].from", "conversations[].value"), each="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant")), optional=("conversations[]", "conversations[].from", "conversations[].value")),
    Mapping("rows by turn", ("conv_id", "role", "text", "turn"), role="role", text="text", system=""),
)

BY_FINGERPRINT = {f: m for m in MAPPINGS for f in m.fingerprints}

#: The paths that count in a fingerprint.
NAMED = frozenset(p for m in MAPPINGS for p in (*m.paths, *([m.system] if m.system else [])))


def paths_of(value, at: str = "") -> Iterator[str]:
    """The field paths of a JSON value."""
    if isinstance(value, dict):
        for key, inner in value.items():
            path = f"{at}.{key}" if at else key
            yield path
            yield from paths_of(inner, path)
    elif isinstance(value, list):
        if value:
            yield f"{at}[]"
        for inner in value:
            yield from paths_of(inner, f"{at}[]")


def schema_paths(kind: T.DataType, at: str = "") -> Iterator[str]:
    """The field paths of a schema."""
    if isinstance(kind, T.StructType):
        for field in kind.fields:
            path = f"{at}.{field.name}" if at else field.name
            yield path
            yield from schema_paths(field.dataType, path)
    elif isinstance(kind, T.ArrayType):
        yield f"{at}[]"
        yield from schema_paths(kind.elementType, f"{at}[]")


def mapping_of(table: DataFrame) -> Mapping | None:
    """The mapping for a table, by the fingerprint of its schema; where that has fields of other layouts besides, the
    one with the most paths all of which are there."""
    there = [p for p in schema_paths(table.schema) if p in NAMED]
    found = BY_FINGERPRINT.get(fingerprint(there))
    by_size = sorted(MAPPINGS, key=lambda m: -len(m.paths))
    return found or next((m for m in by_size if fingerprint(p for p in there if p in m.paths) in m.fingerprints), None)


def texts_of(value, at: str = "") -> Iterator[str]:
    """The paths of a JSON value that hold a text which isn't empty."""
    if isinstance(value, dict):
        for key, inner in value.items():
            yield from texts_of(inner, f"{at}.{key}" if at else key)
    elif isinstance(value, list):
        for inner in value:
            yield from texts_of(inner, f"{at}[]")
    elif isinstance(value, str) and value:
        yield at


def _text(value) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _turns(record) -> tuple[str, list[tuple[str, str]], list[str]]:
    """The fingerprint, the turns, and the paths of texts that are in none of them."""
    print_ = fingerprint(p for p in paths_of(record) if p in NAMED)
    m = BY_FINGERPRINT.get(print_)
    if m is None or not isinstance(record, dict):
        return print_, [], sorted(set(texts_of(record)))
    out = [("system", _text(record[m.system]))] if m.system and record.get(m.system) else []
    named = {*m.paths, m.system}
    left = sorted({p for p in texts_of(record) if p not in named})
    if m.turns:
        for role, path in m.turns:
            first, *more = path.split("\n\n")
            out.append((role, "\n\n".join([_text(record[first]), *(_text(record[p]) for p in more if record[p])])))
        return print_, out, left
    names, inner = dict(m.roles), record.get(m.each) if m.each else None
    for message in inner if isinstance(inner, list) else ():
        held = message if isinstance(message, dict) else {m.text: message}
        role = _text(held.get(m.role))
        out.append((names.get(role, role), _text(held.get(m.text))))
    return print_, out, left


_RECORD_SQL = "conv_id bigint, turn bigint, role string, text string, fingerprint string, left_out array<string>"


def canonical(records: DataFrame, record: str = "record", key: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text, fingerprint and left_out (the paths of texts that no turn has) from JSON records of
    mixed layouts; turn -1 where there are none."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    value = json.loads(raw or "null")
                    if raw and "\\ud" in raw.lower():  # halves of surrogate pairs are no text
                        json.dumps(value, ensure_ascii=False).encode()
                    print_, turns, left = _turns(value)
                except (ValueError, RecursionError):
                    print_, turns, left = "invalid", [], []
                rows += [(conv, k, role, text, print_, left) for k, (role, text) in enumerate(turns)] or [(conv, -1, None, None, print_, left)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "turn", "role", "text", "fingerprint", "left_out"])

    return records.select(F.col(key).cast("bigint"), record).mapInArrow(released(convert), _RECORD_SQL)


_CONTROL = "|".join(re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in CONTROLS)


def escaped(text: Column) -> Column:
    """Reversibly free of control strings."""
    doubled = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(doubled, f"({_CONTROL})", r"$1\\")


def formatted(turns: DataFrame) -> DataFrame:
    """Adds piece (the formatted turn) and the place of the loss mask in it (loss_at, loss_chars; both 0 for none)."""
    role = F.regexp_replace(escaped(F.col("role")), "\n", "\\\\\n")
    head = F.concat(F.lit(_START), role, F.lit("\n"))
    body = escaped(F.col("text"))
    loss = F.col("role") == "assistant"
    return turns.select(
        "*",
        F.concat(head, body, F.lit(_END)).alias("piece"),
        F.when(loss, F.length(head)).otherwise(0).alias("loss_at"),
        F.when(loss, F.length(body)).otherwise(0).alias("loss_chars"),
    )


_TURN = re.compile(re.escape(_START) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(_END), re.DOTALL)
_SINGLE = re.compile(r"\\(.)", re.DOTALL)


def unescaped(text: str) -> str:
    return _SINGLE.sub(r"\1", text)


def parsed(piece: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in formatted text."""
    out, at = [], 0
    while at < len(piece):
        found = _TURN.match(piece, at)
        if not found:
            raise ValueError("not formatted text")
        out.append((unescaped(found[1]), unescaped(found[2])))
        at = found.end()
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted pieces: one row for each conversation, read back from the formatted text."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows, conv, n, turns, loss, loss_n, chars, begun = [], None, 0, None, None, 0, 0, False
    for batch in batches:
        for key, piece, at, size in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if not begun or key != conv:
                if begun:
                    rows.append((conv, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars))
                begun, conv, n, loss_n, chars, turns, loss = True, key, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            for role, text in parsed(piece):
                n += 1
                turns.update(f"{role}\n{text}\n".encode())
            masked = unescaped(piece[at : at + size])
            loss_n += len(masked)
            loss.update(masked.encode())
            chars += len(piece)
        if len(rows) >= 4000:
            yield made(rows)
            rows = []
    if begun:
        rows.append((conv, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars))
    if rows:
        yield made(rows)


def digests(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from formatted turns."""
    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = dealt.select("conv_id", "piece", "loss_at", "loss_chars")
    return rows.mapInArrow(released(_digest), "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def turns_by_row(table: DataFrame) -> DataFrame:
    """Canonical turns of a table with one row for each turn; the mapping comes from the fingerprint of its schema."""
    found = mapping_of(table)
    if found is None or found.name != "rows by turn":
        raise ValueError("not a table with rows by turn")
    return table.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col(found.role).alias("role"), F.col(found.text).alias("text"))
