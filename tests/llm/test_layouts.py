"""Records of mixed and uneven layouts, through fingerprint, mapping, format and back."""

from __future__ import annotations

import json
from collections import defaultdict

import pytest

chat = pytest.importorskip("timberline.llm.chat")

#: record, and its turns (None: an unknown layout)
CASES = [
    ({"messages": [{"role": "user", "content": "a"}, {"content": "b"}]}, [("user", "a"), ("", "b")]),
    ({"messages": [{"content": "a"}, {"content": None}]}, [("", "a"), ("", "")]),
    ({"messages": [{"role": "user"}, {"role": None}]}, [("user", ""), ("", "")]),
    ({"messages": ["hi", {"role": "assistant", "content": "yo"}, 3, None]}, [("", "hi"), ("assistant", "yo"), ("", "3"), ("", "")]),
    ({"messages": []}, []),
    ({"messages": None}, []),
    ({"messages": "text"}, []),
    ({"id": 7, "messages": [{"role": "user", "content": "a", "name": "n", "meta": {"x": [1]}}]}, [("user", "a")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "p"}]}]}, [("user", '[{"type": "text", "text": "p"}]')]),
    ({"messages": [{"role": 5, "content": 1.5}]}, [("5", "1.5")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt"}, {"from": "tool", "value": "t"}]}, [("user", "a"), ("assistant", ""), ("tool", "t")]),
    ({"conversations": []}, []),
    ({"prompt": "p", "completion": "c", "source": "s"}, [("user", "p"), ("assistant", "c")]),
    ({"prompt": {"a": 1}, "response": ["x"]}, [("user", '{"a": 1}'), ("assistant", '["x"]')]),
    ({"instruction": "do", "input": None, "output": "done"}, [("user", "do"), ("assistant", "done")]),
    ({"instruction": None, "input": "it", "output": ""}, [("user", "\n\nit"), ("assistant", "")]),
    ({"prompt": "p", "messages": []}, None),
    ({"prompt": "p"}, None),
    ({}, None),
    ([1, 2], None),
    ("text", None),
    (None, None),
]


def test_layouts_to_text_and_back(spark):
    rows = [(i, json.dumps(record), "extra") for i, (record, _) in enumerate(CASES)] + [(98, "{broken", "x"), (99, None, "x")]
    table = spark.createDataFrame(rows, "conv_id bigint, record string, turn string")
    turns = chat.canonical(table).persist()
    got, back = defaultdict(list), defaultdict(list)
    for r in turns.orderBy("conv_id", "turn").collect():
        got[r.conv_id].append((r.turn, r.role, r.text, r.fingerprint))
    for i, (record, want) in enumerate(CASES):
        known = {r[3] in chat.BY_FINGERPRINT for r in got[i]}
        assert known == {want is not None}, record
        assert [r[:3] for r in got[i]] == ([(k, *t) for k, t in enumerate(want or [])] or [(-1, None, None)]), record
    assert [r[3] for r in got[98]] == ["invalid"] and got[99][0][0] == -1
    for r in chat.formatted(turns.where("turn >= 0")).orderBy("conv_id", "turn").collect():
        back[r.conv_id] += chat.parsed(r.piece)
    assert dict(back) == {i: want for i, (_, want) in enumerate(CASES) if want}


def test_mappings_have_their_own_fingerprints():
    prints = [f for m in chat.MAPPINGS for f in m.fingerprints]
    assert len(prints) == len(set(prints))


def test_records_that_are_no_text_are_invalid(spark):
    deep = "[" * 200_000 + "]" * 200_000
    records = ['{"prompt": "\\ud800", "completion": "c"}', '{"\\udc00": 1}', '{"messages": [{"role": "\\ud800", "content": "x"}]}', deep, '{"messages": ' + "[" * 5000 + "]" * 5000 + "}", '{"prompt": "a", "completion": "b"}']
    got = chat.canonical(spark.createDataFrame(list(enumerate(records)), "conv_id bigint, record string")).collect()
    assert {r.conv_id: r.fingerprint for r in got if r.conv_id < 4} == dict.fromkeys(range(4), "invalid")
    assert [(r.role, r.text) for r in got if r.conv_id == 5] == [("user", "a"), ("assistant", "b")]


def test_system_prompts_and_what_is_left_out(spark):
    records = [
        {"system": "be kind", "conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]},
        {"system": "be brief", "instruction": "do", "input": "", "output": "done"},
        {"system": None, "prompt": "p", "completion": "c", "context": {"notes": ["n", ""], "id": 4}},
        {"messages": [{"role": "user", "content": "hi", "name": "Ann"}], "system": ""},
        {"unknown": "text", "n": 1},
    ]
    rows = chat.canonical(spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "conv_id bigint, record string")).orderBy("conv_id", "turn").collect()
    turns, left = defaultdict(list), {}
    for r in rows:
        turns[r.conv_id].append((r.role, r.text))
        left[r.conv_id] = r.left_out
    assert turns[0] == [("system", "be kind"), ("user", "hi"), ("assistant", "yo")]
    assert turns[1] == [("system", "be brief"), ("user", "do"), ("assistant", "done")]
    assert turns[2] == [("user", "p"), ("assistant", "c")] and turns[3] == [("user", "hi")] and turns[4] == [(None, None)]
    assert left == {0: [], 1: [], 2: ["context.notes[]"], 3: ["messages[].name"], 4: ["unknown"]}


def test_tables_are_told_by_their_own_schema(spark):
    table = spark.createDataFrame([(1, 0, "user", "hi", "x", "y")], "conv_id bigint, turn bigint, role string, text string, prompt string, system string")
    assert chat.mapping_of(table).name == "rows by turn" and chat.turns_by_row(table).count() == 1
    assert chat.mapping_of(table.select("prompt", "system")) is None
    with pytest.raises(ValueError, match="rows by turn"):
        chat.turns_by_row(table.select("conv_id", "prompt"))
