"""Nonbranching paths, and what is verified at their coordinates."""

from __future__ import annotations

import numpy as np
import pytest

substring = pytest.importorskip("timberline.llm.substring")


def pieces(spark, docs):
    """``docs``: the contents of each document's repeated pieces, one edge each."""
    rows = []
    for d, held in enumerate(docs):
        for i, c in enumerate(held):
            rows.append((d, 0, i, 1, substring.SOLID, c, held[i - 1] if i else None, held[i + 1] if i + 1 < len(held) else None))
    return spark.createDataFrame(rows, substring._PIECES_SQL)


def test_paths_end_where_documents_part(spark):
    # 1 2 3 4 always stand together; 5 follows 4 in one document and 6 in the other; 7 repeats itself
    table = pieces(spark, [[1, 2, 3, 4, 5], [9, 1, 2, 3, 4, 6], [7, 7, 7, 8]])
    got = {r.node: r.path for r in substring.compacted(substring.links(substring.successors(table))).collect()}
    assert got == {2: 1, 3: 1, 4: 1}
    spans = sorted((r.doc_id, r.start, r.edges) for r in substring.occurrences(table).collect())
    assert spans == [(0, 0, 4), (0, 4, 1), (1, 0, 1), (1, 1, 4), (1, 5, 1), (2, 0, 1), (2, 1, 1), (2, 2, 1), (2, 3, 1)]


def test_long_paths(spark):
    chain = list(range(100, 400))
    got = {r.node: r.path for r in substring.compacted(substring.links(substring.successors(pieces(spark, [chain, chain])))).collect()}
    assert got == {c: 100 for c in chain[1:]}
    with pytest.raises(RuntimeError, match="not compact"):
        substring.compacted(substring.links(substring.successors(pieces(spark, [chain]))), rounds=2)


def test_spans_of_a_document():
    # a path of five edges, and a branching piece of two
    s, n = substring._spans(np.array([0, 22]), np.array([5, 2]), np.array([False, True]))
    assert list(zip(s.tolist(), n.tolist())) == [(0, 5), (22, 1), (23, 1)]


def test_equal_hashes_of_other_words_do_not_count():
    words = [f"a{i}".encode() for i in range(40)]
    same = substring._digests(words, np.array([0, 2]), np.array([3, 3]), 6)
    other = substring._digests([*words[:4], b"other", *words[5:]], np.array([0]), np.array([3]), 6)
    again = substring._digests(words, np.array([0]), np.array([3]), 6)
    for k, held in enumerate((same, other, again)):
        held["doc"], held["version"] = k, 0
    block = np.concatenate([same, other, again]).tobytes()
    import pyarrow as pa

    got = substring._compared(pa.table({"block": [block]}))
    assert got.column("doc_id").to_pylist() == [0, 2]


def test_extra_columns_and_long_words(spark):
    text = " ".join(["x" * 200_000, *[f"w{i}" for i in range(60)]])
    rows = [(1, text, "a"), (2, text, "b"), (3, " ".join(f"w{i}" for i in range(50)), "c")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, marks string").selectExpr("*", "1 as version", "2 as n_words", "'k' as kept")
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.mark(table).collect())
    assert got == [(1, 61, 61), (2, 61, 61), (3, 50, 50)]
