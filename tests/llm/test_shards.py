"""Rows of several shards, mixed, and shards that hold something else."""

from __future__ import annotations

import hashlib

import pytest

media = pytest.importorskip("timberline.llm.media")


def test_mixed_shards(spark, tmp_path):
    texts = {i: f"document {i} " * (1 + i % 4) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    folder = f"file://{tmp_path}/shards"
    index = media.write_shards(docs, folder).persist()
    assert index.select("shard").distinct().count() > 1
    for mixed in (index.orderBy("offset", "doc_id").coalesce(1), index.repartition(3)):
        rows = media.read_payloads(media.read_headers(mixed, folder), folder).collect()
        assert {r.doc_id: r.payload_sha256 for r in rows} == {i: hashlib.sha256(media.padded(t.encode())).hexdigest() for i, t in texts.items()}
    wrong = index.selectExpr("doc_id", "n_bytes", "digest", "shard", "first_value(offset) over (partition by shard order by offset desc) as offset", "length")
    with pytest.raises(Exception, match="another payload|not a picture|filtered|incomplete|decompress|unpack"):
        media.read_payloads(wrong, folder).collect()


def test_a_result_read_twice_writes_shards_once(spark):
    from timberline.llm import store

    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string").repartition(2)
    found = media.stored(docs)
    first, second = ({(r.shard, r.offset) for r in found.collect()} for _ in range(2))
    assert first == second
    store.clear(spark)
