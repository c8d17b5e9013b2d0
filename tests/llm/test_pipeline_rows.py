"""What the stages of the pipeline do to single rows."""

from __future__ import annotations

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], SCHEMA)


def test_near_duplicates_take_five_words(spark):
    base = [f"w{i}" for i in range(60)]
    linked = [*base[:-1], "other"]  # 55 of 57 runs of five words are shared
    apart = [w if i not in (12, 30, 48) else f"x{i}" for i, w in enumerate(base)]  # 53 of 65 pairs, but 41 of 71 fives
    rows = table(spark, [(1, " ".join(base)), (2, " ".join(linked)), (3, " ".join(apart))])
    assert sorted(r.doc_id for r in corpus_pipeline.single(spark, rows, "").collect()) == [1, 3]


def test_repeated_rows_stay_once(spark):
    def words(name, n):
        return " ".join(f"{name}{i}" for i in range(n))

    rows = [
        *[(5, words("a", 50))] * 3,  # a document on three rows
        (7, words("b", 60)),
        (2, words("b", 60) + " more"),  # near 7, and of a smaller id
        (7, words("c", 70)),  # another text of an id that is not the smallest
        *[(None, words("d", 40))] * 2,
        (9, words("d", 40)),  # a known id goes before null
        (11, ""),
        (12, ""),
        (13, None),
    ]
    found = corpus_pipeline.single(spark, table(spark, rows), "").persist()
    got = sorted(((r.doc_id, r.text) for r in found.collect() if r.text), key=str)
    assert got == sorted([(5, words("a", 50)), (2, words("b", 60) + " more"), (7, words("c", 70)), (9, words("d", 40))], key=str)
    assert sorted(r.doc_id for r in found.collect() if not r.text) == [11, 12, 13]
    left = {(r.doc_id, r.text) for r in corpus_pipeline.unrepeated(spark, found, "").collect()}
    assert left == set(got)


def test_stages_decide_as_their_operators(spark):
    """Each stage keeps the rows that its operator keeps, on hard rows: nulls, repeated rows and ids, extra columns."""
    from timberline.llm import quality, toxicity

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    # prose of one long text, in sentences of eight words
    rng = random.Random(1)
    sentences = (" ".join("".join(rng.choices("abcdefghijklmnop", k=rng.choice([4, 5, 5]))) for _ in range(8)).capitalize() + "." for _ in range(4_000))
    long = "\n".join(sentences)
    hard = [(None, None), (None, "ten words are in this text, and some more, of course"), (-5, ""), (-6, long), (-6, "another text of ten words, or perhaps of some more words"), (-7, " \n ")]
    rows = docs.unionByName(docs.limit(5)).unionByName(table(spark, hard))
    rows = rows.selectExpr("*", "'x' as kept", "1 as row", "2 as toxic_score", "'y' as others")

    def plain(found):
        return sorted(((r.doc_id, r.text) for r in found.collect()), key=str)

    good = corpus_pipeline.good(spark, rows, "")
    assert good.columns == list(corpus_pipeline.COLUMNS)
    scored = quality.score(rows.selectExpr("monotonically_increasing_id() as doc_id", "text"))
    assert good.count() == scored.where("kept").count()
    assert (-6, long) in plain(good) and not any(not (t or "").strip() for _, t in plain(good))
    where = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{where}/labels.parquet")
    model = toxicity.trained(rows, labels)
    want = plain(toxicity.scored(rows.selectExpr("doc_id", "text", "text as t"), model, "t").where("toxic_score < 0.5"))
    assert plain(corpus_pipeline.clean(spark, rows, where)) == want
    single = corpus_pipeline.single(spark, rows, "")
    assert len(set(plain(single))) == single.count() and (-6, long) in plain(single)
    cut = plain(corpus_pipeline.unrepeated(spark, single, ""))
    assert (-6, long) in cut and (-5, "") not in cut
    before = dict.fromkeys(plain(single))
    assert sum(x in before for x in cut) > len(cut) // 2  # texts without repeated passages are as they were
    packed = corpus_pipeline.packed(spark, single, "")
    assert packed.where("start = 0").count() == single.count()
