"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of ``documents`` (further columns are left out).

Cases: null and empty texts fail the quality rules; in the other stages they are clean, near nothing, and
without passages, so that the fourth stage leaves them out, as it does texts of which nothing is left; null ids
and null columns stay as they are; rows that repeat a document (same id and text) stay once after the third
stage, rows with one id and several texts are judged apart; texts of any length are whole; an empty table
gives empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm import minhash, packing, quality, substring, toxicity
from timberline.llm.store import staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test and the weighted votes keep."""
    return quality.keep_good(docs.select(*COLUMNS))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no window is toxic."""
    return toxicity.keep_clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row (that of the smallest id) of each component of near duplicates, by shingles of five words.

    Rows are nodes, not ids: rows with one id and several texts are judged apart, and of rows that
    repeat a document (same id and text) one stays. Null ids come last.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("row"))
    rows = keyed.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n"))
    found = minhash.near_duplicates(keyed.select(F.col("row").alias("doc_id"), "text"), width=5, percent=80)
    parts = found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("part")).distinct()
    rows = staged(rows.join(parts, "row"), "rows")
    stays = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("least"), F.count("*").alias("members"))
    stays = staged(stays.where("members > 1"), "stays")  # a large group can be split in the join
    gone = rows.join(stays, "part").where("row != least.row").select("row")
    again = staged(rows.where("n > 1").select("row").join(gone, "row", "left_anti"), "again")
    gone = staged(gone, "gone")
    alone = keyed.join(gone.unionByName(again), "row", "left_anti")
    repeated = keyed.join(again, "row", "left_semi").dropDuplicates(["row"])
    return alone.select(*COLUMNS).unionByName(repeated.select(*COLUMNS))


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages, otherwise as they are; those of which nothing is left go."""
    keyed = docs.select("doc_id", "lang", "source", substring.version().alias("version"))
    cut = substring.mark(docs.select("doc_id", "text"), text=True).where("n_words > n_removed").dropDuplicates(["doc_id", "version"])
    cut = cut.select(F.col("doc_id").alias("cut_id"), F.col("version").alias("cut_version"), F.col("kept").alias("text"))
    out = keyed.join(cut, F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("version") == F.col("cut_version")))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 ids, as pieces of documents."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096)


STAGES = [("quality rules", good), ("toxicity", clean), ("near duplicates", single), ("repeated passages", unrepeated), ("packing", packed)]

#: Trained weights and minimum bin slack are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
