"""Corpus preparation in five stages; each works on all that the stage before it kept.

Toxic documents go; lines that many documents share go; of each group of near copies one document
stays; documents that hold benchmark items go; what is left is encoded. Stages are written to the
shared folder and read again, so a lost executor never costs more than the stage at work; a stage's table
is removed when the next one's is there.

Null and empty texts pass all stages, each as its operator says: they score low, lose no line, are copies of
nothing, hold no item and have no token. Rows that repeat id and text become one in near dedup. Without
labels nothing is toxic by learning and scores are the lexicon's; without items nothing is dropped; without
documents there is no row. Further columns pass the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe_tree, decontaminate, line_dedup, order_minhash
from millrace.llm import queries as Q
from millrace.scratch import remove_tables, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    return Q.toxic_scores(spark, docs, sf_dir, docs.columns, out="__toxic").filter(F.col("__toxic") < Q.TOXIC).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many share; n_chars follows the text."""
    kept = line_dedup.dedup_lines(docs, n_lines="__n_lines", n_dropped="__n_dropped")
    return kept.withColumn("n_chars", F.when(F.col("__n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return order_minhash.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = Q.table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontaminate.find_leaks(docs, items, hits="__leaks").filter(F.size("__leaks") == 0).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and the digests of ids and decoded text."""
    encoded = bpe_tree.encode(docs.select("doc_id", "text"), Q.WORD_BPE)
    return bpe_tree.digest(encoded, more=["ids"])


STAGES = [("toxicity", toxicity), ("line dedup", lines), ("near dedup", near_copies), ("decontamination", benchmark), ("bpe", tokens)]
#: Scores, alignments and encodings are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if before:
            remove_tables(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
