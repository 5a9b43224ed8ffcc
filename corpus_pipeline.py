"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, packing; each stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm import exact_dedup, mixing, packing, simhash_dedup, toxicity
from tallywright.llm.common import materialize
from tallywright.llm.queries import tokenizer

#: Classifiers have no form in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None

def only(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of docs for each (doc_id, text_sha256) in found; rows that share both are one document.

    Repeated rows go before the shuffle, so a document that a third of all rows repeat is no hot key.
    """
    named = docs.withColumn("sha_of_stage", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).dropDuplicates(["doc_id", "sha_of_stage"])
    stay = found.select(F.col("doc_id").alias("id_that_stays"), F.col("text_sha256").alias("sha_that_stays"))
    same = F.col("doc_id").eqNullSafe(F.col("id_that_stays")) & (F.col("sha_of_stage") == F.col("sha_that_stays"))
    return named.join(stay.hint("merge"), same, "left_semi").select(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain doesn't reject; each row is judged by its own text, in one pass.

    Null and empty texts are judged as texts without a word, rows that repeat one get the same verdict, and an empty table
    stays empty. Other columns pass through.
    """
    verdict = toxicity.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.withColumn("verdict_of_stage", verdict(F.col("text"))).where("not verdict_of_stage.rejected").select(*docs.columns)


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that with the largest identifier, and of rows that share it any one.

    Null text counts as empty; a null identifier loses to any other. Other columns pass through; an empty table stays empty.
    """
    return only(docs, exact_dedup.exact_dedup(docs).where("kept"))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the least identifier, null ones last, then the least digest of its text.

    Near copies share 0.8 or more of their five-word shingles (Jaccard); covering SimHash tables give the candidates.
    Texts without a word are copies of one another. Other columns pass through; an empty table stays empty.
    """
    return only(docs, simhash_dedup.near_copies(docs, shingle=5, similarity=0.8).where("kept"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that bring the sources to their target weights, each once.

    Rows that repeat identifier, text and leaf are taken or left together; a null identifier or text counts as empty in the
    order, and null languages and sources are leaves of their own. Other columns pass through; an empty table stays empty.
    """
    taken = mixing.mix(docs, share=0.8, epochs=1).select(F.col("doc_id").alias("taken_id"), F.col("lang").alias("taken_lang"), F.col("source").alias("taken_source"), F.col("text_hash").alias("taken_hash"))
    name = lambda c: F.coalesce(F.col(c), F.lit("?"))
    same = F.col("doc_id").eqNullSafe(F.col("taken_id")) & (name("lang") == F.col("taken_lang")) & (name("source") == F.col("taken_source")) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("taken_hash"))
    return docs.join(taken.hint("merge"), same, "left_semi")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 2048 tokens; a null text is its closing identifier alone."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("toxicity", not_toxic), ("exact_dedup", no_copies), ("near_dedup", no_near_copies), ("mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
