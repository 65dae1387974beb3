"""Registered queries of the subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm import linededup, merkle, mixing, negatives, packing, phrases, quality, repeats, secrets, simhash, token_counts, toxicity, vectors
from marketframe.llm.common import importable
from marketframe.llm.learn import held_out
from marketframe.llm.oracle import ORACLE  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out().alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.KEEP).cast("int"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"))


def op9_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.neighbour_report(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out().alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.KEEP).cast("int"))


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_report(table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, negatives.relabelled())


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_vectors": op2_vectors,
    "op3_simhash": op3_simhash,
    "op4_mixing": op4_mixing,
    "op5_packing": op5_packing,
    "op6_token_counts": op6_token_counts,
    "op7_quality": op7_quality,
    "op8_line_dedup": op8_line_dedup,
    "op9_merkle": op9_merkle,
    "op10_toxicity": op10_toxicity,
    "op11_repeats": op11_repeats,
    "op12_phrases": op12_phrases,
    "op13_negatives": op13_negatives,
}
