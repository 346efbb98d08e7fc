"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textvault.llm import exact_topk, hard_negatives, license_scan, mixing, packing, periodic_runs, projected_search, quality_model, quality_rules, secret_scan, sharding, simhash, suffix_dedup
from textvault.llm.shared import documents, table

QUERIES = {}
ORACLE = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(documents(spark, sf_dir))


def word_tokenizer() -> str:
    """Path of the public word-level vocabulary; a parameter of the packing operator."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), word_tokenizer(), 4096)


@query
def op6_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"), 0.3)


@query
def op8_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), 8)


@query
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(documents(spark, sf_dir))


@query
def op3_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), threshold=2, shingle=3)


@query
def op4_suffix_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(documents(spark, sf_dir), 100)


@query
def op7_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


ORACLE["op7_risk_controlled_rules"] = quality_rules.ORACLE_SQL


@query
def op1_projected_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return projected_search.nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


@query
def op10_license_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(documents(spark, sf_dir))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(documents(spark, sf_dir))


@query
def op11_norm_sorted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


ORACLE["op11_norm_sorted_topk"] = exact_topk.ORACLE_SQL


@query
def op12_strassen_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.mine(rows, rows.filter(F.col("vec_id") % 100 == 0), 5, 5)


ORACLE["op12_strassen_negatives"] = hard_negatives.ORACLE_SQL
