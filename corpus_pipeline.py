"""Corpus pipeline: classify, deduplicate, clear of secrets, mix and pack ``documents``.

``STAGES`` lists (name, function) in order; each function takes (spark, docs, sf_dir) and
returns a DataFrame, and each works on all that its predecessor kept:

1. ``quality``   rows that the quality classifier rejects go;
2. ``dedup``     of each SimHash component one document stays (smallest doc_id);
3. ``secrets``   every secret found in a text is replaced by ``[secret]``; ``n_chars``, where it
                 is a number, becomes the length of the new text;
4. ``mix``       documents appear as often as the mix takes them (0 to 3 times);
5. ``pack``      the pieces of the documents with their sequence and offset.

All but the last return the columns of ``documents`` (with any extra ones). ``run`` writes
each stage as Parquet in the shared folder and rereads it, so a lost executor never costs
more than its own stage. SQL can express none of the stages (trained model, hashes, token
ids), so ``ORACLE_SQL`` is None and the tests compare with brute force.

A document that the mix repeats is packed as often; its copies have the same doc_id and
pieces and differ in sequence and offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from textvault.llm import mixing, packing, quality_model, secret_scan, simhash
from textvault.llm.queries import word_tokenizer
from textvault.llm.shared import documents, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs, threshold=2, shingle=3)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact(docs, "text", "[secret]")
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    if isinstance(kind, NumericType):
        clean = clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(kind))
    return clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, seed=7)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, word_tokenizer(), 4096)


STAGES = [("quality", quality), ("dedup", dedup), ("secrets", secrets), ("mix", mix), ("pack", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
