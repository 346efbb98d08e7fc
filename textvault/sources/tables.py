"""Inputs built from the supplied parquet tables.

Every view keeps the whole table; derived snapshots use data attributes
(labels) rather than id arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


INPUT_PARTITIONS = "textvault.input.partitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as it is stored. Only where a session asks for it (``INPUT_PARTITIONS``, unset
    by default) are its rows dealt anew: a laptop reading files of one row group each."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    parts = spark.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(parts)) if parts else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(filename, raw_text) from ``documents``; one text file per document."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
                    F.col("text").alias("raw_text"))


def corpus_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(filename, html) from ``pages``."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("filename"),
                    F.col("html"))


def corpus_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(filename, page_no, text): conversation turns stand in for PDF pages."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit(".pdf")).alias("filename"),
                    F.col("turn").alias("page_no"), F.col("text"))


def queries_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text) from ``benchmark``."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.col("text"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, embedding, label) from ``embeddings``."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding"), F.col("label"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two listings of the corpus for incremental-sync work.

    * old: documents that carry a label row; a document labelled quality 0 was
      stored with a different text (``text || ' old'``), so it now counts as changed.
    * new: every document except those labelled toxic (removed since).
    So some files are new, some deleted, some changed, the rest unchanged.
    """
    docs = corpus(spark, sf_dir).withColumn(
        "doc_id", F.regexp_extract("filename", r"_(\d+)\.txt$", 1).cast("bigint"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    old = (docs.join(labels, "doc_id", "inner")
           .select("filename", F.when(F.col("quality") == 0, F.concat("raw_text", F.lit(" old")))
                   .otherwise(F.col("raw_text")).alias("raw_text")))
    gone = labels.filter(F.col("toxic") == 1).select("doc_id")
    new = docs.join(gone, "doc_id", "left_anti").select("filename", "raw_text")
    return old, new


def leveled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, idx, level, title) outline entries from conversation turns."""
    c = table(spark, sf_dir, "conversations")
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    return c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("idx"), level.alias("level"),
                    F.col("text").alias("title"))


def fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns wrapped in a code fence (markdown rendering input)."""
    c = table(spark, sf_dir, "conversations")
    nl = F.lit("\n")
    return c.select("conv_id", "turn", F.concat(F.lit("intro"), nl, F.lit("```py"), nl, F.col("text"), nl,
                                                F.lit("```"), nl, F.lit("end")).alias("text"))


def cjk_injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with CJK characters and spaced-out ideographs injected."""
    d = table(spark, sf_dir, "documents")
    t = F.translate(F.regexp_replace("text", "([aeio])", " $1 "), "aeio,.!", "用的采要，。！")
    return d.select("doc_id", t.alias("text"))


def broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the full stop before each line break removed."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.regexp_replace("text", r"\.\n", "\n").alias("text"))
