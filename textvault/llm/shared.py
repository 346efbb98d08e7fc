"""Helpers shared by the training-data operators.

Intermediate tables are Parquet under the shared checkpoint folder
(``spark.checkpoint.dir``), so a lost executor costs a re-read, never a rerun of
what came before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textvault.session import checkpoint_dir

BATCH_BYTES = "4m"             # of whole texts handed to Python at a time, however long single texts are
WORD = r"[^\x20\x09-\x0D]+"   # what counts as a word in every operator of this package


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches bounded in bytes: rows alone bound nothing when they are whole texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (for iterations); Spark's cleaner removes the files once unused."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def ranked(df: DataFrame, keys: list[str], order: list[Column], out: str, buckets: int = 512,
           spread_by: Column | None = None) -> DataFrame:
    """Gapless ranks 0.. within ``keys`` without bringing a key together.

    Rows of a key are dealt over ``buckets`` by a hash, ranked inside
    (key, bucket) and shifted by the running count of the buckets before. A key
    that holds a third of all rows is therefore ranked by ``buckets`` groups;
    the only window over a whole key sees at most ``buckets`` counts.
    The rank follows (bucket, ``order``). Keys must not be null. Working columns are ``__b``, ``__r``,
    ``__base``; ``df`` must not have them.
    """
    spread_by = F.xxhash64(*order) if spread_by is None else spread_by
    d = df.withColumn("__b", F.pmod(spread_by, F.lit(buckets)).cast("int"))
    counts = d.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    base = counts.withColumn("__base", F.sum("__n").over(
        Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).drop("__n")
    inner = d.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(*order)))
    return (inner.join(base, [*keys, "__b"], "left")
            .withColumn(out, (F.col("__r") - 1 + F.coalesce("__base", F.lit(0))).cast("long"))
            .drop("__b", "__r", "__base"))
