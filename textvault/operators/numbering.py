"""Gapless numbers over a whole table, and progress labels, without a window over everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textvault.functions.units import explode_items
from textvault.session import scratch_path


def numbered(rows: DataFrame, order: list[str], out: str = "n", total: str = "total") -> DataFrame:
    """``rows`` with numbers from 1 in the given order, and their total.

    Rows are range-partitioned once and written; each partition is numbered by itself and shifted by the
    counts of those before, a table of one row a partition. Rows equal in ``order`` share a partition and are
    numbered in any order, so it should tell rows apart. NULLs come first.
    """
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "numbered")
    rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    parts = spark.read.schema(StructType(list(rows.schema.fields)).add("_part", "integer")).parquet(path)
    counts = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)          # one row a partition
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shifts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(everything).alias(total))
    inner = Window.partitionBy("_part").orderBy(*order)
    return (parts.withColumn("_at", F.row_number().over(inner)).join(F.broadcast(shifts), "_part")
            .withColumn(out, (F.col("_before") + F.col("_at")).cast("bigint")).drop("_part", "_at", "_before"))


def label(n: Column, total: Column) -> Column:
    """``[n/total]``."""
    return F.concat(F.lit("["), n.cast("string"), F.lit("/"), total.cast("string"), F.lit("]"))


def progress(status: DataFrame) -> DataFrame:
    """(n, total, filename, line): one line of progress per file, ``[n/total] name: status``, in the order of names.

    ``status`` has filename and label, as the sync gives them.
    """
    x = numbered(status.select("filename", "label"), ["filename"])
    return x.select("n", "total", "filename", F.concat(label(F.col("n"), F.col("total")), F.lit(" "), "filename", F.lit(": "), "label").alias("line"))


def chunk_progress(docs: DataFrame, chunks_col: str = "chunks", text_col: str = "text") -> DataFrame:
    """(filename, chunk_no, line): ``[no + 1/number of chunks]`` and the file's length, per chunk of (filename, text, chunks)."""
    sizes = docs.select("filename", chunks_col, F.size(chunks_col).alias("total"), F.length(text_col).cast("string").alias("length"))
    each = explode_items(sizes, F.col(chunks_col), "chunk_no", "chunk", "filename", "total", "length")
    return each.select("filename", "chunk_no", F.concat(label(F.col("chunk_no") + 1, F.col("total")), F.lit(" 字符数="), "length").alias("line"))
