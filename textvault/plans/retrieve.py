"""Batch retrieval: file hits and chunk hits for many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textvault.functions.text import chunk_label, show_text
from textvault.hooks import HashingEmbedder
from textvault.operators.search import exact_topk
from textvault.operators.store import CHUNK_KEY, FILE_KEY, bucket_of
from textvault.plans.build import chunk_vectors, file_vectors

FILES_LABEL = "你可能感兴趣的文件"  # fixed value: transcript label of the file hits


def embed_queries(queries: DataFrame, embedder=None, text_col: str = "text") -> DataFrame:
    embedder = embedder or HashingEmbedder()
    return queries.select("query_id", embedder(F.col(text_col)).alias("embedding"))


def file_hits(files: DataFrame, qvecs: DataFrame, limit: int = 3, metric: str = "L2") -> DataFrame:
    """(query_id, rk, filename_md5, filename, distance); empty when limit <= 0.

    The search reads the vector columns alone; names are joined to the hits.
    """
    top = exact_topk(file_vectors(files).withColumnRenamed(FILE_KEY, "id"), qvecs, limit, metric)
    named = top.join(files.select(F.col(FILE_KEY).alias("id"), "filename"), "id")
    return named.select("query_id", "rk", F.col("id").alias(FILE_KEY), "filename", "distance")


def chunk_hits(chunks: DataFrame, qvecs: DataFrame, limit: int = 3, metric: str = "L2", buckets: int | None = None) -> DataFrame:
    """(query_id, rk, filename_md5_no, filename, chunk_no, chunk, distance).

    ``chunks`` that are partitioned by ``bucket`` into ``buckets`` are joined by bucket and key, so that
    texts are read from the buckets of the hits alone (dynamic partition pruning).
    """
    top = exact_topk(chunk_vectors(chunks).withColumnRenamed(CHUNK_KEY, "id"), qvecs, limit, metric)
    texts, keys = chunks.select(F.col(CHUNK_KEY).alias("id"), "filename", "chunk_no", "chunk", *(["bucket"] if buckets else [])), ["id"]
    if buckets:
        top, keys = top.withColumn("bucket", bucket_of(F.substring_index("id", "_", 1), buckets)), ["id", "bucket"]
    return top.join(texts, keys).select("query_id", "rk", F.col("id").alias(CHUNK_KEY), "filename", "chunk_no", "chunk", "distance")


def search_kbs(files: DataFrame, chunks: DataFrame, queries: DataFrame, file_limit: int = 3,
               chunk_limit: int = 3, metric: str = "L2", embedder=None,
               filename_filter: str | None = None, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both searches sharing one query embedding. ``filename_filter`` is an
    optional substring pre-filter on file names (an extension). ``buckets``: see :func:`chunk_hits`."""
    qv = embed_queries(queries, embedder)
    if filename_filter:
        files = files.filter(F.col("filename").contains(filename_filter))
        chunks = chunks.filter(F.col("filename").contains(filename_filter))
    return file_hits(files, qv, file_limit, metric), chunk_hits(chunks, qv, chunk_limit, metric, buckets)


def search_store(store, queries: DataFrame, file_limit: int = 3, chunk_limit: int = 3, metric: str = "L2", embedder=None,
                 filename_filter: str | None = None) -> tuple[DataFrame, DataFrame]:
    """:func:`search_kbs` over the tables that a sync or the stream maintains (a ``KnowledgeStore`` with a commit)."""
    return search_kbs(store.files(), store.chunks(), queries, file_limit, chunk_limit, metric, embedder, filename_filter, store.buckets)


def transcript(queries: DataFrame, fhits: DataFrame, chits: DataFrame) -> DataFrame:
    """Rows (query_id, ord, label, body) in display order: query, files, chunks."""
    q = queries.select("query_id", F.lit(0).cast("bigint").alias("ord"),
                       show_text(F.col("text")).alias("label"), F.lit("").alias("body"))
    f = (fhits.groupBy("query_id")
         .agg(F.expr("listagg(filename, '\\n') WITHIN GROUP (ORDER BY rk)").alias("names"))
         .select("query_id", F.lit(1).cast("bigint").alias("ord"), F.lit(FILES_LABEL).alias("label"),
                 show_text(F.col("names")).alias("body")))
    c = chits.select("query_id", (F.col("rk") + 1).cast("bigint").alias("ord"),
                     show_text(chunk_label(F.col("filename"), F.col("chunk_no"))).alias("label"),
                     show_text(F.col("chunk")).alias("body"))
    return q.unionByName(f).unionByName(c)
