"""Knowledge-base rows from documents: one narrow stage per document.

``file_rows`` and ``chunk_rows`` are projections of the document table; the
only wide operator is ``posexplode`` of each document's chunk array. Nothing
shuffles until the rows are written or joined.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textvault.functions import text as TX
from textvault.functions.units import explode_items, with_chunks, word_tokens
from textvault.hooks import HashingEmbedder
from textvault.operators import store as ST


@dataclass(frozen=True)
class BuildParams:
    chunk_size: int = 400
    chunk_overlap: int = 0
    chunk_limit: int | None = None  # every chunk; a number keeps only the first ones
    as_of: dt.datetime = field(default=dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc))
    embedder: object = field(default_factory=HashingEmbedder)
    tokenizer: object = word_tokens  # Column function, or a PandasTokenizer

    def as_of_col(self) -> Column:
        return F.timestamp_millis(F.lit(int(self.as_of.timestamp() * 1000)))

    def fingerprint(self) -> str:
        return f"{self.chunk_size}/{self.chunk_overlap}/{self.chunk_limit}"


def preprocess(corpus: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """(filename, text) with the cleaning pipeline applied."""
    return corpus.select("filename", TX.text_preprocess(F.col(text_col)).alias("text"))


def file_rows(docs: DataFrame, p: BuildParams = BuildParams(), embed: bool = True) -> DataFrame:
    """kbs_file rows from (filename, text) where text is already preprocessed."""
    fn, text = F.col("filename"), F.col("text")
    fmd5 = F.md5(fn)
    full = TX.file_fingerprint_text(fn, text)
    cols = [
        TX.stable_id(fmd5).alias("id"),
        fmd5.alias("filename_md5"),
        text.alias("text"),
        fn.alias("filename"),
        F.lit("").alias("summary"),
        TX.extension(fn).alias("type"),
        p.as_of_col().alias("create_time"),
        F.length(text).alias("text_length"),
        F.md5(full).alias("text_md5"),
        p.as_of_col().alias("update_time"),
    ]
    if embed:
        cols.append(p.embedder(full).alias("embedding"))
    return docs.select(*cols)


def chunk_rows(docs: DataFrame, p: BuildParams = BuildParams(), embed: bool = True) -> DataFrame:
    """kbs_chunk rows: one per chunk of each (filename, text)."""
    chunked = with_chunks(docs.select("filename", "text"), "text", "_chunks", p.chunk_size, p.chunk_overlap,
                          p.chunk_limit, p.tokenizer)
    exploded = explode_items(chunked, F.col("_chunks"), "chunk_no", "chunk", "filename")
    fn, no, ch = F.col("filename"), F.col("chunk_no"), F.col("chunk")
    fmd5 = F.md5(fn)
    full = TX.chunk_fingerprint_text(fn, no, ch)
    key = TX.chunk_key(fmd5, no)
    cols = [
        TX.stable_id(F.md5(key)).alias("id"),
        fmd5.alias("filename_md5"),
        key.alias("filename_md5_no"),
        ch.alias("chunk"),
        no.alias("chunk_no"),
        F.length(ch).alias("chunk_length"),
        F.lit("").alias("summary"),
        fn.alias("filename"),
        p.as_of_col().alias("create_time"),
        F.md5(full).alias("chunk_md5"),
        p.as_of_col().alias("update_time"),
    ]
    if embed:
        cols.append(p.embedder(full).alias("embedding"))
    return exploded.select(*cols)


def file_vectors(files: DataFrame) -> DataFrame:
    """The file vector collection: (filename_md5, text_md5, embedding)."""
    return files.select("filename_md5", "text_md5", "embedding")


def chunk_vectors(chunks: DataFrame) -> DataFrame:
    """The chunk vector collection: (filename_md5_no, filename_md5, chunk_no, chunk_md5, embedding)."""
    return chunks.select("filename_md5_no", "filename_md5", F.col("chunk_no").cast("bigint").alias("chunk_no"),
                         "chunk_md5", "embedding")


def document_profile(texts: DataFrame, p: BuildParams = BuildParams(), text_col: str = "text") -> DataFrame:
    """Per text: chunks, chunk count, length, embedding and md5 (plus JSON)."""
    t = F.col(text_col)
    prof = with_chunks(texts, text_col, "_chunks", p.chunk_size, p.chunk_overlap, p.chunk_limit, p.tokenizer).select(
        *texts.columns, F.struct(F.col("_chunks").alias("chunks"), F.size("_chunks").alias("chunks_count"),
                                 F.length(t).alias("text_length"), p.embedder(t).alias("embedding"),
                                 F.md5(t).alias("md5")).alias("profile"))
    return prof.withColumn("profile_json", F.to_json("profile"))


class Knowledge:
    """File and chunk tables with their vectors on shared storage, written once and searched many times.

    Chunks are partitioned by a hash bucket of their file, so that the texts of a few hits are read from their
    buckets alone.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._buckets: int | None = None

    @classmethod
    def build(cls, docs: DataFrame, path: str, p: BuildParams = BuildParams()) -> Knowledge:
        """Write the tables of (filename, text) rows. Chunks are cut from the stored texts, so that these are
        computed once, and are laid by bucket as texts, before each becomes chunks and vectors of several times its size."""
        kb = cls(docs.sparkSession, path)
        file_rows(docs, p).write.mode("overwrite").parquet(f"{kb.path}/files")
        chars = kb.files().agg(F.coalesce(F.sum(F.col("text_length").cast("bigint")), F.lit(0)).alias("n")).first()["n"]
        kb._buckets = ST.buckets_for(chars)
        texts = ST.laid(kb.files(), kb._buckets, chars)
        chunks = chunk_rows(texts, p).withColumn("bucket", ST.bucket_of(F.col("filename_md5"), kb._buckets))
        chunks.write.mode("overwrite").partitionBy("bucket").parquet(f"{kb.path}/chunks")
        chunks.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{kb.path}/layout")
        kb.spark.createDataFrame([(kb._buckets,)], "n int").coalesce(1).write.mode("overwrite").parquet(f"{kb.path}/buckets")
        return kb

    @property
    def buckets(self) -> int:
        if self._buckets is None:
            self._buckets = self.spark.read.parquet(f"{self.path}/buckets").first()["n"]
        return self._buckets

    def files(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/files")

    def chunks(self, with_bucket: bool = False) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/layout").schema      # an empty table has no other
        chunks = self.spark.read.schema(schema).parquet(f"{self.path}/chunks")
        return chunks if with_bucket else chunks.drop("bucket")
