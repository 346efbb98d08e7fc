"""Keep a knowledge base in step with a folder using Structured Streaming.

The source reports new files, files with new contents and removals (:mod:`folder_changes`). ``foreachBatch``
turns each micro-batch into file and chunk rows, upserts them into the buckets they fall into and takes out
what went (one commit per batch, noted with its epoch and chunk parameters, so a replayed batch is skipped and the next
batch sync sees under which parameters chunks were made). Files are named by their path
below the folder: equal names in different folders do not collide. PDFs go through the
extractor hook. A batch also takes rows of Spark's ``binaryFile`` source, all of which count as present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textvault.functions.text import basename, extension
from textvault.hooks import extract_pages, text_extractor
from textvault.operators.store import FILE_KEY, KnowledgeStore, delete_by_keys, upsert_keep_created
from textvault.plans import build as B
from textvault.session import scratch_path
from textvault.sources.files import read_documents
from textvault.streaming.folder_changes import FolderChanges


def below(path: Column, folder: str) -> Column:
    """The path of a file relative to ``folder`` (both with or without a scheme)."""
    plain = lambda c: F.regexp_replace(c, "^[a-z]+:/+", "/")
    root = plain(F.lit(folder.rstrip("/") + "/"))
    return F.replace(plain(path), root, F.lit(""))


def documents_of(batch: DataFrame, folder: str, extractor=text_extractor) -> DataFrame:
    """(filename, text) of a batch of (path, content) files."""
    listing = batch.select(below(F.col("path"), folder).alias("filename"), extension(basename(F.col("path"))).alias("ext"),
                           "content").filter(F.col("ext") != "caj")
    return read_documents(listing, extract_pages(listing.filter(F.col("ext") == "pdf"), extractor))


def upsert_batch(store: KnowledgeStore, batch: DataFrame, params: B.BuildParams, folder: str, epoch: int | None = None,
                 extractor=text_extractor) -> int | None:
    """Bring one batch of (path, content[, kind]) files into the store; returns the commit, or None if there is nothing to do.

    Where the store was made with other chunk parameters, its other chunks stay as they are and the note keeps the
    store's parameters apart from the batch's, so that the next sync chunks everything anew.
    """
    if epoch is not None and int(store.note().get("epoch", -1)) >= epoch:
        return None
    before = store.note().get("params", params.fingerprint())
    mixed = before if before == params.fingerprint() else f"{before} and {params.fingerprint()}"
    note = {"params": mixed} | ({} if epoch is None else {"epoch": epoch})
    spark = batch.sparkSession
    kind = F.col("kind") if "kind" in batch.columns else F.lit("new")
    batch.select("path", "content", kind.alias("kind")).write.parquet(raw := scratch_path(spark, "events"))
    events = spark.read.parquet(raw)
    documents_of(events.filter("kind <> 'removed'"), folder, extractor).write.parquet(path := scratch_path(spark, "batch"))
    docs = spark.read.parquet(path)
    name = below(F.col("path"), folder)
    gone = events.filter("kind = 'removed'").select(F.md5(name).alias(FILE_KEY))
    files, chunks = B.file_rows(docs, params), B.chunk_rows(docs, params)
    keys = files.select(FILE_KEY).unionByName(gone).distinct()
    if keys.isEmpty():
        return None
    if store.files() is None:
        return store.rebuild(files, chunks, **note)
    touched = store.touched(keys)
    old_f, old_c = (x.filter(F.col("bucket").isin(touched)).drop("bucket") for x in (store.files(), store.chunks()))
    new_f = upsert_keep_created(delete_by_keys(old_f, gone), files, FILE_KEY)
    return store.commit(new_f, delete_by_keys(old_c, keys).unionByName(chunks), touched, **note)


def start(spark: SparkSession, folder: str, store_root: str, checkpoint: str, params: B.BuildParams,
          available_now: bool = True, extractor=text_extractor, seconds: int = 30):
    """Start the stream; with ``available_now`` it processes what there is and stops.

    Listings are kept below ``checkpoint``, which must be a folder that driver and executors share.
    """
    spark.dataSource.register(FolderChanges)
    src = spark.readStream.format("folder_changes").option("state", f"{checkpoint.rstrip('/')}/listings").load(folder)
    store = KnowledgeStore(spark, store_root)
    w = (src.writeStream.foreachBatch(lambda df, epoch: upsert_batch(store, df, params, folder, epoch, extractor))
         .option("checkpointLocation", f"{checkpoint.rstrip('/')}/query"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{seconds} seconds")
    return w.start()
