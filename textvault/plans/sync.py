"""Incremental synchronisation of a knowledge base with a document listing.

One batch plan instead of a per-file loop:
manifest diff (full outer join on filename) -> change filter on text_md5 ->
build rows only for new and changed files -> cascade delete + upsert.
The diff shuffles only (filename, md5) pairs and is written once as a small table, so the
listing is read twice: for its fingerprints, and for the files that must be rebuilt (a store's sync keeps the
cleaned texts in the shared folder, so that they are computed once). Their texts are joined with the names to rebuild. Of the store only the buckets with a changed
file are read and rewritten. Chunks of unchanged files are rebuilt when the chunk
parameters differ from those of the last commit.

Defined results: a NULL text is an empty text (as a file that cannot be decoded); rows without a name are
not files and left out; of several rows of one name the one with the smallest fingerprint is the file, so
a second sync of the same listing finds nothing to do, in whatever order its rows come.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textvault.functions import text as TX
from textvault.operators.store import FILE_KEY, buckets_for, delete_all_by_filename_md5, delete_by_keys, upsert_keep_created
from textvault.plans import build as B
from textvault.session import scratch_path

# Per-file status labels shown to the user.
STATUS_LABEL = {"deleted": "已删除", "unchanged": "无改动", "rebuilt": "字符数="}

OUTGROWN = 4      # times the number of buckets there is, which a store must need before a sync deals it anew


def manifest(files: DataFrame) -> DataFrame:
    """(filename, text_md5) of stored files."""
    return files.select("filename", "text_md5")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(filename, text_md5, text_length, copies), one row per name, of preprocessed (filename, text) rows."""
    f = B.file_rows(named(docs), embed=False)
    one = F.min(F.struct("text_md5", F.col("text_length").cast("bigint").alias("text_length"))).alias("one")
    return f.groupBy("filename").agg(one, F.count(F.lit(1)).alias("copies")).select("filename", "one.*", "copies")


def named(docs: DataFrame) -> DataFrame:
    """The rows that have a name, with '' for a NULL text."""
    return docs.filter("filename is not null").withColumn("text", F.coalesce("text", F.lit("")))


def one_row_a_name(docs: DataFrame, status: DataFrame) -> DataFrame:
    """(filename, text) with the row that counts of each name. Only texts of repeated names are shuffled."""
    docs = named(docs).select("filename", "text")
    again = status.filter("copies > 1").select("filename", "new_md5")
    if again.isEmpty():
        return docs
    md5 = F.md5(TX.file_fingerprint_text(F.col("filename"), F.col("text")))
    repeated = docs.join(again, "filename").filter(md5 == F.col("new_md5")).select("filename", "text")
    return docs.join(again, "filename", "left_anti").unionByName(repeated.dropDuplicates(["filename"]))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(filename, status, label, old_md5, new_md5, text_length, copies) over the union of names.

    A missing old fingerprint reads as '' (lookup with default).
    """
    j = old.select("filename", F.col("text_md5").alias("old_md5")).join(
        new.select("filename", F.col("text_md5").alias("new_md5"), "text_length", "copies"), "filename", "full_outer")
    old_md5 = F.coalesce(F.col("old_md5"), F.lit(""))
    status = (F.when(F.col("new_md5").isNull(), "deleted")
              .when(F.col("new_md5") == old_md5, "unchanged")
              .when(F.col("old_md5").isNull(), "new")
              .otherwise("changed"))
    label = (F.when(status == "deleted", STATUS_LABEL["deleted"])
             .when(status == "unchanged", STATUS_LABEL["unchanged"])
             .otherwise(F.concat(F.lit(STATUS_LABEL["rebuilt"]), F.col("text_length").cast("string"))))
    return j.select("filename", status.alias("status"), label.alias("label"), "old_md5", "new_md5", "text_length", "copies")


def name_sets(old: DataFrame, new: DataFrame) -> DataFrame:
    """(filename, kind) of the set operations on two listings (deleted, added, kept, any): one flagged grouping."""
    both = old.select("filename", F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(
        new.select("filename", F.lit(0).alias("o"), F.lit(1).alias("n")))
    seen = both.groupBy("filename").agg((F.max("o") == 1).alias("o"), (F.max("n") == 1).alias("n"))
    kinds = F.array(F.when(F.col("o") & ~F.col("n"), "deleted"), F.when(F.col("n") & ~F.col("o"), "added"),
                    F.when(F.col("o") & F.col("n"), "kept"), F.lit("any"))
    return seen.select("filename", F.explode(F.array_compact(kinds)).alias("kind"))


def counts(status: DataFrame) -> DataFrame:
    """Files on disk, files stored, names compared and per-status counts (one row)."""
    c = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    return status.agg(c(F.col("new_md5").isNotNull()).alias("n_disk"),
                      c(F.col("old_md5").isNotNull()).alias("n_stored"),
                      F.count(F.lit(1)).cast("bigint").alias("n_compared"),
                      c(F.col("status") == "new").alias("n_new"),
                      c(F.col("status") == "changed").alias("n_changed"),
                      c(F.col("status") == "deleted").alias("n_deleted"),
                      c(F.col("status") == "unchanged").alias("n_unchanged"))


def written_status(files: DataFrame, new_docs: DataFrame) -> DataFrame:
    """The diff as a small table in the shared folder: each later use reads it."""
    path = scratch_path(new_docs.sparkSession, "status")
    diff(manifest(files), fingerprints(new_docs)).write.parquet(path)
    return new_docs.sparkSession.read.parquet(path)


def stored_texts(docs: DataFrame) -> DataFrame:
    """The named (filename, text) rows, computed once and kept in the shared folder for the steps of a sync."""
    path = scratch_path(docs.sparkSession, "texts")
    texts = named(docs).select("filename", "text")
    texts.write.parquet(path)
    return docs.sparkSession.read.schema(texts.schema).parquet(path)


def apply(files: DataFrame, chunks: DataFrame, new_docs: DataFrame, params: B.BuildParams,
          embed: bool = True, rechunk: bool = False, status: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(status, files_after, chunks_after) for a listing of (filename, text).

    Unchanged files keep their rows untouched (with ``rechunk`` their chunks are built
    anew); changed files keep their creation time.
    """
    status = written_status(files, new_docs) if status is None else status
    new_docs = one_row_a_name(new_docs, status)
    names = lambda *kinds: status.filter(F.col("status").isin(*kinds))
    keys = lambda *kinds: names(*kinds).select(F.md5("filename").alias(FILE_KEY))
    todo = new_docs.join(names("new", "changed").select("filename"), "filename", "left_semi")
    again = new_docs.join(names("new", "changed", "unchanged").select("filename"), "filename", "left_semi") if rechunk else todo
    kept_files, kept_chunks, _, _ = delete_all_by_filename_md5(files, chunks, None, None, keys("deleted"))
    stale = keys("changed", "unchanged") if rechunk else keys("changed")
    files_after = upsert_keep_created(kept_files, B.file_rows(todo, params, embed))
    chunks_after = delete_by_keys(kept_chunks, stale).unionByName(B.chunk_rows(again, params, embed))
    return status, files_after, chunks_after


def sync_store(store, new_docs: DataFrame, params: B.BuildParams) -> tuple[int, DataFrame]:
    """Run one incremental update against a :class:`KnowledgeStore` and commit it."""
    note = {"params": params.fingerprint()}
    new_docs = stored_texts(new_docs)
    files, chunks = store.files(), store.chunks()
    if files is None:
        status = written_status(new_docs.sparkSession.createDataFrame([], "filename string, text_md5 string"), new_docs)
        docs = one_row_a_name(new_docs, status)
        chars = status.agg(F.coalesce(F.sum("text_length"), F.lit(0)).alias("n")).first()["n"]
        return store.rebuild_from(docs, chars, lambda t: B.file_rows(t, params), lambda t: B.chunk_rows(t, params), **note), status
    rechunk = store.note().get("params") != note["params"]
    status = written_status(files, new_docs)
    chars = status.filter("status <> 'deleted'").agg(F.coalesce(F.sum("text_length"), F.lit(0)).alias("n")).first()["n"]
    outgrown = store.fixed is None and buckets_for(chars) > OUTGROWN * store.buckets
    touched = None
    if not (rechunk or outgrown):
        touched = store.touched(status.filter("status <> 'unchanged'").select(F.md5("filename").alias(FILE_KEY)))
        if not touched:
            return store.current_version(), status
        files, chunks = (x.filter(F.col("bucket").isin(touched)) for x in (files, chunks))
    _, fa, ca = apply(files.drop("bucket"), chunks.drop("bucket"), new_docs, params, True, rechunk, status)
    if touched is not None:
        return store.commit(fa, ca, touched, **note), status
    # a full refresh replaces what it reads: set it aside first
    if not rechunk:
        return store.rebuild(_aside(fa, "files"), _aside(ca, "chunks"), **note), status
    # all chunks are made anew, and only those of files that no listing names are kept
    keys = status.filter("status <> 'new'").select(F.md5("filename").alias(FILE_KEY))
    unnamed = delete_by_keys(chunks.select(FILE_KEY).distinct(), keys)
    rest = None if unnamed.isEmpty() else _aside(delete_by_keys(chunks.drop("bucket"), keys), "chunks")
    texts = one_row_a_name(new_docs, status)
    return store.refresh_from(_aside(fa, "files"), texts, lambda t: B.chunk_rows(t, params), rest, **note), status


def _aside(rows: DataFrame, name: str) -> DataFrame:
    path = scratch_path(rows.sparkSession, f"refresh-{name}")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def with_as_of(p: B.BuildParams, as_of) -> B.BuildParams:
    return replace(p, as_of=as_of)
