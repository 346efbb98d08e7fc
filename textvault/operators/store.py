"""Upsert, delete and a bucketed knowledge store.

Every mutation is a set operation: a key table is joined against the stored rows
(``left_anti`` to drop, ``unionByName`` to add). No key list travels through the driver.

Layout of a store root::

    <root>/files/bucket=<b>/    kbs_file rows
    <root>/chunks/bucket=<b>/   kbs_chunk rows of the same files
    <root>/_commits/<N>         note of commit N, written last

``bucket`` is a hash of ``filename_md5``; a rebuild makes as many as the texts need at ``BUCKET_CHARS``
each, so that a bucket stays one task's work at every size of the store. A commit rewrites only the buckets in which a file
changed (dynamic partition overwrite); the others are neither read nor written. Chunks are
written before files and the note last: what decides whether a file is up to date is
its file row, so a commit that breaks off is done again by the next sync.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FILE_KEY = "filename_md5"
CHUNK_KEY = "filename_md5_no"
BUCKET_CHARS = 64 << 20       # of texts in a bucket; chunks, vectors and the texts themselves take a few times that on disk
MAX_BUCKETS = 1 << 20
PIECE_CHARS = 2 << 20         # of texts that one task chunks and embeds


def buckets_for(chars: int) -> int:
    """Number of buckets for texts of that many characters."""
    return max(1, min(MAX_BUCKETS, -(-chars // BUCKET_CHARS)))


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def laid(texts: DataFrame, buckets: int, chars: int) -> DataFrame:
    """(filename, text) rows of that many characters, dealt by a hash of the file into pieces of a bucket of about ``PIECE_CHARS``
    each: what is made of them is many times their size and work, and keeps its bucket."""
    parts = max(1, min(20_000, -(-chars // PIECE_CHARS)))
    key = F.md5("filename")
    piece = F.pmod(F.hash(key), F.lit(-(-parts // buckets)))
    return texts.select("filename", "text").repartition(parts, bucket_of(key, buckets), piece)


def upsert(base: DataFrame, updates: DataFrame, key: str | list[str]) -> DataFrame:
    """INSERT OR REPLACE on a unique key: rows of ``updates`` win, and of several with one key the greatest by all
    their columns in order (rows have no order that could make one the last). Rows with a NULL in the key have none: those of
    ``updates`` are left out."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in updates.columns if c not in keys]
    once = updates.dropna(subset=keys)
    once = once.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_row")).select(*keys, "_row.*") if rest else once.distinct()
    return _replaced(base, once.select(*updates.columns), keys)


def _replaced(base: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`upsert` of rows whose keys are known to be unique."""
    return base.join(updates.select(*keys), keys, "left_anti").unionByName(updates, allowMissingColumns=True)


def upsert_keep_created(base: DataFrame, updates: DataFrame, key: str = FILE_KEY,
                        created: str = "create_time") -> DataFrame:
    """Upsert of rows with unique keys that keeps the stored creation time of replaced rows."""
    old_created = base.select(key, F.col(created).alias("_old_created"))
    upd = (updates.join(old_created, key, "left")
           .withColumn(created, F.coalesce("_old_created", F.col(created))).drop("_old_created"))
    return _replaced(base, upd, [key])


def lookup(rows: DataFrame, value: str, key: str = FILE_KEY) -> DataFrame:
    """Rows with one key: a filter that reaches the scan."""
    return rows.filter(F.col(key) == value)


def delete_by_keys(rows: DataFrame, keys: DataFrame, key: str = FILE_KEY) -> DataFrame:
    """DELETE ... WHERE key IN (keys): an anti join, never a literal list."""
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def delete_all_by_filename_md5(files: DataFrame, chunks: DataFrame, file_vecs: DataFrame | None,
                               chunk_vecs: DataFrame | None, keys: DataFrame):
    """Cascade: file rows, chunk rows and both vector sets of the given files."""
    chunk_ids = chunks.join(keys.select(FILE_KEY).distinct(), FILE_KEY, "left_semi").select(CHUNK_KEY)
    out = [delete_by_keys(files, keys), delete_by_keys(chunks, keys)]
    out.append(delete_by_keys(file_vecs, keys) if file_vecs is not None else None)
    out.append(chunk_vecs.join(chunk_ids, CHUNK_KEY, "left_anti") if chunk_vecs is not None else None)
    return tuple(out)


def delete_chunk_by_filename_md5(chunks: DataFrame, keys: DataFrame) -> DataFrame:
    return delete_by_keys(chunks, keys)


class KnowledgeStore:
    """File and chunk tables under one root on a shared file system, in hash buckets."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        """``buckets``: a fixed number instead of the one that a rebuild finds from the size."""
        self.spark, self.root, self.fixed = spark, root.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        last = self.note()
        self.buckets = int(last["buckets"]) if last else buckets or 1

    def bucket(self, key: Column) -> Column:
        return bucket_of(key, self.buckets)

    # -- commits ------------------------------------------------------------
    def versions(self) -> list[int]:
        p = self._Path(f"{self.root}/_commits")
        if not self._fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(p) if s.getPath().getName().isdigit())

    def current_version(self) -> int | None:
        v = self.versions()
        return v[-1] if v else None

    def note(self) -> dict:
        """What the last commit noted: buckets, chunk parameters, stream epoch, schemas."""
        v = self.current_version()
        if v is None:
            return {}
        text = self.spark.read.text(f"{self.root}/_commits/{v}", wholetext=True).first()["value"]
        return json.loads(text)

    def _read(self, table: str) -> DataFrame | None:
        note = self.note()     # holds the schema, which an emptied table has no file to tell from
        return self.spark.read.schema(StructType.fromJson(note[table])).parquet(f"{self.root}/{table}") if note else None

    def files(self) -> DataFrame | None:
        return self._read("files")

    def chunks(self) -> DataFrame | None:
        return self._read("chunks")

    # -- writes ---------------------------------------------------------------
    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of the given files (at most ``buckets`` numbers)."""
        return [r["b"] for r in keys.select(self.bucket(F.col(FILE_KEY)).alias("b")).distinct().collect()]

    def _write(self, rows: DataFrame, table: str, touched: list[int] | None, dealt: bool = False) -> None:
        path = f"{self.root}/{table}"
        rows = rows.drop("bucket").withColumn("bucket", self.bucket(F.col(FILE_KEY)))
        before = {b: self._names(f"{path}/bucket={b}") for b in touched or []}
        # rebalance: tasks of similar size whatever the buckets hold
        ((rows if dealt else rows.hint("rebalance", "bucket")).write.mode("overwrite").partitionBy("bucket")
         .option("partitionOverwriteMode", "static" if touched is None else "dynamic").parquet(path))
        for b, names in before.items():              # a bucket whose last file went gets no new files
            if names and self._names(f"{path}/bucket={b}") == names:
                self._fs.delete(self._Path(f"{path}/bucket={b}"), True)

    def _names(self, folder: str) -> set[str]:
        p = self._Path(folder)
        return {s.getPath().getName() for s in self._fs.listStatus(p)} if self._fs.exists(p) else set()

    def commit(self, files: DataFrame, chunks: DataFrame, touched: list[int] | None = None, dealt: bool = False, **note) -> int:
        """Write the rows of the touched buckets (None: a full refresh) and note the commit. ``dealt``: rows come
        by bucket (:func:`laid`)."""
        self._write(chunks, "chunks", touched, dealt)
        self._write(files, "files", touched, dealt)
        v = (self.current_version() or 0) + 1
        out = self._fs.create(self._Path(f"{self.root}/_commits/{v}"), False)
        schema = lambda df: StructType([f for f in df.schema.fields if f.name != "bucket"]).add("bucket", "integer").jsonValue()
        fields = {"buckets": self.buckets, **note, "files": schema(files), "chunks": schema(chunks)}
        out.write(bytearray(json.dumps(fields).encode("utf-8")))
        out.close()
        return v

    def rebuild(self, files: DataFrame, chunks: DataFrame, **note) -> int:
        """Full refresh: nothing of earlier commits stays, and the number of buckets follows the size."""
        chars = files.agg(F.coalesce(F.sum(F.col("text_length").cast("bigint")), F.lit(0)).alias("n")).first()["n"]
        self.buckets = self.fixed or buckets_for(chars)
        return self.commit(files, chunks, None, **note)

    def rebuild_from(self, texts: DataFrame, chars: int, file_rows, chunk_rows, **note) -> int:
        """:meth:`rebuild` of what the two functions make of (filename, text) rows of that many characters, which are
        dealt to the buckets before they become chunks and vectors of several times their size."""
        self.buckets = self.fixed or buckets_for(chars)
        texts = laid(texts, self.buckets, chars)
        return self.commit(file_rows(texts), chunk_rows(texts), None, True, **note)

    def refresh_from(self, files: DataFrame, texts: DataFrame, chunk_rows, rest: DataFrame | None = None, **note) -> int:
        """:meth:`rebuild` with file rows, and with the chunk rows that the function makes of (filename, text) rows and those of
        ``rest``. Texts are dealt to the buckets, not chunks with their vectors, and chunks are written once: nothing here reads the store's own."""
        chars = files.agg(F.coalesce(F.sum(F.col("text_length").cast("bigint")), F.lit(0)).alias("n")).first()["n"]
        self.buckets = self.fixed or buckets_for(chars)
        chunks = chunk_rows(laid(texts, self.buckets, chars))
        dealt = files.withColumn("bucket", self.bucket(F.col(FILE_KEY))).hint("rebalance", "bucket")
        return self.commit(dealt, chunks if rest is None else chunks.unionByName(rest), None, True, **note)
