"""Further registered queries: progress labels, file names, statements, extractors, bytes, the store.

As in :mod:`textvault.catalog`, each reads whole tables and has a DuckDB twin that states its
own patterns and values.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textvault import catalog as C
from textvault import hooks as HO
from textvault.catalog import register
from textvault.functions import units as UN
from textvault.functions import vectors as V
from textvault.operators import fuzzy as FZ
from textvault.operators import numbering as NU
from textvault.operators import store as ST
from textvault.plans import build as B
from textvault.plans import duck as D
from textvault.plans import retrieve as R
from textvault.plans import statements as STM
from textvault.plans import sync as SY
from textvault.sources import files as FS
from textvault.sources import tables as TB

# ---------------------------------------------------------------------------
# progress labels
# ---------------------------------------------------------------------------


@register("sync_progress", f"""WITH {C._sync_status_ctes()},
l AS (SELECT filename, CASE status WHEN 'deleted' THEN '已删除' WHEN 'unchanged' THEN '无改动' ELSE '字符数=' || CAST(text_length AS VARCHAR) END AS label,
      row_number() OVER (ORDER BY filename) AS n, count(*) OVER () AS total FROM st)
SELECT n, total, filename, '[' || n || '/' || total || '] ' || filename || ': ' || label AS line FROM l""")
def q_sync_progress(spark, sf):
    st = SY.diff(SY.manifest(C._old_kb(spark, sf).files()), SY.fingerprints(C._snapshots(spark, sf)[1]))
    return NU.progress(st)


@register("chunk_progress", f"""WITH RECURSIVE {D.corpus_cte()},
{D.preprocess_ctes('corpus', 'filename', 'raw_text')},
{D.chunk_ctes('pre', 'filename', 'text', 400, 0, None)}
SELECT filename, CAST(chunk_no AS BIGINT) AS chunk_no, '[' || (chunk_no + 1) || '/' || count(*) OVER (PARTITION BY filename) || '] 字符数=' || length(p.text) AS line
FROM chunks JOIN pre p USING (filename)""")
def q_chunk_progress(spark, sf):
    d = UN.with_chunks(C.docs_clean(spark, sf), "text", "chunks", 400, 0)
    return NU.chunk_progress(d).withColumn("chunk_no", F.col("chunk_no").cast("bigint"))


# ---------------------------------------------------------------------------
# file names
# ---------------------------------------------------------------------------

_NAMES_SQL = """n AS (SELECT concat(source, '_', CAST(doc_id AS VARCHAR), '.txt') AS filename, doc_id, source FROM documents),
p AS (SELECT DISTINCT concat(source, '-', CAST(doc_id AS VARCHAR), '.tx') AS pattern FROM n JOIN labels USING (doc_id) WHERE toxic = 1
      UNION ALL SELECT DISTINCT source FROM n WHERE source IS NOT NULL)"""


@register("fuzzy_names", f"""WITH {_NAMES_SQL},
s AS (SELECT DISTINCT source AS filename FROM n UNION ALL SELECT filename FROM n)
SELECT pattern, filename AS name, CAST(levenshtein(pattern, filename) AS BIGINT) AS distance FROM p JOIN s ON levenshtein(pattern, filename) <= 2""")
def q_fuzzy_names(spark, sf):
    docs = TB.table(spark, sf, "documents").select("doc_id", "source")
    bad = TB.table(spark, sf, "labels").filter("toxic = 1").select("doc_id").distinct()
    typed = docs.join(bad, "doc_id", "left_semi").select(F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".tx")).alias("pattern")).distinct()
    sources = docs.filter("source is not null").select("source").distinct()
    names = TB.corpus(spark, sf).select("filename").unionByName(sources.withColumnRenamed("source", "filename"))
    return FZ.fuzzy_match(names, typed.unionByName(sources.withColumnRenamed("source", "pattern")), 2)


@register("search_named_files", f"""WITH {C._fw_ctes()},
chosen AS (SELECT vw.* FROM vw JOIN fp USING (id) WHERE contains(fp.filename, '1')),
top AS ({D.sparse_topk_sql('qw', 'chosen', C.SEARCH_K, 'L2', 'filename_md5')})
SELECT CAST(t.query_id AS BIGINT) AS query_id, CAST(t.rk AS BIGINT) AS rk, f.filename, t.distance FROM top t JOIN fp f ON f.id = t.filename_md5""")
def q_search_named_files(spark, sf):
    kb = C.knowledge(spark, sf)
    files, _ = R.search_kbs(kb.files(), kb.chunks(), TB.queries_text(spark, sf), C.SEARCH_K, 0, filename_filter="1")
    return files.select(F.col("query_id").cast("bigint"), F.col("rk").cast("bigint"), "filename", F.round("distance", 6).alias("distance"))


# ---------------------------------------------------------------------------
# statements with parameters
# ---------------------------------------------------------------------------

@register("statement_lookup", f"""WITH {D.corpus_cte()},
{D.preprocess_ctes('corpus', 'filename', 'raw_text')}
SELECT filename, md5({D.file_fp('filename', 'text')}) AS text_md5 FROM pre WHERE filename = (SELECT min(filename) FROM pre)""")
def q_statement_lookup(spark, sf):
    files = C.knowledge(spark, sf).files()
    return STM.file_by_key(files, files.agg(F.md5(F.min("filename")).alias("k")).first()["k"])


@register("statement_chunk_keys", f"""WITH RECURSIVE {D.corpus_cte()},
{D.preprocess_ctes('corpus', 'filename', 'raw_text')},
{D.chunk_ctes('pre', 'filename', 'text', 400, 0, None)}
SELECT md5(filename) || '_' || CAST(chunk_no AS VARCHAR) AS filename_md5_no FROM chunks WHERE filename = (SELECT max(filename) FROM chunks)""")
def q_statement_chunk_keys(spark, sf):
    chunks = C.knowledge(spark, sf).chunks()
    return STM.chunk_keys_of_file(chunks, chunks.agg(F.md5(F.max("filename")).alias("k")).first()["k"])


@register("statement_in_list", "SELECT DISTINCT min(concat(source, '_', CAST(doc_id AS VARCHAR), '.txt')) AS filename FROM documents GROUP BY source")
def q_statement_in_list(spark, sf):
    # one key a source of documents: a short list
    first = TB.table(spark, sf, "documents").groupBy("source").agg(F.md5(F.min(F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt")))).alias("k"))
    return STM.files_in(C.knowledge(spark, sf).files(), [r["k"] for r in first.collect()])


@register("statement_hit_join", C.ORACLE["chunk_search_l2"])
def q_statement_hit_join(spark, sf):
    chunks = C.knowledge(spark, sf).chunks()
    hits = R.exact_topk(R.chunk_vectors(chunks).withColumnRenamed("filename_md5_no", "id"), R.embed_queries(TB.queries_text(spark, sf)), C.SEARCH_K)
    h = STM.hit_rows(hits, chunks)
    return h.select(F.col("query_id").cast("bigint"), F.col("rk").cast("bigint"), "filename", F.col("chunk_no").cast("bigint"),
                    F.round("distance", 6).alias("distance"), F.md5("chunk").alias("chunk_md5"))


# ---------------------------------------------------------------------------
# extractors
# ---------------------------------------------------------------------------

@register("lateral_pages", """SELECT 'conv_' || CAST(conv_id AS VARCHAR) || '.pdf' AS filename,
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS page_no, text FROM conversations""")
def q_lateral_pages(spark, sf):
    c = TB.corpus_pages(spark, sf)
    files = c.groupBy("filename").agg(F.expr("listagg(text, '\x0c') WITHIN GROUP (ORDER BY page_no)").alias("t"))
    HO.register_extractor(spark)
    return HO.lateral_pages(files.select("filename", F.encode("t", "UTF-8").alias("content")))


# ---------------------------------------------------------------------------
# the maintained store
# ---------------------------------------------------------------------------

def synced_store(spark, sf) -> ST.KnowledgeStore:
    """A store that was filled with the old listing and synced with the new one, once per session and input."""
    def build(path):
        store = ST.KnowledgeStore(spark, path)
        old, new = C._snapshots(spark, sf)
        SY.sync_store(store, old, C._OLD_P)
        SY.sync_store(store, new, C._NEW_P)
        return store
    return C.built(spark, sf, "store", build)


@register("store_files", C.ORACLE["sync_files_after"])
def q_store_files(spark, sf):
    return synced_store(spark, sf).files().select("filename_md5", "filename", "text_md5", F.unix_millis("create_time").alias("create_ms"),
                                                  F.unix_millis("update_time").alias("update_ms"))


@register("store_chunks", C.ORACLE["sync_chunks_after"])
def q_store_chunks(spark, sf):
    return synced_store(spark, sf).chunks().select("filename_md5_no", "chunk_md5", F.unix_millis("update_time").alias("update_ms"))


@register("store_search", f"""WITH RECURSIVE {C._SNAP_SQL},
{D.preprocess_ctes('new_src', 'filename', 'raw_text', 'newp')},
{D.chunk_ctes('newp', 'filename', 'text', 400, 0, None)},
cp AS (SELECT md5(filename) || '_' || CAST(chunk_no AS VARCHAR) AS id, filename, chunk_no,
              {D.chunk_fp('filename', 'chunk_no', 'chunk')} AS full_text, chunk FROM chunks),
{D.sparse_embedding_ctes('cp', 'id', 'full_text', 512, 'vw')},
qs AS (SELECT item_id AS query_id, text FROM benchmark),
{D.sparse_embedding_ctes('qs', 'query_id', 'text', 512, 'qw')},
top AS ({D.sparse_topk_sql('qw', 'vw', C.SEARCH_K, 'L2', 'filename_md5_no')})
SELECT CAST(t.query_id AS BIGINT) AS query_id, CAST(t.rk AS BIGINT) AS rk, c.filename, CAST(c.chunk_no AS BIGINT) AS chunk_no,
       t.distance, md5(c.chunk) AS chunk_md5 FROM top t JOIN cp c ON c.id = t.filename_md5_no""")
def q_store_search(spark, sf):
    _, hits = R.search_store(synced_store(spark, sf), TB.queries_text(spark, sf), 0, C.SEARCH_K)
    return hits.select(F.col("query_id").cast("bigint"), F.col("rk").cast("bigint"), "filename", F.col("chunk_no").cast("bigint"),
                       F.round("distance", 6).alias("distance"), F.md5("chunk").alias("chunk_md5"))


@register("store_refresh_chunks", C.ORACLE["sync_rechunked"])
def q_store_refresh_chunks(spark, sf):
    """The full refresh that other chunk parameters cause."""
    def build(path):
        store = ST.KnowledgeStore(spark, path)
        SY.sync_store(store, C._snapshots(spark, sf)[0], C._OLD_P)
        SY.sync_store(store, C._snapshots(spark, sf)[1], C._SMALL_P)
        return store
    return C.built(spark, sf, "store-refresh", build).chunks().select("filename_md5_no", "chunk_md5")


@register("chunks_deleted", f"""WITH RECURSIVE {C._sync_status_ctes()},
{D.chunk_ctes('oldp', 'filename', 'text', 400, 0, None, 'oc')}
SELECT md5(filename) || '_' || CAST(chunk_no AS VARCHAR) AS filename_md5_no FROM oc WHERE filename NOT IN (SELECT filename FROM st WHERE status = 'changed')""")
def q_chunks_deleted(spark, sf):
    kb = C._old_kb(spark, sf)
    st = SY.written_status(kb.files(), C._snapshots(spark, sf)[1])
    gone = st.filter(F.col("status") == "changed").select(F.md5("filename").alias(ST.FILE_KEY))
    return ST.delete_chunk_by_filename_md5(kb.chunks(), gone).select("filename_md5_no")


@register("sync_repeated_names", f"""WITH {C._SNAP_SQL},
twice AS (SELECT filename, raw_text FROM new_src UNION ALL SELECT d.filename, d.text || ' again' FROM docs d JOIN labels l USING (doc_id) WHERE quality = 1
          UNION ALL SELECT filename || '.none', '' FROM new_src UNION ALL SELECT filename, raw_text FROM new_src),
rows_ AS (SELECT filename, raw_text, row_number() OVER () AS i FROM twice),
{D.preprocess_ctes('old_src', 'filename', 'raw_text', 'oldp')},
{D.preprocess_ctes('rows_', 'i', 'raw_text', 'newp')},
n AS (SELECT filename, md5({D.file_fp('filename', 'text')}) AS new_md5, length(text) AS text_length FROM newp JOIN rows_ USING (i)),
newm AS (SELECT filename, min(new_md5) AS new_md5, arg_min(text_length, new_md5) AS text_length, count(*) AS copies FROM n GROUP BY filename),
oldm AS (SELECT filename, md5({D.file_fp('filename', 'text')}) AS old_md5 FROM oldp)
SELECT coalesce(o.filename, n.filename) AS filename, CASE WHEN new_md5 IS NULL THEN 'deleted' WHEN new_md5 = old_md5 THEN 'unchanged'
       WHEN old_md5 IS NULL THEN 'new' ELSE 'changed' END AS status, new_md5, CAST(text_length AS BIGINT) AS text_length, CAST(copies AS BIGINT) AS copies
FROM oldm o FULL OUTER JOIN newm n ON o.filename = n.filename""")
def q_sync_repeated_names(spark, sf):
    _, new = TB.snapshots(spark, sf)
    good = TB.table(spark, sf, "labels").filter("quality = 1").select("doc_id")
    docs = TB.corpus(spark, sf).withColumn("doc_id", F.regexp_extract("filename", r"_(\d+)\.txt$", 1).cast("bigint"))
    again = docs.join(good, "doc_id").select("filename", F.concat("raw_text", F.lit(" again")).alias("raw_text"))
    none = new.select(F.concat("filename", F.lit(".none")).alias("filename"), F.lit(None).cast("string").alias("raw_text"))
    listing = B.preprocess(new.unionByName(again).unionByName(none).unionByName(new))
    st = SY.diff(SY.manifest(C._old_kb(spark, sf).files()), SY.fingerprints(listing))
    return st.select("filename", "status", "new_md5", "text_length", F.col("copies").cast("bigint"))


# ---------------------------------------------------------------------------
# listings, bytes and hooks
# ---------------------------------------------------------------------------

@register("listed_files", """WITH n AS (SELECT coalesce(source, 'none') AS dir, doc_id FROM documents)
SELECT DISTINCT '/in/' || dir || '/' || doc_id || '.txt' AS filename FROM n
UNION SELECT '/in/' || dir || '/' || doc_id || '.pdf' FROM n JOIN labels USING (doc_id) WHERE quality = 1""")
def q_listed_files(spark, sf):
    """Every document is a text, the labelled ones are .caj files, too, and those of quality 1 have a .pdf beside them."""
    d = TB.table(spark, sf, "documents").select(F.concat(F.lit("/in/"), F.coalesce("source", F.lit("none"))).alias("dir"), "doc_id")
    labelled = d.join(TB.table(spark, sf, "labels"), "doc_id")
    named = lambda df, ext: df.select("dir", F.concat(F.col("doc_id").cast("string"), F.lit(f".{ext}")).alias("filename"), F.lit(ext).alias("ext"))
    listing = named(d, "txt").unionByName(named(labelled, "caj")).unionByName(named(labelled.filter("quality = 1"), "pdf"))
    return FS.list_files(listing, "relpath")


@register("read_bytes", f"""WITH src AS (SELECT concat(d.source, '_', CAST(doc_id AS VARCHAR), '.txt') AS filename,
  CASE WHEN l.toxic = 1 THEN '' ELSE d.text END AS raw FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
{D.preprocess_ctes('src', 'filename', 'raw')}
SELECT filename, CAST(length(text) AS BIGINT) AS text_length, md5(text) AS text_md5 FROM pre""")
def q_read_bytes(spark, sf):
    """Files as bytes with the line ends of another system; those of toxic documents are no UTF-8."""
    toxic = TB.table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    d = TB.table(spark, sf, "documents").join(toxic, "doc_id", "left")
    name = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    body = F.encode(F.regexp_replace("text", "\n", "\r\n"), "UTF-8")
    broken = F.concat(body, F.unhex(F.lit("FF")))
    listing = d.select(name.alias("filename"), F.lit("txt").alias("ext"), F.when(F.col("toxic") == 1, broken).otherwise(body).alias("content"))
    t = FS.read_documents(listing)
    return t.select("filename", F.length("text").cast("bigint").alias("text_length"), F.md5("text").alias("text_md5"))


def _python_encoder():
    import hashlib

    import numpy as np
    import regex
    word = regex.compile(r"[\p{L}\p{N}]+")

    def encode(texts: list[str]):
        out = np.zeros((len(texts), 512))
        for i, t in enumerate(texts):
            for w in word.findall(t.lower()):
                out[i, int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 512] += 1
        n = np.sqrt((out * out).sum(1, keepdims=True))
        return (out / np.where(n > 0, n, 1)).astype(np.float32)

    return encode


@register("file_embedding_python", C.ORACLE["file_embedding"])
def q_file_embedding_python(spark, sf):
    """The embedder hook: a model loaded once a worker and called once an Arrow batch."""
    embedder = HO.PandasEmbedder(_python_encoder, lambda model, texts: model(texts), 512, "hashing")
    files = B.file_rows(C.docs_clean(spark, sf), B.BuildParams(embedder=embedder))
    return C._sparse_of(files.select("filename", "embedding"), "filename")


@register("vector_json", """SELECT vec_id AS id, CAST(len(embedding) AS BIGINT) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total
FROM embeddings""")
def q_vector_json(spark, sf):
    v = TB.vectors(spark, sf).select("id", F.from_json(V.embedding_json(F.col("embedding")), "array<double>").alias("e"))
    return v.select(F.col("id").cast("bigint"), F.size("e").cast("bigint").alias("n"),
                    F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))
