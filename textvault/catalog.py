"""Registered queries (Spark) and their DuckDB twins.

Each query reads the whole supplied tables. Floats are rounded to 6 digits
on both sides; integers are bigint; times are epoch milliseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textvault.functions import text as TX
from textvault.functions import units as UN
from textvault.functions import vectors as V
from textvault.hooks import HashingEmbedder
from textvault.operators import positions as PO
from textvault.operators import search as S
from textvault.operators import store as ST
from textvault.plans import build as B
from textvault.plans import duck as D
from textvault.plans import retrieve as R
from textvault.session import scratch_path
from textvault.sources import files as FS
from textvault.sources import tables as TB

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _r6(c):
    return F.round(c, 6)


def docs_clean(spark: SparkSession, sf: str) -> DataFrame:
    return B.preprocess(TB.corpus(spark, sf))


SEARCH_K = 3
VEC_K = 5
Q_DIM_EMB = 64  # benchmark texts hashed to the dimension of the ``embeddings`` table

_BUILT: dict = {}


def input_state(spark: SparkSession, sf: str) -> tuple:
    """Names, lengths and times of the table files, so that a changed table is built anew."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while files.hasNext():
        f = files.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def built(spark: SparkSession, sf: str, name: str, build):
    """What ``build(path)`` writes to the shared folder, once per session and state of the input files."""
    key = (spark.sparkContext.applicationId, sf, name, input_state(spark, sf))
    if key not in _BUILT:
        _BUILT[key] = build(scratch_path(spark, name))
    return _BUILT[key]


def knowledge(spark: SparkSession, sf: str) -> B.Knowledge:
    """The knowledge base of the corpus: cleaned, chunked and embedded once, then searched."""
    return built(spark, sf, "knowledge", lambda path: B.Knowledge.build(docs_clean(spark, sf), path))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Top-3 chunks per benchmark query over the cleaned, chunked, embedded corpus."""
    qv = R.embed_queries(TB.queries_text(spark, sf))
    kb = knowledge(spark, sf)
    hits = R.chunk_hits(kb.chunks(True), qv, SEARCH_K, buckets=kb.buckets)
    return hits.select(F.col("query_id").cast("bigint"), F.col("rk").cast("bigint"), "filename",
                       F.col("chunk_no").cast("bigint"), _r6(F.col("distance")).alias("distance"),
                       F.md5("chunk").alias("chunk_md5"))


# Fixed values, stated for the twins: escapes inside a code block, in order.
FENCE_ESCAPES = [('`', '\\`'), ('<', '&lt;'), ('>', '&gt;'), (' ', '&nbsp;'), ('*', '&ast;'), ('_', '&lowbar;'), ('-', '&#45;'), ('.', '&#46;'), ('!', '&#33;'), ('(', '&#40;'), (')', '&#41;'), ('$', '&#36;')]


def _show_text_sql(x: str) -> str:
    esc = "l"
    for a, b in FENCE_ESCAPES:
        esc = f"replace({esc}, {D.lit(a)}, {D.lit(b)})"
    return f"""CASE WHEN {x} = '' THEN '' ELSE (
  SELECT string_agg(CASE WHEN contains(l, '```') THEN
           CASE WHEN n % 2 = 1 THEN '<pre><code class="language-' || split_part(l, '`', -1) || '">' ELSE '<br></code></pre>' END
         WHEN i = 1 THEN l WHEN n % 2 = 1 THEN '<br>' || {esc} ELSE '<br>' || l END, '' ORDER BY i)
  FROM (SELECT l, i, sum(CASE WHEN contains(l, '```') THEN 1 ELSE 0 END) OVER (ORDER BY i) AS n
        FROM (SELECT unnest(ls) AS l, generate_subscripts(ls, 1) AS i
              FROM (SELECT list_filter(string_split({x}, chr(10)), lambda s: s <> '') AS ls)))) END"""


# ---------------------------------------------------------------------------
# text cleaning
# ---------------------------------------------------------------------------

def _pre_sql(src_cte: str, key: str, raw: str, select: str) -> str:
    return f"WITH {src_cte},\n{D.preprocess_ctes('src', key, raw)}\n{select}"


@register("preprocess_corpus", _pre_sql(
    "src AS (SELECT concat(source, '_', CAST(doc_id AS VARCHAR), '.txt') AS filename, text AS raw FROM documents)",
    "filename", "raw",
    "SELECT filename, CAST(length(text) AS BIGINT) AS text_length, md5(text) AS text_md5 FROM pre"))
def q_preprocess_corpus(spark, sf):
    d = docs_clean(spark, sf)
    return d.select("filename", F.length("text").cast("bigint").alias("text_length"),
                    F.md5("text").alias("text_md5"))


_CJK_SQL = ("src AS (SELECT doc_id, translate(regexp_replace(text, '([aeio])', ' \\1 ', 'g'), "
            "'aeio,.!', '用的采要，。！') AS raw FROM documents)")


@register("preprocess_cjk", _pre_sql(_CJK_SQL, "doc_id", "raw",
                                     "SELECT doc_id, CAST(length(text) AS BIGINT) AS text_length, "
                                     "md5(text) AS text_md5 FROM pre"))
def q_preprocess_cjk(spark, sf):
    d = TB.cjk_injected(spark, sf)
    t = TX.text_preprocess(F.col("text"))
    return d.select("doc_id", F.length(t).cast("bigint").alias("text_length"), F.md5(t).alias("text_md5"))


@register("preprocess_broken_lines", _pre_sql(
    "src AS (SELECT doc_id, regexp_replace(text, '\\.\\n', chr(10), 'g') AS raw FROM documents)",
    "doc_id", "raw",
    "SELECT doc_id, CAST(length(text) AS BIGINT) AS text_length, md5(text) AS text_md5 FROM pre"))
def q_preprocess_broken(spark, sf):
    d = TB.broken_lines(spark, sf)
    t = TX.text_preprocess(F.col("text"))
    return d.select("doc_id", F.length(t).cast("bigint").alias("text_length"), F.md5(t).alias("text_md5"))


@register("char_classes_cjk", f"""WITH {_CJK_SQL},
ch AS (SELECT doc_id, unnest(string_split(raw, '')) AS c FROM src)
SELECT doc_id,
  CAST(count(*) FILTER (WHERE c BETWEEN '一' AND '鿿') AS BIGINT) AS n_chinese,
  CAST(count(*) FILTER (WHERE regexp_matches(c, {D.lit('^[' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + D.IDEOGRAPHS + ']$')})) AS BIGINT) AS n_valid,
  CAST(count(*) FILTER (WHERE regexp_matches(c, {D.lit('^[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + D.SPACE + ']$')})) AS BIGINT) AS n_punct
FROM ch GROUP BY doc_id""")
def q_char_classes(spark, sf):
    d = TB.cjk_injected(spark, sf)
    chars = F.filter(F.split(F.col("text"), ""), lambda c: c != "")
    cnt = lambda pred: F.size(F.filter(chars, pred)).cast("bigint")
    out = d.select("doc_id", cnt(TX.is_character_chinese).alias("n_chinese"),
                   cnt(TX.is_character_valid).alias("n_valid"), cnt(TX.is_punctuation).alias("n_punct"))
    return out


# labels, near misses and blanks, put before every document so that all occur
_LABELS = ("图 3 x\n表..4\n式5\n注6 y\n引 7\nFig.2\nfig 2\nFIGURE 12\nFigure. 3\ntable 7\nTable.x\nEquation 1\nequ2\n 图8\n图x9\nsee Table 7\n"
           "1. one\n（2）two\n \t\n[3] three\n\n第4章 four\nplain\n")


@register("label_lines", f"""WITH l AS (SELECT doc_id, unnest(string_split({D.lit(_LABELS)} || text, {D.NL})) AS line FROM documents)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE regexp_matches(line, {D.lit(D.LABELS)})) AS BIGINT) AS n_labels,
       CAST(count(*) FILTER (WHERE {D.strip('line')} = '') AS BIGINT) AS n_blank
FROM l GROUP BY doc_id""")
def q_label_lines(spark, sf):
    d = TB.table(spark, sf, "documents")
    lines = F.split(F.concat(F.lit(_LABELS), "text"), "\n", -1)
    return d.select("doc_id", F.size(lines).cast("bigint").alias("n_lines"),
                    F.size(F.filter(lines, TX.is_label_number_format)).cast("bigint").alias("n_labels"),
                    F.size(F.filter(lines, lambda l: TX.py_strip(l) == "")).cast("bigint").alias("n_blank"))


# ---------------------------------------------------------------------------
# sentences, units, chunks
# ---------------------------------------------------------------------------

@register("sentences", f"""WITH {D.corpus_cte()},
{D.preprocess_ctes('corpus', 'filename', 'raw_text')},
lines AS (SELECT filename, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no
          FROM (SELECT filename, list_filter(list_transform(string_split(text, {D.NL}), lambda l: {D.strip('l')}), lambda l: l <> '') AS ls FROM pre)),
s AS (SELECT filename, line_no, {D.sentences('line')} AS ss FROM lines)
SELECT filename, CAST(line_no AS BIGINT) AS line_no, CAST(generate_subscripts(ss, 1) - 1 AS BIGINT) AS sent_no,
       unnest(ss) AS sentence FROM s""")
def q_sentences(spark, sf):
    d = docs_clean(spark, sf)
    lines = F.filter(F.transform(F.split("text", "\n", -1), TX.py_strip), lambda l: l != "")
    x = UN.explode_items(d, lines, "line_no", "line", "filename")
    y = UN.explode_items(x, UN.text_to_sentences(F.col("line")), "sent_no", "sentence", "filename", "line_no")
    return y.select("filename", F.col("line_no").cast("bigint"), F.col("sent_no").cast("bigint"), "sentence")


def _chunks_sql(size, overlap, limit):
    return f"""WITH RECURSIVE {D.corpus_cte()},
{D.preprocess_ctes('corpus', 'filename', 'raw_text')},
{D.chunk_ctes('pre', 'filename', 'text', size, overlap, limit)}
SELECT filename, CAST(chunk_no AS BIGINT) AS chunk_no, CAST(length(chunk) AS BIGINT) AS chunk_length,
       md5(chunk) AS chunk_text_md5,
       md5({D.chunk_fp('filename', 'chunk_no', 'chunk')}) AS chunk_md5 FROM chunks"""


def _chunks_query(size, overlap, limit):
    def q(spark, sf):
        d = UN.with_chunks(docs_clean(spark, sf), "text", "chunks", size, overlap, limit)
        x = UN.explode_items(d, F.col("chunks"), "chunk_no", "chunk", "filename")
        return x.select("filename", F.col("chunk_no").cast("bigint"), F.length("chunk").cast("bigint").alias("chunk_length"),
                        F.md5("chunk").alias("chunk_text_md5"),
                        F.md5(TX.chunk_fingerprint_text(F.col("filename"), F.col("chunk_no"), F.col("chunk"))).alias("chunk_md5"))
    return q


for _p in [(400, 0, None), (400, 2, None), (60, 1, 7), (1500, 1, None), (400, 3, 5)]:
    register("chunks_%d_%d_%s" % (*_p[:2], _p[2] or "all"), _chunks_sql(*_p))(_chunks_query(*_p))


@register("units_400", f"""WITH {D.corpus_cte()},
{D.preprocess_ctes('corpus', 'filename', 'raw_text')},
u AS (SELECT filename, {D.units('text', 400)} AS us FROM pre)
SELECT filename, CAST(len(us) AS BIGINT) AS n_units, CAST(coalesce(list_sum(list_transform(us, lambda x: length(x))), 0) AS BIGINT) AS units_length,
       md5(array_to_string(us, '|')) AS units_md5 FROM u""")
def q_units(spark, sf):
    d = docs_clean(spark, sf)
    u = UN.text_to_units(F.col("text"), 400)
    x = d.select("filename", u.alias("us"))
    return x.select("filename", F.size("us").cast("bigint").alias("n_units"),
                    F.aggregate("us", F.lit(0).cast("bigint"), lambda a, s: a + F.length(s)).alias("units_length"),
                    F.md5(F.array_join("us", "|")).alias("units_md5"))


def _python_words(sentence: str) -> list[str]:
    import regex
    return regex.findall(r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s\x1c-\x1f\x85\xa0]", sentence)


@register("units_python_tokenizer", ORACLE["units_400"])
def q_units_python(spark, sf):
    x = docs_clean(spark, sf).select("filename", UN.text_to_units(F.col("text"), 400, UN.PandasTokenizer(_python_words)).alias("us"))
    return x.select("filename", F.size("us").cast("bigint").alias("n_units"),
                    F.aggregate("us", F.lit(0).cast("bigint"), lambda a, s: a + F.length(s)).alias("units_length"),
                    F.md5(F.array_join("us", "|")).alias("units_md5"))


@register("doc_chunk_stats", f"""WITH RECURSIVE {D.corpus_cte()},
{D.preprocess_ctes('corpus', 'filename', 'raw_text')},
{D.chunk_ctes('pre', 'filename', 'text', 400, 0, None)}
SELECT p.filename, CAST(length(p.text) AS BIGINT) AS text_length, CAST(count(c.chunk_no) AS BIGINT) AS chunks_count,
       CAST(coalesce(sum(length(c.chunk)), 0) AS BIGINT) AS chunks_length
FROM pre p LEFT JOIN chunks c USING (filename) GROUP BY p.filename, p.text""")
def q_doc_chunk_stats(spark, sf):
    d = UN.with_chunks(docs_clean(spark, sf), "text", "chunks", 400, 0)
    return d.select("filename", F.length("text").cast("bigint").alias("text_length"),
                    F.size("chunks").cast("bigint").alias("chunks_count"),
                    F.aggregate("chunks", F.lit(0).cast("bigint"), lambda a, s: a + F.length(s)).alias("chunks_length"))


# ---------------------------------------------------------------------------
# knowledge-base rows
# ---------------------------------------------------------------------------

_AS_OF_MS = int(B.BuildParams().as_of.timestamp() * 1000)


@register("file_rows", f"""WITH {D.corpus_cte()},
{D.preprocess_ctes('corpus', 'filename', 'raw_text')}
SELECT ('0x' || substr(md5(filename), 1, 15))::BIGINT AS id, md5(filename) AS filename_md5, filename, '' AS summary,
       regexp_extract(filename, '^\\.*[^.].*\\.([^./]*)$', 1) AS type, CAST(length(text) AS BIGINT) AS text_length,
       md5({D.file_fp('filename', 'text')}) AS text_md5, CAST({_AS_OF_MS} AS BIGINT) AS create_ms,
       CAST({_AS_OF_MS} AS BIGINT) AS update_ms, md5(text) AS body_md5 FROM pre""")
def q_file_rows(spark, sf):
    f = knowledge(spark, sf).files()
    return f.select("id", "filename_md5", "filename", "summary", "type", F.col("text_length").cast("bigint"),
                    "text_md5", F.unix_millis("create_time").alias("create_ms"),
                    F.unix_millis("update_time").alias("update_ms"), F.md5("text").alias("body_md5"))


@register("chunk_rows", f"""WITH RECURSIVE {D.corpus_cte()},
{D.preprocess_ctes('corpus', 'filename', 'raw_text')},
{D.chunk_ctes('pre', 'filename', 'text', 400, 0, None)}
SELECT ('0x' || substr(md5(md5(filename) || '_' || CAST(chunk_no AS VARCHAR)), 1, 15))::BIGINT AS id,
       md5(filename) AS filename_md5, md5(filename) || '_' || CAST(chunk_no AS VARCHAR) AS filename_md5_no,
       CAST(chunk_no AS BIGINT) AS chunk_no, CAST(length(chunk) AS BIGINT) AS chunk_length, filename,
       md5({D.chunk_fp('filename', 'chunk_no', 'chunk')}) AS chunk_md5 FROM chunks""")
def q_chunk_rows(spark, sf):
    c = knowledge(spark, sf).chunks()
    return c.select("id", "filename_md5", "filename_md5_no", F.col("chunk_no").cast("bigint"),
                    F.col("chunk_length").cast("bigint"), "filename", "chunk_md5")


# ---------------------------------------------------------------------------
# embeddings and search
# ---------------------------------------------------------------------------

def _sparse_of(df: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """Non-zero components (key, bucket, w) of a dense vector column."""
    x = UN.explode_items(df, F.col(vec), "bucket", "w", key).filter(F.col("w") != 0)
    return x.select(key, F.col("bucket").cast("bigint"), _r6(F.col("w").cast("double")).alias("w"))


@register("file_embedding", f"""WITH {D.corpus_cte()},
{D.preprocess_ctes('corpus', 'filename', 'raw_text')},
fp AS (SELECT filename, {D.file_fp('filename', 'text')} AS full_text FROM pre),
{D.sparse_embedding_ctes('fp', 'filename', 'full_text', 512, 'fw')}
SELECT filename, CAST(bucket AS BIGINT) AS bucket, round(CAST(w AS DOUBLE), 6) AS w FROM fw""")
def q_file_embedding(spark, sf):
    return _sparse_of(knowledge(spark, sf).files(), "filename")


def _fw_ctes():
    return f"""{D.corpus_cte()},
{D.preprocess_ctes('corpus', 'filename', 'raw_text')},
fp AS (SELECT md5(filename) AS id, filename, {D.file_fp('filename', 'text')} AS full_text FROM pre),
{D.sparse_embedding_ctes('fp', 'id', 'full_text', 512, 'vw')},
qs AS (SELECT item_id AS query_id, text FROM benchmark),
{D.sparse_embedding_ctes('qs', 'query_id', 'text', 512, 'qw')}"""


def _cw_ctes():
    return f"""{D.corpus_cte()},
{D.preprocess_ctes('corpus', 'filename', 'raw_text')},
{D.chunk_ctes('pre', 'filename', 'text', 400, 0, None)},
cp AS (SELECT md5(filename) || '_' || CAST(chunk_no AS VARCHAR) AS id, filename, chunk_no,
              {D.chunk_fp('filename', 'chunk_no', 'chunk')} AS full_text, chunk FROM chunks),
{D.sparse_embedding_ctes('cp', 'id', 'full_text', 512, 'vw')},
qs AS (SELECT item_id AS query_id, text FROM benchmark),
{D.sparse_embedding_ctes('qs', 'query_id', 'text', 512, 'qw')}"""


@register("file_search_l2", f"""WITH {_fw_ctes()},
top AS ({D.sparse_topk_sql('qw', 'vw', SEARCH_K, 'L2', 'filename_md5')})
SELECT CAST(t.query_id AS BIGINT) AS query_id, CAST(t.rk AS BIGINT) AS rk, f.filename, t.distance
FROM top t JOIN fp f ON f.id = t.filename_md5""")
def q_file_search(spark, sf):
    qv = R.embed_queries(TB.queries_text(spark, sf))
    h = R.file_hits(knowledge(spark, sf).files(), qv, SEARCH_K)
    return h.select(F.col("query_id").cast("bigint"), F.col("rk").cast("bigint"), "filename",
                    _r6(F.col("distance")).alias("distance"))


@register("chunk_search_l2", f"""WITH RECURSIVE {_cw_ctes()},
top AS ({D.sparse_topk_sql('qw', 'vw', SEARCH_K, 'L2', 'filename_md5_no')})
SELECT CAST(t.query_id AS BIGINT) AS query_id, CAST(t.rk AS BIGINT) AS rk, c.filename, CAST(c.chunk_no AS BIGINT) AS chunk_no,
       t.distance, md5(c.chunk) AS chunk_md5
FROM top t JOIN cp c ON c.id = t.filename_md5_no""")
def q_chunk_search(spark, sf):
    return flagship(spark, sf)


def _transcript_sql(files: int, chunks: int) -> str:
    file_rows = f"""SELECT query_id, 1, '你可能感兴趣的文件', string_agg(f.filename, chr(10) ORDER BY rk)
  FROM ({D.sparse_topk_sql('qw', 'vw', files, 'L2', 'filename_md5')}) t JOIN fp f ON f.id = t.filename_md5 GROUP BY query_id""" if files else ""
    return f"""WITH RECURSIVE {_fw_ctes()},
{D.chunk_ctes('pre', 'filename', 'text', 400, 0, None)},
cp AS (SELECT md5(filename) || '_' || CAST(chunk_no AS VARCHAR) AS id, filename, chunk_no,
              {D.chunk_fp('filename', 'chunk_no', 'chunk')} AS full_text, chunk FROM chunks),
{D.sparse_embedding_ctes('cp', 'id', 'full_text', 512, 'kw')},
rows_ AS (
  SELECT query_id, 0 AS ord, text AS label, '' AS body FROM qs
  {'UNION ALL ' + file_rows if files else ''}
  UNION ALL
  SELECT t.query_id, t.rk + 1, '文件 ' || c.filename || ' 第' || CAST(c.chunk_no AS VARCHAR) || '部分', c.chunk
  FROM ({D.sparse_topk_sql('qw', 'kw', chunks, 'L2', 'filename_md5_no')}) t JOIN cp c ON c.id = t.filename_md5_no)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(ord AS BIGINT) AS ord,
       md5(CASE WHEN ord = 1 THEN label ELSE {_show_text_sql('label')} END) AS label_md5, md5({_show_text_sql('body')}) AS body_md5 FROM rows_"""


def _transcript_query(files: int, chunks: int):
    def q(spark, sf):
        kb, qs = knowledge(spark, sf), TB.queries_text(spark, sf)
        f, c = R.search_kbs(kb.files(), kb.chunks(), qs, files, chunks)
        t = R.transcript(qs, f, c)
        return t.select(F.col("query_id").cast("bigint"), F.col("ord").cast("bigint"), F.md5("label").alias("label_md5"),
                        F.md5("body").alias("body_md5"))
    return q


register("search_transcript", _transcript_sql(3, 2))(_transcript_query(3, 2))
register("search_transcript_no_files", _transcript_sql(0, 2))(_transcript_query(0, 2))


def _emb_queries(spark, sf):
    qs = TB.queries_text(spark, sf)
    return R.embed_queries(qs, HashingEmbedder(Q_DIM_EMB))


# Distances of a query (nq, bits bq) and a row (nv, bits bv): dp the product, it the shared positive components.
_DIST_SQL = {"L2": "nq + nv - 2 * dp", "IP": "dp", "COSINE": "CASE WHEN nq > 0 AND nv > 0 THEN 1 - dp / (sqrt(nq) * sqrt(nv)) END",
             "HAMMING": "bq + bv - 2.0 * it", "JACCARD": "CASE WHEN bq + bv - it = 0 THEN 0.0 ELSE 1 - it / (bq + bv - it) END",
             "TANIMOTO": "CASE WHEN bq + bv - it = 0 THEN 0.0 WHEN it > 0 THEN -log2(it / (bq + bv - it)) END"}


def _emb_sql(metric: str, k: int) -> str:
    order = "round(dist, 9) DESC" if metric == "IP" else "round(dist, 9) NULLS LAST"
    return f"""WITH qs AS (SELECT item_id AS query_id, text FROM benchmark),
{D.sparse_embedding_ctes('qs', 'query_id', 'text', Q_DIM_EMB, 'qw')},
v AS (SELECT vec_id AS id, CASE WHEN label = 3 THEN list_transform(embedding, lambda x: 0.0::FLOAT) ELSE embedding END AS embedding FROM embeddings),
nv AS (SELECT id, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS nv,
              CAST(len(list_filter(embedding, lambda x: x > 0)) AS DOUBLE) AS bv FROM v),
nq AS (SELECT query_id, sum(CAST(w AS DOUBLE) * CAST(w AS DOUBLE)) AS nq, CAST(count(*) FILTER (WHERE w > 0) AS DOUBLE) AS bq FROM qw GROUP BY query_id),
dp AS (SELECT q.query_id, v.id, sum(CAST(q.w AS DOUBLE) * CAST(v.embedding[q.bucket + 1] AS DOUBLE)) AS dp,
              CAST(count(*) FILTER (WHERE q.w > 0 AND v.embedding[q.bucket + 1] > 0) AS DOUBLE) AS it
       FROM qw q CROSS JOIN v GROUP BY ALL),
d AS (SELECT dp.query_id, dp.id, {_DIST_SQL[metric]} AS dist FROM dp JOIN nq USING (query_id) JOIN nv USING (id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, id) AS rk FROM d)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(id AS BIGINT) AS id, round(dist, 6) AS distance,
       CAST(rk AS BIGINT) AS rk FROM r WHERE rk <= {k}"""


def _with_zeros(spark, sf):
    """The vectors, those of label 3 as zero vectors: undefined distances rank last."""
    v = TB.vectors(spark, sf)
    return v.withColumn("embedding", F.when(F.col("label") == 3, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("embedding")))


def _emb_query(metric: str, k: int, budget: int = S.DEFAULT_BROADCAST_BUDGET):
    def q(spark, sf):
        top = S.exact_topk(_with_zeros(spark, sf), _emb_queries(spark, sf), k, metric, budget=budget)
        return top.select(F.col("query_id").cast("bigint"), F.col("id").cast("bigint"),
                          _r6(F.col("distance")).alias("distance"), F.col("rk").cast("bigint"))
    return q


for _m in ["L2", "IP", "COSINE", "HAMMING", "JACCARD", "TANIMOTO"]:
    register(f"vector_search_{_m.lower()}", _emb_sql(_m, VEC_K))(_emb_query(_m, VEC_K))
# every vector is a hit, so that undefined distances are among them
register("vector_search_undefined", _emb_sql("COSINE", 100_000))(_emb_query("COSINE", 100_000))
# the way for query sets beyond the broadcast budget
register("vector_search_streamed", _emb_sql("L2", VEC_K))(_emb_query("L2", VEC_K, 1))


def _pairs(spark, sf):
    v = TB.vectors(spark, sf)
    return v.alias("a").join(v.alias("b"), F.col("b.id") == F.col("a.id") + 1).select(
        F.col("a.id").alias("id"), F.col("a.embedding").alias("ea"), F.col("b.embedding").alias("eb"))


@register("vector_pair_metrics", """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.id, a.e AS ea, b.e AS eb FROM v a JOIN v b ON b.id = a.id + 1),
m AS (SELECT id,
  list_sum(list_transform(list_zip(ea, eb), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS l2sq,
  list_sum(list_transform(list_zip(ea, eb), lambda t: t[1] * t[2])) AS ip,
  list_sum(list_transform(ea, lambda x: x * x)) AS na, list_sum(list_transform(eb, lambda x: x * x)) AS nb,
  len(list_filter(list_zip(ea, eb), lambda t: (t[1] > 0) <> (t[2] > 0))) AS ham,
  len(list_filter(list_zip(ea, eb), lambda t: t[1] > 0 AND t[2] > 0)) AS inter,
  len(list_filter(list_zip(ea, eb), lambda t: t[1] > 0 OR t[2] > 0)) AS uni FROM p)
SELECT CAST(id AS BIGINT) AS id, round(sqrt(l2sq), 6) AS l2, round(l2sq, 6) AS l2_squared, round(ip, 6) AS ip,
  round(CASE WHEN na > 0 AND nb > 0 THEN 1 - ip / (sqrt(na) * sqrt(nb)) END, 6) AS cosine,
  CAST(ham AS BIGINT) AS hamming, round(CASE WHEN uni = 0 THEN 0 ELSE 1 - inter / uni END, 6) AS jaccard,
  round(CASE WHEN uni = 0 THEN 0 WHEN inter > 0 THEN -log2(inter / uni) END, 6) AS tanimoto FROM m""")
def q_vector_pair_metrics(spark, sf):
    p = _pairs(spark, sf)
    a, b = F.col("ea"), F.col("eb")
    return p.select(F.col("id").cast("bigint"), _r6(V.l2_distance(a, b)).alias("l2"),
                    _r6(V.l2_squared(a, b)).alias("l2_squared"), _r6(V.inner_product(a, b)).alias("ip"),
                    _r6(V.cosine_distance(a, b)).alias("cosine"), V.hamming_distance(a, b).alias("hamming"),
                    _r6(V.jaccard_distance(a, b)).alias("jaccard"), _r6(V.tanimoto_distance(a, b)).alias("tanimoto"))


@register("chunk_to_file_distance", f"""WITH RECURSIVE {D.corpus_cte()},
{D.preprocess_ctes('corpus', 'filename', 'raw_text')},
{D.chunk_ctes('pre', 'filename', 'text', 400, 0, None)},
fp AS (SELECT filename, {D.file_fp('filename', 'text')} AS full_text FROM pre),
cp AS (SELECT filename, chunk_no, {D.chunk_fp('filename', 'chunk_no', 'chunk')} AS full_text FROM chunks),
{D.sparse_embedding_ctes('fp', 'filename', 'full_text', 512, 'fw')},
cpk AS (SELECT filename || '#' || CAST(chunk_no AS VARCHAR) AS ck, filename, chunk_no, full_text FROM cp),
{D.sparse_embedding_ctes('cpk', 'ck', 'full_text', 512, 'cw')},
nf AS (SELECT filename, sum(CAST(w AS DOUBLE) * CAST(w AS DOUBLE)) AS nf FROM fw GROUP BY filename),
nc AS (SELECT ck, sum(CAST(w AS DOUBLE) * CAST(w AS DOUBLE)) AS nc FROM cw GROUP BY ck),
dp AS (SELECT c.ck, sum(CAST(c.w AS DOUBLE) * CAST(f.w AS DOUBLE)) AS dp
       FROM cw c JOIN cpk k ON k.ck = c.ck JOIN fw f ON f.filename = k.filename AND f.bucket = c.bucket GROUP BY c.ck)
SELECT k.filename, CAST(k.chunk_no AS BIGINT) AS chunk_no,
       round(sqrt(greatest(nc + nf - 2 * coalesce(dp, 0), 0)), 6) AS l2,
       round(1 - coalesce(dp, 0) / (sqrt(nc) * sqrt(nf)), 6) AS cosine
FROM cpk k JOIN nc USING (ck) JOIN nf USING (filename) LEFT JOIN dp USING (ck)""")
def q_chunk_to_file_distance(spark, sf):
    kb = knowledge(spark, sf)
    f = kb.files().select("filename", F.col("embedding").alias("fe"))
    c = kb.chunks().select("filename", "chunk_no", F.col("embedding").alias("ce"))
    j = c.join(f, "filename")
    return j.select("filename", F.col("chunk_no").cast("bigint"), _r6(V.l2_distance("ce", "fe")).alias("l2"),
                    _r6(V.cosine_distance("ce", "fe")).alias("cosine"))


# ---------------------------------------------------------------------------
# incremental sync
# ---------------------------------------------------------------------------

import datetime as _dt  # noqa: E402

from textvault.plans import sync as SY  # noqa: E402

_OLD_P = B.BuildParams()
_NEW_P = SY.with_as_of(B.BuildParams(), _dt.datetime(2024, 2, 1, tzinfo=_dt.timezone.utc))
_NEW_MS = int(_NEW_P.as_of.timestamp() * 1000)


def _snapshots(spark, sf):
    old, new = TB.snapshots(spark, sf)
    return B.preprocess(old), B.preprocess(new)


def _old_kb(spark, sf) -> B.Knowledge:
    """The knowledge base as it was stored before the sync."""
    return built(spark, sf, "old-knowledge", lambda path: B.Knowledge.build(_snapshots(spark, sf)[0], path, _OLD_P))


def _sync(spark, sf, params=_NEW_P, rechunk=False):
    old = _old_kb(spark, sf)
    return SY.apply(old.files().drop("embedding"), old.chunks().drop("embedding"), _snapshots(spark, sf)[1], params, False, rechunk)


_SNAP_SQL = """docs AS (SELECT doc_id, concat(source, '_', CAST(doc_id AS VARCHAR), '.txt') AS filename, text FROM documents),
old_src AS (SELECT d.filename, CASE WHEN l.quality = 0 THEN d.text || ' old' ELSE d.text END AS raw_text
            FROM docs d JOIN labels l USING (doc_id)),
new_src AS (SELECT filename, text AS raw_text FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"""


def _sync_status_ctes():
    return f"""{_SNAP_SQL},
{D.preprocess_ctes('old_src', 'filename', 'raw_text', 'oldp')},
{D.preprocess_ctes('new_src', 'filename', 'raw_text', 'newp')},
oldm AS (SELECT filename, md5({D.file_fp('filename', 'text')}) AS old_md5 FROM oldp),
newm AS (SELECT filename, md5({D.file_fp('filename', 'text')}) AS new_md5, CAST(length(text) AS BIGINT) AS text_length FROM newp),
st AS (SELECT coalesce(o.filename, n.filename) AS filename, o.old_md5, n.new_md5, n.text_length,
              CASE WHEN n.new_md5 IS NULL THEN 'deleted' WHEN n.new_md5 = coalesce(o.old_md5, '') THEN 'unchanged'
                   WHEN o.old_md5 IS NULL THEN 'new' ELSE 'changed' END AS status
       FROM oldm o FULL OUTER JOIN newm n ON o.filename = n.filename)"""


@register("sync_status", f"""WITH {_sync_status_ctes()}
SELECT filename, status, CASE status WHEN 'deleted' THEN '已删除' WHEN 'unchanged' THEN '无改动'
       ELSE '字符数=' || CAST(text_length AS VARCHAR) END AS label, text_length FROM st""")
def q_sync_status(spark, sf):
    st = SY.diff(SY.manifest(_old_kb(spark, sf).files()), SY.fingerprints(_snapshots(spark, sf)[1]))
    return st.select("filename", "status", "label", "text_length")


@register("sync_counts", f"""WITH {_sync_status_ctes()}
SELECT CAST(count(new_md5) AS BIGINT) AS n_disk, CAST(count(old_md5) AS BIGINT) AS n_stored,
       CAST(count(*) AS BIGINT) AS n_compared,
       CAST(count(*) FILTER (WHERE status = 'new') AS BIGINT) AS n_new,
       CAST(count(*) FILTER (WHERE status = 'changed') AS BIGINT) AS n_changed,
       CAST(count(*) FILTER (WHERE status = 'deleted') AS BIGINT) AS n_deleted,
       CAST(count(*) FILTER (WHERE status = 'unchanged') AS BIGINT) AS n_unchanged FROM st""")
def q_sync_counts(spark, sf):
    st = SY.diff(SY.manifest(_old_kb(spark, sf).files()), SY.fingerprints(_snapshots(spark, sf)[1]))
    return SY.counts(st)


@register("name_set_ops", f"""WITH {_SNAP_SQL},
o AS (SELECT filename FROM old_src), n AS (SELECT filename FROM new_src)
SELECT filename, 'deleted' AS kind FROM (SELECT filename FROM o EXCEPT SELECT filename FROM n)
UNION ALL SELECT filename, 'added' FROM (SELECT filename FROM n EXCEPT SELECT filename FROM o)
UNION ALL SELECT filename, 'kept' FROM (SELECT filename FROM o INTERSECT SELECT filename FROM n)
UNION ALL SELECT filename, 'any' FROM (SELECT filename FROM o UNION SELECT filename FROM n)""")
def q_name_set_ops(spark, sf):
    old, new = TB.snapshots(spark, sf)
    return SY.name_sets(old, new)


@register("sync_files_after", f"""WITH {_sync_status_ctes()}
SELECT md5(o.filename) AS filename_md5, o.filename, o.old_md5 AS text_md5, CAST({_AS_OF_MS} AS BIGINT) AS create_ms,
       CAST({_AS_OF_MS} AS BIGINT) AS update_ms
FROM oldm o JOIN st USING (filename) WHERE st.status = 'unchanged'
UNION ALL
SELECT md5(filename), filename, new_md5, CAST(CASE WHEN status = 'changed' THEN {_AS_OF_MS} ELSE {_NEW_MS} END AS BIGINT),
       CAST({_NEW_MS} AS BIGINT) FROM st WHERE status IN ('new', 'changed')""")
def q_sync_files_after(spark, sf):
    _, fa, _ = _sync(spark, sf)
    return fa.select("filename_md5", "filename", "text_md5", F.unix_millis("create_time").alias("create_ms"),
                     F.unix_millis("update_time").alias("update_ms"))


@register("sync_chunks_after", f"""WITH RECURSIVE {_sync_status_ctes()},
{D.chunk_ctes('oldp', 'filename', 'text', 400, 0, None, 'oc')},
{D.chunk_ctes('newp', 'filename', 'text', 400, 0, None, 'nc')}
SELECT md5(c.filename) || '_' || CAST(c.chunk_no AS VARCHAR) AS filename_md5_no,
       md5({D.chunk_fp('c.filename', 'c.chunk_no', 'c.chunk')}) AS chunk_md5, CAST({_AS_OF_MS} AS BIGINT) AS update_ms
FROM oc c JOIN st USING (filename) WHERE st.status = 'unchanged'
UNION ALL
SELECT md5(c.filename) || '_' || CAST(c.chunk_no AS VARCHAR), md5({D.chunk_fp('c.filename', 'c.chunk_no', 'c.chunk')}),
       CAST({_NEW_MS} AS BIGINT)
FROM nc c JOIN st USING (filename) WHERE st.status IN ('new', 'changed')""")
def q_sync_chunks_after(spark, sf):
    _, _, ca = _sync(spark, sf)
    return ca.select("filename_md5_no", "chunk_md5", F.unix_millis("update_time").alias("update_ms"))


_SMALL_P = SY.with_as_of(B.BuildParams(chunk_size=60), _dt.datetime(2024, 2, 1, tzinfo=_dt.timezone.utc))


@register("sync_rechunked", f"""WITH RECURSIVE {_sync_status_ctes()},
{D.chunk_ctes('newp', 'filename', 'text', 60, 0, None, 'nc')}
SELECT md5(c.filename) || '_' || CAST(c.chunk_no AS VARCHAR) AS filename_md5_no,
       md5({D.chunk_fp('c.filename', 'c.chunk_no', 'c.chunk')}) AS chunk_md5 FROM nc c""")
def q_sync_rechunked(spark, sf):
    _, _, ca = _sync(spark, sf, _SMALL_P, rechunk=True)
    return ca.select("filename_md5_no", "chunk_md5")


@register("file_lookup", f"""WITH {D.corpus_cte()},
{D.preprocess_ctes('corpus', 'filename', 'raw_text')}
SELECT filename, md5({D.file_fp('filename', 'text')}) AS text_md5 FROM pre WHERE filename = (SELECT max(filename) FROM pre)""")
def q_file_lookup(spark, sf):
    files = knowledge(spark, sf).files()
    key = files.agg(F.md5(F.max("filename")).alias("k")).first()["k"]
    return ST.lookup(files, key).select("filename", "text_md5")


@register("delete_cascade", f"""WITH RECURSIVE {_sync_status_ctes()},
{D.chunk_ctes('oldp', 'filename', 'text', 400, 0, None, 'oc')},
gone AS (SELECT filename FROM st WHERE status = 'deleted')
SELECT 'files' AS part, md5(filename) AS key FROM oldp WHERE filename NOT IN (FROM gone)
UNION ALL SELECT 'file_vectors', md5(filename) FROM oldp WHERE filename NOT IN (FROM gone)
UNION ALL SELECT 'chunks', md5(filename) || '_' || CAST(chunk_no AS VARCHAR) FROM oc WHERE filename NOT IN (FROM gone)
UNION ALL SELECT 'chunk_vectors', md5(filename) || '_' || CAST(chunk_no AS VARCHAR) FROM oc WHERE filename NOT IN (FROM gone)""")
def q_delete_cascade(spark, sf):
    kb = _old_kb(spark, sf)
    f, c = kb.files(), kb.chunks()
    st = SY.written_status(f, _snapshots(spark, sf)[1])
    gone = st.filter(F.col("status") == "deleted").select(F.md5("filename").alias(ST.FILE_KEY))
    f2, c2, fv, cv = ST.delete_all_by_filename_md5(f, c, B.file_vectors(f), B.chunk_vectors(c), gone)
    k = lambda df, part, key: df.select(F.lit(part).alias("part"), F.col(key).alias("key"))
    return (k(f2, "files", ST.FILE_KEY).unionByName(k(fv, "file_vectors", ST.FILE_KEY))
            .unionByName(k(c2, "chunks", ST.CHUNK_KEY)).unionByName(k(cv, "chunk_vectors", ST.CHUNK_KEY)))


# ---------------------------------------------------------------------------
# sources (S4-S7, S12) and rendering
# ---------------------------------------------------------------------------

@register("html_text", f"""SELECT concat('page_', CAST(page_id AS VARCHAR), '.html') AS filename,
  CAST(length({D.html_text('html')}) AS BIGINT) AS text_length, md5({D.html_text('html')}) AS text_md5 FROM pages""")
def q_html_text(spark, sf):
    p = TB.corpus_html(spark, sf)
    t = FS.html_to_text(F.col("html"))
    return p.select("filename", F.length(t).cast("bigint").alias("text_length"), F.md5(t).alias("text_md5"))


_HARD_HTML = ("<p title=\"a>b\" class='c>d'>caf&eacute; &amp;lt; &#233;&#xE9;&#X1F600; &nbsp;&unknown; &#0; &copy 1</p>"
              "<!-- x > y --><script>if (a > b) {}</script>")


@register("html_text_hard", f"""WITH p AS (SELECT page_id, {D.lit(_HARD_HTML)} || html || '&#8217;' AS h FROM pages)
SELECT CAST(page_id AS BIGINT) AS page_id, md5({D.html_text('h')}) AS text_md5, left({D.html_text('h')}, 30) AS head FROM p""")
def q_html_text_hard(spark, sf):
    p = TB.table(spark, sf, "pages")
    t = p.select("page_id", FS.html_to_text(F.concat(F.lit(_HARD_HTML), "html", F.lit("&#8217;"))).alias("t"))
    return t.select(F.col("page_id").cast("bigint"), F.md5("t").alias("text_md5"), F.substring("t", 1, 30).alias("head"))


@register("pdf_text", """SELECT concat('conv_', CAST(conv_id AS VARCHAR), '.pdf') AS filename,
  md5(string_agg(text, chr(10) ORDER BY turn)) AS text_md5, CAST(count(*) AS BIGINT) AS pages
FROM conversations GROUP BY conv_id""")
def q_pdf_text(spark, sf):
    pages = TB.corpus_pages(spark, sf)
    t = FS.pages_to_text(pages)
    n = pages.groupBy("filename").agg(F.count(F.lit(1)).cast("bigint").alias("pages"))
    return t.join(n, "filename").select("filename", F.md5("text").alias("text_md5"), "pages")


@register("read_documents", f"""WITH src AS (
  SELECT concat(source, '_', CAST(doc_id AS VARCHAR), '.txt') AS filename, text AS raw FROM documents
  UNION ALL SELECT concat('page_', CAST(page_id AS VARCHAR), '.html'), {D.html_text('html')} FROM pages
  UNION ALL SELECT concat('conv_', CAST(conv_id AS VARCHAR), '.pdf'), string_agg(text, chr(10) ORDER BY turn)
            FROM conversations GROUP BY conv_id),
{D.preprocess_ctes('src', 'filename', 'raw')}
SELECT filename, regexp_extract(filename, '\\.([^./]*)$', 1) AS type, CAST(length(text) AS BIGINT) AS text_length,
       md5(text) AS text_md5 FROM pre""")
def q_read_documents(spark, sf):
    txt = TB.corpus(spark, sf).select("filename", F.lit("txt").alias("ext"), F.col("raw_text").alias("body"))
    html = TB.corpus_html(spark, sf).select("filename", F.lit("html").alias("ext"), F.col("html").alias("body"))
    pdf = FS.pages_to_text(TB.corpus_pages(spark, sf)).select("filename", F.lit("pdf").alias("ext"),
                                                               F.col("text").alias("body"))
    u = txt.unionByName(html).unionByName(pdf)
    t = FS.read_text(F.col("ext"), F.col("body"))
    return u.select("filename", TX.extension(F.col("filename")).alias("type"),
                    F.length(t).cast("bigint").alias("text_length"), F.md5(t).alias("text_md5"))


@register("allowed_uploads", """WITH n AS (
  SELECT concat(source, '_', CAST(doc_id AS VARCHAR), '.txt') AS filename FROM documents
  UNION ALL SELECT concat('page_', CAST(page_id AS VARCHAR), '.html') FROM pages
  UNION ALL SELECT url FROM pages)
SELECT regexp_extract(filename, '^\\.*[^.].*\\.([^./]*)$', 1) AS ext, CAST(count(*) AS BIGINT) AS n
FROM n WHERE regexp_extract(filename, '^\\.*[^.].*\\.([^./]*)$', 1) IN ('pdf', 'txt', 'md', 'py', 'html', 'js', 'java', 'h', 'cpp', 'c', 'hpp', 'json', 'toml', 'ipynb', 'yml', 'rst') GROUP BY 1""")
def q_allowed_uploads(spark, sf):
    d = TB.corpus(spark, sf).select("filename")
    p = TB.corpus_html(spark, sf).select("filename")
    u = TB.table(spark, sf, "pages").select(F.col("url").alias("filename"))
    names = d.unionByName(p).unionByName(u)
    return (names.filter(FS.allowed_upload(F.col("filename")))
            .groupBy(TX.extension(F.col("filename")).alias("ext")).agg(F.count(F.lit(1)).cast("bigint").alias("n")))


@register("sql_statements", """WITH p AS (SELECT conv_id, turn, unnest(string_split(text, ';')) AS stmt,
                                 generate_subscripts(string_split(text, ';'), 1) - 1 AS pos FROM conversations)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, CAST(pos AS BIGINT) AS stmt_no,
       trim(stmt, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS stmt FROM p
WHERE trim(stmt, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''""")
def q_sql_statements(spark, sf):
    st = FS.sql_statements(TB.table(spark, sf, "conversations").select("conv_id", "turn", "text"), "text")
    return st.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "stmt_no", "stmt")


@register("read_and_render", f"""WITH src AS (
  SELECT concat(source, '_', CAST(doc_id AS VARCHAR), '.txt') AS filename, text AS raw FROM documents
  UNION ALL SELECT concat('page_', CAST(page_id AS VARCHAR), '.html'), {D.html_text('html')} FROM pages),
{D.preprocess_ctes('src', 'filename', 'raw')}
SELECT filename, md5({_show_text_sql('text')}) AS html_md5 FROM pre""")
def q_read_and_render(spark, sf):
    txt = TB.corpus(spark, sf).select(F.concat(F.lit("/in/"), "filename").alias("path"), F.col("raw_text").alias("body"))
    html = TB.corpus_html(spark, sf).select(F.concat(F.lit("/in/sub/"), "filename").alias("path"), F.col("html").alias("body"))
    r = FS.read_and_render(txt.unionByName(html))
    return r.select("filename", F.md5("html").alias("html_md5"))


@register("occurrences", """WITH p AS (SELECT doc_id, text, string_split(text, 'the') AS ps FROM documents),
o AS (SELECT doc_id, i - 1 AS n, list_sum(list_transform(ps[1:i], lambda x: length(x))) + 3 * (i - 1) AS place
      FROM (SELECT doc_id, ps, unnest(range(1, len(ps))) AS i FROM p))
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(n AS BIGINT) AS n, CAST(place AS BIGINT) AS place FROM o""")
def q_occurrences(spark, sf):
    o = PO.occurrence_rows(TB.table(spark, sf, "documents"), "doc_id", "text", "the")
    return o.select(F.col("doc_id").cast("bigint"), F.col("n").cast("bigint"), F.col("place").cast("bigint"))


@register("first_and_last_place", """SELECT CAST(doc_id AS BIGINT) AS doc_id,
  CAST(CASE WHEN instr(substr(text, 101), 'the') > 0 THEN instr(substr(text, 101), 'the') + 99 ELSE -1 END AS BIGINT) AS first_from_100,
  CAST(CASE WHEN instr(reverse(left(text, 1000)), 'eht') > 0 THEN length(left(text, 1000)) - instr(reverse(left(text, 1000)), 'eht') + 1 - 3
       ELSE -1 END AS BIGINT) AS last_before_1000 FROM documents""")
def q_first_and_last_place(spark, sf):
    t = F.col("text")
    return TB.table(spark, sf, "documents").select(
        F.col("doc_id").cast("bigint"), TX.find_from(t, "the", 100).cast("bigint").alias("first_from_100"),
        TX.find_before(t, "the", 1000).cast("bigint").alias("last_before_1000"))


@register("written_times", """WITH l AS (SELECT conv_id, list(length(text) ORDER BY turn) AS ls FROM conversations GROUP BY conv_id),
g AS (SELECT conv_id, 'as is' AS kind, ls FROM l
      UNION ALL SELECT conv_id, 'thrice', flatten([ls[1:3], ls[1:3], ls[1:3]]) FROM l
      UNION ALL SELECT conv_id, 'broken', list_append(flatten([ls[1:2]]), 0) || [ls[1]] FROM l),
t AS (SELECT *, CASE len(ls) WHEN 4 THEN 2 WHEN 9 THEN 3 WHEN 16 THEN 4 WHEN 25 THEN 5 WHEN 36 THEN 6 WHEN 49 THEN 7
                WHEN 64 THEN 8 WHEN 81 THEN 9 WHEN 100 THEN 10 ELSE 0 END AS n FROM g)
SELECT CAST(conv_id AS BIGINT) AS conv_id, kind,
       CAST(CASE WHEN n > 0 AND len(list_filter(range(n + 1, len(ls) + 1), lambda j: ls[j] <> ls[j - n])) = 0 THEN n ELSE 0 END AS BIGINT) AS times
FROM t""")
def q_written_times(spark, sf):
    c = TB.table(spark, sf, "conversations")
    ls = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda x: x["n"]).alias("ls"))
    three = F.slice("ls", 1, 3)
    kinds = F.array(F.struct(F.lit("as is").alias("kind"), F.col("ls").alias("s")),
                    F.struct(F.lit("thrice").alias("kind"), F.concat(three, three, three).alias("s")),
                    F.struct(F.lit("broken").alias("kind"), F.concat(F.slice("ls", 1, 2), F.array(F.lit(0), F.col("ls")[0])).alias("s")))
    x = ls.select("conv_id", F.explode(kinds).alias("g"))
    return x.select(F.col("conv_id").cast("bigint"), "g.kind", PO.written_times(F.col("g.s")).cast("bigint").alias("times"))


@register("distance_report", """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.id, list_zip(a.e, b.e) AS z, a.e AS ea, b.e AS eb FROM v a JOIN v b ON b.id = a.id + 1)
SELECT CAST(id AS BIGINT) AS id, 'L2距离: ' || printf('%.4f', sqrt(list_sum(list_transform(z, lambda t: (t[1] - t[2]) * (t[1] - t[2]))))) || chr(10) ||
  '余弦距离: ' || printf('%.4f', 1 - list_sum(list_transform(z, lambda t: t[1] * t[2])) / (sqrt(list_sum(list_transform(ea, lambda x: x * x))) *
  sqrt(list_sum(list_transform(eb, lambda x: x * x))))) AS report FROM p""")
def q_distance_report(spark, sf):
    return _pairs(spark, sf).select(F.col("id").cast("bigint"), V.distance_report(F.col("ea"), F.col("eb")).alias("report"))


def _fenced_sql():
    return ("f AS (SELECT conv_id, turn, 'intro' || chr(10) || '```py' || chr(10) || text || chr(10) || '```' || chr(10) "
            "|| 'end' AS text FROM conversations)")


@register("show_text_fenced", f"""WITH {_fenced_sql()}
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, md5(h) AS html_md5, CAST(length(h) AS BIGINT) AS html_length
FROM (SELECT conv_id, turn, {_show_text_sql('text')} AS h FROM f)""")
def q_show_text_fenced(spark, sf):
    f = TB.fenced(spark, sf)
    h = TX.show_text(F.col("text"))
    return f.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.md5(h).alias("html_md5"),
                    F.length(h).cast("bigint").alias("html_length"))


@register("fence_depth", f"""WITH {_fenced_sql()},
l AS (SELECT conv_id, turn, unnest(ls) AS l, generate_subscripts(ls, 1) AS i
      FROM (SELECT conv_id, turn, list_filter(string_split(text, chr(10)), lambda s: s <> '') AS ls FROM f)),
n AS (SELECT conv_id, turn, l, sum(CASE WHEN contains(l, '```') THEN 1 ELSE 0 END)
        OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM l)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn,
       CAST(count(*) FILTER (WHERE n % 2 = 1 AND NOT contains(l, '```')) AS BIGINT) AS lines_inside,
       CAST(max(n) AS BIGINT) AS fences FROM n GROUP BY conv_id, turn""")
def q_fence_depth(spark, sf):
    f = TB.fenced(spark, sf)
    lines = F.filter(F.split("text", "\n", -1), lambda s: s != "")
    depth = TX.fence_depth(F.col("text"))
    z = F.zip_with(lines, depth, lambda l, n: (n % 2 == 1) & ~l.contains(TX.FENCE))
    return f.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"),
                    F.size(F.filter(z, lambda b: b)).cast("bigint").alias("lines_inside"),
                    F.array_max(depth).cast("bigint").alias("fences"))


# ---------------------------------------------------------------------------
# outline (W7, W9, S18)
# ---------------------------------------------------------------------------

from textvault.operators import outline as OL  # noqa: E402

_LEVELED_SQL = ("e AS (SELECT conv_id AS doc, turn AS idx, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END "
                "AS level, text FROM conversations)")


@register("outline_links", f"""WITH {_LEVELED_SQL},
p AS (SELECT a.doc, a.idx, a.level, (SELECT max(b.idx) FROM e b WHERE b.doc = a.doc AND b.idx < a.idx AND b.level < a.level) AS parent FROM e a),
s AS (SELECT *, lag(idx) OVER (PARTITION BY doc, parent ORDER BY idx) AS prev, lead(idx) OVER (PARTITION BY doc, parent ORDER BY idx) AS next FROM p),
k AS (SELECT doc, parent AS idx, min(idx) AS first_child, max(idx) AS last_child FROM p WHERE parent IS NOT NULL GROUP BY doc, parent)
SELECT CAST(s.doc AS BIGINT) AS doc, CAST(s.idx AS BIGINT) AS idx, CAST(s.level AS BIGINT) AS level, CAST(parent AS BIGINT) AS parent,
       CAST(prev AS BIGINT) AS prev, CAST(next AS BIGINT) AS next, CAST(first_child AS BIGINT) AS first_child,
       CAST(last_child AS BIGINT) AS last_child FROM s LEFT JOIN k USING (doc, idx)""")
def q_outline_links(spark, sf):
    e = TB.leveled(spark, sf)
    x = OL.outline_links(e)
    return x.select(*[F.col(c).cast("bigint").alias(c) for c in
                      ["doc", "idx", "level", "parent", "prev", "next", "first_child", "last_child"]])


@register("toc_lines", f"""WITH {_LEVELED_SQL}
SELECT CAST(doc AS BIGINT) AS doc, CAST(idx AS BIGINT) AS idx, CAST(idx - 1 AS BIGINT) AS page0,
       md5(repeat('    ', CAST(level - 1 AS BIGINT)) || text || '    ' || CAST(idx AS VARCHAR)) AS line_md5 FROM e""")
def q_toc_lines(spark, sf):
    e = TB.leveled(spark, sf).withColumn("page", F.col("idx"))
    return e.select(F.col("doc").cast("bigint"), F.col("idx").cast("bigint"), (F.col("idx") - 1).cast("bigint").alias("page0"),
                    F.md5(OL.toc_line()).alias("line_md5"))


# ---------------------------------------------------------------------------
# reading (R3-R10) with the deterministic reader
# ---------------------------------------------------------------------------

from textvault.plans import reading as RD  # noqa: E402

QUESTION = "What does this text say?"
READ_REPEAT = 2


def _rd(x: str) -> str:
    """SQL of the default reader on a prompt/last-answer pair."""
    return f"('R' || substr(md5({x}), 1, 16))"


def _chunked_docs(spark, sf):
    return UN.with_chunks(docs_clean(spark, sf), "text", "chunks", 400, 0, None).select("filename", "chunks")


def _read_text_ctes():
    return f"""{D.corpus_cte()},
{D.preprocess_ctes('corpus', 'filename', 'raw_text')},
{D.chunk_ctes('pre', 'filename', 'text', 400, 0, None)},
cl AS (SELECT p.filename, coalesce(list(c.chunk ORDER BY c.chunk_no) FILTER (WHERE c.chunk IS NOT NULL), []) AS cs
       FROM pre p LEFT JOIN chunks c USING (filename) GROUP BY p.filename)"""


_STEP_SQL = ("'当前上下文:' || chr(10) || f.m || chr(10) || '---' || chr(10) || '新的上下文片段:' || chr(10) || "
             "s.ss[f.t + 1] || chr(10) || '---' || chr(10) || '根据用户关心的问题\"' || {q} || '\"，结合新的上下文片段，生成新的上下文：'")


@register("reading_recursive_text", f"""WITH RECURSIVE {_read_text_ctes()},
seq AS (SELECT filename, flatten([cs for r in range({READ_REPEAT})]) AS ss FROM cl),
fold(filename, t, m) AS (
  SELECT filename, 0, '' FROM seq WHERE len(ss) > 1
  UNION ALL
  SELECT f.filename, f.t + 1, {_rd(_STEP_SQL.format(q=D.lit(QUESTION)) + " || '|'")}
  FROM fold f JOIN seq s USING (filename) WHERE f.t < len(s.ss)),
mem AS (SELECT s.filename, len(s.ss) AS n_steps,
          CASE WHEN len(s.ss) > 1 THEN f.m WHEN len(s.ss) = 1 THEN s.ss[1] ELSE '' END AS memory
        FROM seq s LEFT JOIN fold f ON f.filename = s.filename AND f.t = len(s.ss))
SELECT filename, CAST(n_steps AS BIGINT) AS n_steps, md5(memory) AS memory_md5,
       {_rd("'上下文: ' || memory || chr(10) || '---' || chr(10) || " + D.lit(QUESTION) + " || '|'")} AS answer FROM mem""")
def q_reading_recursive_text(spark, sf):
    d = RD.recursive_read(_chunked_docs(spark, sf), "chunks", F.lit(QUESTION), READ_REPEAT)
    return d.select("filename", (F.size("chunks") * READ_REPEAT).cast("bigint").alias("n_steps"),
                    F.md5("memory").alias("memory_md5"), "answer")


def _each_sql(chunk: str, refine: bool) -> str:
    mid = f"'{RD.EACH_REFINE}' || " if refine else ""
    return f"'上下文片段:' || chr(10) || {chunk} || chr(10) || '---' || chr(10) || {mid}{D.lit(QUESTION)}"


@register("reading_foreach_text", f"""WITH RECURSIVE {_read_text_ctes()},
a1 AS (SELECT filename, chunk_no, chunk, {_rd(_each_sql('chunk', False) + " || '|'")} AS a FROM chunks),
a2 AS (SELECT filename, chunk_no, {_rd(_each_sql('chunk', True) + " || '|' || a")} AS a FROM a1)
SELECT cl.filename, CAST(len(cl.cs) AS BIGINT) AS n_chunks,
       md5(coalesce((SELECT string_agg(a, chr(10) || chr(10) ORDER BY chunk_no) FROM a2 WHERE a2.filename = cl.filename), '')) AS answers_md5
FROM cl""")
def q_reading_foreach_text(spark, sf):
    d = RD.foreach_read_text(_chunked_docs(spark, sf), F.lit(QUESTION), READ_REPEAT)
    return d.select("filename", "n_chunks", F.md5("answers").alias("answers_md5"))


def _turn_docs(spark, sf):
    c = TB.table(spark, sf, "conversations")
    fn = F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit("_turn_"), F.col("turn").cast("string"), F.lit(".txt"))
    t = c.select("conv_id", "turn", fn.alias("filename"), TX.text_preprocess(F.col("text")).alias("text"))
    return UN.with_chunks(t, "text", "chunks", 400, 0).select("conv_id", "turn", "filename", "chunks")


def _turn_chunks_ctes():
    return f"""src AS (SELECT conv_id, turn, 'conv_' || CAST(conv_id AS VARCHAR) || '_turn_' || CAST(turn AS VARCHAR) || '.txt' AS filename,
                text FROM conversations),
{D.preprocess_ctes('src', 'filename', 'text')},
{D.chunk_ctes('pre', 'filename', 'text', 400, 0, None)},
items AS (SELECT s.conv_id, row_number() OVER (PARTITION BY s.conv_id ORDER BY s.turn, c.chunk_no) AS pos, c.filename, c.chunk_no, c.chunk
          FROM chunks c JOIN src s USING (filename))"""


_STEP_FILE_SQL = ("'当前上下文:' || chr(10) || f.m || chr(10) || '---' || chr(10) || '新的上下文片段:' || chr(10) || "
                  "'文件名=' || i.filename || ' 片段序号=' || CAST(i.chunk_no AS VARCHAR) || chr(10) || "
                  "i.chunk || chr(10) || '---' || chr(10) || '根据用户关心的问题\"' || {q} || '\"，结合新的上下文片段，生成新的上下文：'")


@register("reading_recursive_files", f"""WITH RECURSIVE {_turn_chunks_ctes()},
reqs AS (SELECT DISTINCT conv_id FROM conversations),
fold(conv_id, t, m) AS (
  SELECT conv_id, 0, '' FROM reqs
  UNION ALL
  SELECT f.conv_id, f.t + 1, {_rd(_STEP_FILE_SQL.format(q=D.lit(QUESTION)) + " || '|'")}
  FROM fold f JOIN items i ON i.conv_id = f.conv_id AND i.pos = f.t + 1),
mem AS (SELECT conv_id, arg_max(m, t) AS memory, max(t) AS n_steps FROM fold GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(n_steps AS BIGINT) AS n_steps, md5(memory) AS memory_md5,
       {_rd("'上下文: ' || memory || chr(10) || '---' || chr(10) || " + D.lit(QUESTION) + " || '|'")} AS answer FROM mem""")
def q_reading_recursive_files(spark, sf):
    docs = _turn_docs(spark, sf)
    req = RD.chunk_list(docs, "conv_id", "turn")
    allreq = TB.table(spark, sf, "conversations").select("conv_id").distinct()
    x = allreq.join(req, "conv_id", "left").withColumn(
        "items", F.coalesce("items", F.array().cast("array<struct<filename:string,chunk_no:int,chunk:string>>")))
    r = RD.recursive_read(x, "items", F.lit(QUESTION), 1, files=True)
    return r.select(F.col("conv_id").cast("bigint"), F.size("items").cast("bigint").alias("n_steps"),
                    F.md5("memory").alias("memory_md5"), "answer")


def _turn_chunks(spark, sf):
    return UN.explode_items(_turn_docs(spark, sf), F.col("chunks"), "chunk_no", "chunk", "conv_id", "turn", "filename")


@register("reading_recursive_python", ORACLE["reading_recursive_files"] + " WHERE n_steps > 0")
def q_reading_recursive_python(spark, sf):
    r = RD.read_in_order(_turn_chunks(spark, sf), "conv_id", "turn", QUESTION, RD.hash_chat, 1, True, {"max_length": 3000, "top_p": 0.7})
    return r.select(F.col("conv_id").cast("bigint"), "n_steps", F.md5("memory").alias("memory_md5"), "answer")


# one round over documents: a lone chunk is the memory itself
_ONE_ROUND_SQL = ORACLE["reading_recursive_text"].replace(f"r in range({READ_REPEAT})", "r in range(1)") + " WHERE n_steps > 0"


@register("reading_lone_chunk", _ONE_ROUND_SQL)
def q_reading_lone_chunk(spark, sf):
    d = RD.recursive_read(UN.keep_rows(_chunked_docs(spark, sf), F.size("chunks") > 0), "chunks", F.lit(QUESTION), 1)
    return d.select("filename", F.size("chunks").cast("bigint").alias("n_steps"), F.md5("memory").alias("memory_md5"), "answer")


@register("reading_text_python", _ONE_ROUND_SQL)
def q_reading_text_python(spark, sf):
    c = UN.explode_items(_chunked_docs(spark, sf), F.col("chunks"), "chunk_no", "chunk", "filename")
    c = c.withColumn("request", F.col("filename")).withColumn("place", F.lit(0))
    r = RD.read_in_order(c, "request", "place", QUESTION, files=False)
    return r.select(F.col("request").alias("filename"), "n_steps", F.md5("memory").alias("memory_md5"), "answer")


def _each_file_sql(refine: bool) -> str:
    mid = f"'{RD.EACH_REFINE}' || " if refine else ""
    return (f"'上下文片段:' || chr(10) || '文件名=' || filename || chr(10) || chunk || chr(10) || '---' || chr(10) || "
            f"{mid}{D.lit(QUESTION)}")


@register("reading_foreach_files", f"""WITH RECURSIVE {_turn_chunks_ctes()},
a1 AS (SELECT conv_id, pos, filename, chunk, {_rd(_each_file_sql(False) + " || '|'")} AS a FROM items),
a2 AS (SELECT conv_id, pos, {_rd(_each_file_sql(True) + " || '|' || a")} AS a FROM a1)
SELECT CAST(conv_id AS BIGINT) AS conv_id, md5(string_agg(a, chr(10) || chr(10) ORDER BY pos)) AS answers_md5,
       CAST(count(*) AS BIGINT) AS n_chunks FROM a2 GROUP BY conv_id""")
def q_reading_foreach_files(spark, sf):
    docs = _turn_docs(spark, sf)
    a = RD.foreach_answers(docs, "conv_id", "turn", F.lit(QUESTION), READ_REPEAT)
    return a.select(F.col("conv_id").cast("bigint"), F.md5("answers").alias("answers_md5"), "n_chunks")


@register("reading_foreach_python", f"""WITH RECURSIVE {_turn_chunks_ctes()},
a1 AS (SELECT conv_id, filename, chunk_no, chunk, {_rd(_each_file_sql(False) + " || '|'")} AS a FROM items)
SELECT CAST(conv_id AS BIGINT) AS conv_id, filename, CAST(chunk_no AS BIGINT) AS chunk_no, {_rd(_each_file_sql(True) + " || '|' || a")} AS answer FROM a1""")
def q_reading_foreach_python(spark, sf):
    a = RD.read_each(_turn_chunks(spark, sf), QUESTION, RD.hash_chat, READ_REPEAT)
    return a.select(F.col("conv_id").cast("bigint"), "filename", F.col("chunk_no").cast("bigint"), "answer")


def _chat_sql(keep_last: bool) -> str:
    """History of each conversation; the retry answers without the last pair."""
    cut = "" if keep_last else "WHERE rn > 1"
    return f"""WITH p AS (SELECT u.conv_id, u.turn, a.text AS r, row_number() OVER (PARTITION BY u.conv_id ORDER BY u.turn DESC) AS rn
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
h AS (SELECT conv_id, count(*) AS n_pairs, arg_max(r, turn) AS last_answer FROM p {cut} GROUP BY conv_id)
SELECT CAST(c.conv_id AS BIGINT) AS conv_id, CAST(coalesce(n_pairs, 0) AS BIGINT) AS n_pairs,
       {_rd(D.lit(QUESTION) + " || '|' || coalesce(last_answer, '')")} AS response, CAST(coalesce(n_pairs, 0) + 1 AS BIGINT) AS history_after
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN h USING (conv_id)"""


def _chat_query(keep_last: bool):
    def q(spark, sf):
        h = RD.respond(RD.history_of(TB.table(spark, sf, "conversations")), F.lit(QUESTION), keep_last=keep_last)
        return h.select(F.col("conv_id").cast("bigint"), F.size("history").cast("bigint").alias("n_pairs"), "response",
                        F.size("after").cast("bigint").alias("history_after"))
    return q


register("chat_history", _chat_sql(True))(_chat_query(True))
register("chat_retry", _chat_sql(False))(_chat_query(False))


# ---------------------------------------------------------------------------
# cell-probed search
# ---------------------------------------------------------------------------

def ivf_index(spark, sf) -> S.CellIndex:
    """The cell index of ``embeddings``, built once and searched many times."""
    return built(spark, sf, "ivf", lambda path: S.CellIndex.build(TB.vectors(spark, sf), path))


def _nprobe(index: S.CellIndex) -> int:
    return max(1, index.centroids().count() // 15)


_IVF_SQL = """v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
nl AS (SELECT CAST(greatest(1, round(4 * sqrt(count(*)))) AS BIGINT) AS nlist FROM v),
c AS (SELECT cell, ce FROM (SELECT row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR))) - 1 AS cell, e AS ce FROM v)
      WHERE cell < (SELECT nlist FROM nl)),
a AS (SELECT id, cell FROM (SELECT v.id, c.cell, row_number() OVER (PARTITION BY v.id ORDER BY
        round(list_sum(list_transform(list_zip(v.e, c.ce), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), 9), c.cell) AS rn
        FROM v CROSS JOIN c) WHERE rn = 1)"""


@register("ivf_assign", f"""WITH {_IVF_SQL}
SELECT CAST(id AS BIGINT) AS id, CAST(cell AS BIGINT) AS cell FROM a""")
def q_ivf_assign(spark, sf):
    return ivf_index(spark, sf).vectors().select(F.col("id").cast("bigint"), F.col("cell").cast("bigint"))


def _ivf_search_sql(k: int) -> str:
    return f"""{_IVF_SQL},
qs AS (SELECT item_id AS query_id, text FROM benchmark),
{D.sparse_embedding_ctes('qs', 'query_id', 'text', Q_DIM_EMB, 'qw')},
qd AS (SELECT query_id, list_transform(range({Q_DIM_EMB}), lambda b: coalesce(
         list_extract(map_extract(m, b), 1), 0)) AS qe
       FROM (SELECT query_id, map(list(bucket), list(CAST(w AS DOUBLE))) AS m FROM qw GROUP BY query_id)),
pr AS (SELECT query_id, cell FROM (SELECT q.query_id, c.cell, row_number() OVER (PARTITION BY q.query_id ORDER BY
        round(list_sum(list_transform(list_zip(q.qe, c.ce), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), 9), c.cell) AS rn
        FROM qd q CROSS JOIN c) WHERE rn <= greatest(1, (SELECT nlist FROM nl) // 15)),
cand AS (SELECT p.query_id, v.id, list_sum(list_transform(list_zip(q.qe, v.e), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS dist
         FROM pr p JOIN a USING (cell) JOIN v USING (id) JOIN qd q USING (query_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), id) AS rk FROM cand)"""


@register("ivf_search", f"""WITH {_ivf_search_sql(VEC_K)}
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(id AS BIGINT) AS id, round(dist, 6) AS distance, CAST(rk AS BIGINT) AS rk
FROM r WHERE rk <= {VEC_K}""")
def q_ivf_search(spark, sf):
    index = ivf_index(spark, sf)
    top = index.topk(_emb_queries(spark, sf), VEC_K, _nprobe(index))
    return top.select(F.col("query_id").cast("bigint"), F.col("id").cast("bigint"),
                      _r6(F.col("distance")).alias("distance"), F.col("rk").cast("bigint"))


@register("ivf_recall", f"""WITH {_ivf_search_sql(VEC_K)},
ex AS (SELECT query_id, id FROM (SELECT q.query_id, v.id, row_number() OVER (PARTITION BY q.query_id ORDER BY
         round(list_sum(list_transform(list_zip(q.qe, v.e), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), 9), v.id) AS rk
         FROM qd q CROSS JOIN v) WHERE rk <= {VEC_K}),
ivf AS (SELECT query_id, id, rk FROM r WHERE rk <= {VEC_K})
SELECT CAST(ex.query_id AS BIGINT) AS query_id, round(count(ivf.rk) / count(*), 6) AS recall
FROM ex LEFT JOIN ivf USING (query_id, id) GROUP BY ex.query_id""")
def q_ivf_recall(spark, sf):
    index, qv = ivf_index(spark, sf), _emb_queries(spark, sf)
    exact = S.exact_topk(TB.vectors(spark, sf), qv, VEC_K)
    approx = index.topk(qv, VEC_K, _nprobe(index))
    rec = S.recall_at_k(exact, approx)
    return rec.select(F.col("query_id").cast("bigint"), _r6(F.col("recall")).alias("recall"))


# ---------------------------------------------------------------------------
# document profile (P9): chunks, counts, length, md5 of a raw text
# ---------------------------------------------------------------------------

@register("text_profile", f"""WITH RECURSIVE src AS (SELECT doc_id, text FROM documents),
{D.chunk_ctes('src', 'doc_id', 'text', 400, 0, None)}
SELECT CAST(s.doc_id AS BIGINT) AS doc_id, CAST(count(c.chunk_no) AS BIGINT) AS chunks_count,
       CAST(length(s.text) AS BIGINT) AS text_length, md5(s.text) AS md5,
       md5(coalesce(string_agg(c.chunk, '|' ORDER BY c.chunk_no), '')) AS chunks_md5
FROM src s LEFT JOIN chunks c USING (doc_id) GROUP BY s.doc_id, s.text""")
def q_text_profile(spark, sf):
    d = TB.table(spark, sf, "documents").select("doc_id", "text")
    p = B.document_profile(d)
    return p.select(F.col("doc_id").cast("bigint"), F.col("profile.chunks_count").cast("bigint").alias("chunks_count"),
                    F.col("profile.text_length").cast("bigint").alias("text_length"), F.col("profile.md5").alias("md5"),
                    F.md5(F.array_join("profile.chunks", "|")).alias("chunks_md5"))
