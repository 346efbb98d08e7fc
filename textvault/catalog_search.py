"""Further registered queries: dictionary cut, token sets, trained cells, packed bits, file names.

As in :mod:`textvault.catalog`, each reads whole tables and has a DuckDB twin that states its
own patterns and values.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from textvault import catalog as C
from textvault.catalog import register
from textvault.functions import bits as BT
from textvault.functions import units as UN
from textvault.functions import vectors as V
from textvault.operators import bit_search as BS
from textvault.operators import dictionary as DI
from textvault.operators import search as S
from textvault.operators import token_sets as TS
from textvault.plans import duck as D
from textvault.sources import tables as TB

# ---------------------------------------------------------------------------
# dictionary cut
# ---------------------------------------------------------------------------

LEAST_DOCS = 30
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())      # what Python calls white space

_CUT_SQL = f"""WITH w AS (SELECT word FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\\p{{L}}{{2,12}}'))) AS word FROM documents)
           GROUP BY word HAVING count(*) >= {LEAST_DOCS}),
l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
p AS (SELECT doc_id, line_no, line, unnest(range(1, length(line) + 1)) AS pos FROM l),
s AS (SELECT doc_id, line_no, pos, n, substr(line, pos, n) AS token FROM p CROSS JOIN (SELECT unnest(range(2, 13)) AS n) WHERE pos + n <= length(line) + 1),
o AS (SELECT s.* FROM s JOIN w ON w.word = s.token),
c AS (SELECT DISTINCT doc_id, line_no, unnest(range(pos, pos + n)) AS pos FROM o),
r AS (SELECT doc_id, line_no, pos, 1 AS n, substr(line, pos, 1) AS token FROM p ANTI JOIN c USING (doc_id, line_no, pos)
      WHERE NOT contains(chr(10) || '{_SPACES.replace(chr(10), "")}', substr(line, pos, 1))),
t AS (SELECT doc_id, line_no, count(*) FILTER (WHERE k = 0) AS words, count(*) FILTER (WHERE k = 1) AS rest, string_agg(token, '|' ORDER BY pos, n) AS tokens
      FROM (SELECT *, 0 AS k FROM o UNION ALL SELECT *, 1 FROM r) GROUP BY doc_id, line_no)
SELECT CAST(l.doc_id AS BIGINT) AS doc_id, CAST(l.line_no AS BIGINT) AS line_no, CAST(coalesce(words, 0) AS BIGINT) AS n_words,
       CAST(coalesce(rest, 0) AS BIGINT) AS n_rest, md5(coalesce(tokens, '')) AS tokens_md5 FROM l LEFT JOIN t USING (doc_id, line_no)"""


def _cut_query(budget: int):
    def q(spark, sf):
        docs = TB.table(spark, sf, "documents").select("doc_id", "text")
        lines = UN.explode_items(docs, F.split("text", "\n", -1), "line_no", "line", "doc_id")
        cut = DI.text_to_tokens(lines, DI.frequent_words(docs, LEAST_DOCS), budget, "line")
        return cut.select(F.col("doc_id").cast("bigint"), F.col("line_no").cast("bigint"), (F.size("tokens") - F.col("rest")).cast("bigint").alias("n_words"),
                          F.col("rest").cast("bigint").alias("n_rest"), F.md5(F.array_join("tokens", "|")).alias("tokens_md5"))
    return q


register("dictionary_cut", _CUT_SQL)(_cut_query(DI.DEFAULT_BUDGET))
# the way for dictionaries beyond the budget
register("dictionary_cut_dealt", _CUT_SQL)(_cut_query(2_000))


# ---------------------------------------------------------------------------
# Jaccard on token sets (V7)
# ---------------------------------------------------------------------------

SET_K, SET_THRESHOLD = 5, 0.15

_SETS_SQL = """WITH q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS t FROM benchmark),
d AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS t FROM documents),
i AS (SELECT query_id, id, count(*) AS n FROM (SELECT query_id, unnest(t) AS token FROM q) JOIN (SELECT id, unnest(t) AS token FROM d) USING (token) GROUP BY ALL),
u AS (SELECT q.query_id, d.id, coalesce(n, 0) AS n, len(q.t) + len(d.t) - coalesce(n, 0) AS m FROM q CROSS JOIN d LEFT JOIN i USING (query_id, id)),
s AS (SELECT query_id, id, CASE WHEN m = 0 THEN 1 ELSE n / m END AS similarity FROM u)"""


def _token_rows(spark, sf):
    docs = TB.table(spark, sf, "documents").select(F.col("doc_id").cast("bigint").alias("id"), TS.token_set(F.col("text")).alias("tokens"))
    asked = TB.queries_text(spark, sf).select(F.col("query_id").cast("bigint"), TS.token_set(F.col("text")).alias("tokens"))
    return TS.TokenSets(docs), asked


@register("token_set_search", f"""{_SETS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(1 - similarity, 9), id) AS rk FROM s)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(id AS BIGINT) AS id, round(1 - similarity, 6) AS distance, CAST(rk AS BIGINT) AS rk FROM r WHERE rk <= {SET_K}""")
def q_token_set_search(spark, sf):
    sets, asked = _token_rows(spark, sf)
    return sets.topk(asked, SET_K).select("query_id", "id", F.round("distance", 6).alias("distance"), F.col("rk").cast("bigint"))


@register("token_set_within", f"""{_SETS_SQL}
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(id AS BIGINT) AS id, round(1 - similarity, 6) AS distance FROM s WHERE similarity >= {SET_THRESHOLD}""")
def q_token_set_within(spark, sf):
    sets, asked = _token_rows(spark, sf)
    return sets.within(asked, SET_THRESHOLD).select("query_id", "id", F.round("distance", 6).alias("distance"))


# ---------------------------------------------------------------------------
# trained cells with a proof of the k-th hit
# ---------------------------------------------------------------------------

def trained_index(spark, sf) -> S.CellIndex:
    """The cell index of ``embeddings`` with trained centroids, built once and searched many times."""
    return C.built(spark, sf, "ivf-trained", lambda path: S.CellIndex.build(TB.vectors(spark, sf), path, iterations=4))


_FULL_SQL = f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
qs AS (SELECT item_id AS query_id, text FROM benchmark),
{D.sparse_embedding_ctes('qs', 'query_id', 'text', C.Q_DIM_EMB, 'qw')},
qd AS (SELECT query_id, list_transform(range({C.Q_DIM_EMB}), lambda b: coalesce(list_extract(map_extract(m, b), 1), 0)) AS qe
       FROM (SELECT query_id, map(list(bucket), list(CAST(w AS DOUBLE))) AS m FROM qw GROUP BY query_id)),
d AS (SELECT q.query_id, v.id, list_sum(list_transform(list_zip(q.qe, v.e), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS dist FROM qd q CROSS JOIN v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), id) AS rk FROM d)"""


@register("ivf_exact_search", f"""{_FULL_SQL}
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(id AS BIGINT) AS id, round(dist, 6) AS distance, CAST(rk AS BIGINT) AS rk FROM r WHERE rk <= {C.VEC_K}""")
def q_ivf_exact_search(spark, sf):
    index = trained_index(spark, sf)
    top = index.topk(C._emb_queries(spark, sf), C.VEC_K, C._nprobe(index), exact=True)
    return top.select(F.col("query_id").cast("bigint"), F.col("id").cast("bigint"), F.round("distance", 6).alias("distance"), F.col("rk").cast("bigint"))


# a proved search finds everything
@register("ivf_exact_recall", "SELECT CAST(item_id AS BIGINT) AS query_id, CAST(1 AS DOUBLE) AS recall FROM benchmark")
def q_ivf_exact_recall(spark, sf):
    index, qv = trained_index(spark, sf), C._emb_queries(spark, sf)
    rec = S.recall_at_k(S.exact_topk(TB.vectors(spark, sf), qv, C.VEC_K), index.topk(qv, C.VEC_K, C._nprobe(index), exact=True))
    return rec.select(F.col("query_id").cast("bigint"), F.round("recall", 6).alias("recall"))


# ---------------------------------------------------------------------------
# packed sign bits (V6, V7, V8)
# ---------------------------------------------------------------------------

def _bit_rows(spark, sf):
    """Sign bits of the vectors (those of label 3 are zero vectors), and of the queries: a bit per token bucket."""
    v = C._with_zeros(spark, sf)
    rows = v.select("id", BT.pack_signs(F.col("embedding"), C.Q_DIM_EMB).alias("bits"))
    asked = TB.queries_text(spark, sf).select("query_id", BT.pack_positions(V.token_buckets(F.col("text"), C.Q_DIM_EMB), C.Q_DIM_EMB).alias("bits"))
    return rows, asked


def _bits_query(metric: str):
    def q(spark, sf):
        rows, asked = _bit_rows(spark, sf)
        top = BS.BitIndex(rows, C.Q_DIM_EMB).topk(asked, C.VEC_K, metric)
        return top.select(F.col("query_id").cast("bigint"), F.col("id").cast("bigint"), F.round("distance", 6).alias("distance"), F.col("rk").cast("bigint"))
    return q


for _m in ["HAMMING", "JACCARD", "TANIMOTO"]:
    register(f"bit_search_{_m.lower()}", C.ORACLE[f"vector_search_{_m.lower()}"])(_bits_query(_m))


# every vector among the vectors themselves, where blocks prove the nearest hits
@register("bit_search_own", """WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings),
d AS (SELECT q.id AS query_id, v.id, len(list_filter(list_zip(q.b, v.b), lambda t: t[1] <> t[2])) AS dist FROM v q CROSS JOIN v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rk FROM d)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(id AS BIGINT) AS id, CAST(dist AS BIGINT) AS distance, CAST(rk AS BIGINT) AS rk FROM r WHERE rk = 1""")
def q_bit_search_own(spark, sf):
    rows = TB.vectors(spark, sf).select("id", BT.pack_signs(F.col("embedding"), C.Q_DIM_EMB).alias("bits"))
    top = BS.BitIndex(rows, C.Q_DIM_EMB).topk(rows, 1, id_col="id")
    return top.select(F.col("query_id").cast("bigint"), F.col("id").cast("bigint"), F.col("distance").cast("bigint"), F.col("rk").cast("bigint"))


@register("bit_pair_metrics", "SELECT id, hamming, jaccard, tanimoto FROM (" + C.ORACLE["vector_pair_metrics"] + ")")
def q_bit_pair_metrics(spark, sf):
    p = C._pairs(spark, sf).select("id", BT.pack_signs(F.col("ea"), C.Q_DIM_EMB).alias("a"), BT.pack_signs(F.col("eb"), C.Q_DIM_EMB).alias("b"))
    a, b = F.col("a"), F.col("b")
    return p.select(F.col("id").cast("bigint"), BT.hamming(a, b).alias("hamming"), F.round(BT.jaccard(a, b), 6).alias("jaccard"),
                    F.round(BT.tanimoto(a, b), 6).alias("tanimoto"))
