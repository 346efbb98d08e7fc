"""DuckDB SQL fragments for the correctness twins of the registered queries.

These build plain SQL text (CTE chains) that DuckDB runs over the supplied
parquet views; they restate each rule independently of the Spark code.
"""

from __future__ import annotations

import unicodedata
from html.entities import name2codepoint

NL = "chr(10)"
# Fixed values, stated anew for the twins: white space, CJK ideographs, ends of broken lines, labels, sentences, words.
SPACE = r"\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = f"[{SPACE}]"
IDEOGRAPHS = r"\x{4E00}-\x{9FFF}"
BARE_ENDS = ",，\\/-——~～+=*^&%$#@[<《“、"
SPACED_ENDS = ":：\"'"
LINE_ENDS = "\n。.！!？?；;:：……)]”"
LABELS = (rf"(?i)^(?:[图表式注引]\.*{WS}*\p{{Nd}}+|Fig\.?\p{{Nd}}+|Figure\.?{WS}*\p{{Nd}}+|Table\.?{WS}*\p{{Nd}}+"
          rf"|Equation\.?{WS}*\p{{Nd}}+|Equ\.?{WS}*\p{{Nd}}+)")
SENTENCES = "(?s)(.[^.。!！?？;；]*[.。!！?？;；]?)"
WORDS = rf"[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_{SPACE}]"
WIDE = [*range(0xFF01, 0xFF61), *range(0xFFE0, 0xFFE7)]      # all but the macron have one character as their usual form


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {lit('^' + WS + '+|' + WS + '+' + chr(92) + 'z')}, '', 'g')"


def fullwidth(x: str) -> str:
    usual = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in WIDE}
    one = [c for c in usual if len(usual[c]) == 1]
    out = f"translate(regexp_replace({x}, '　+', ' ', 'g'), {lit(''.join(one))}, {lit(''.join(usual[c] for c in one))})"
    return f"replace({out}, chr({0xFFE3}), ' ' || chr({0x304}))"


def _sep(l: str, p: str) -> str:
    sp = strip(p)
    last = f"right({sp}, 1)"
    return (f"CASE WHEN {strip(l)} = '' THEN {NL} WHEN left({l}, 1) = ' ' THEN {NL} "
            f"WHEN regexp_matches({l}, {lit(LABELS)}) THEN {NL} "
            f"WHEN {sp} = '' THEN {NL} "
            f"WHEN contains({lit(BARE_ENDS)}, {last}) THEN '' "
            f"WHEN contains({lit(SPACED_ENDS)}, {last}) THEN ' ' "
            f"WHEN contains({lit(LINE_ENDS)}, {last}) THEN {NL} "
            f"WHEN regexp_matches({last}, {lit('^[' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + IDEOGRAPHS + ']$')}) THEN '' "
            f"ELSE {NL} END")


def fix_newlines_of_lines(L: str) -> str:
    """Line repair over a materialised list column ``L`` of raw lines."""
    body = f"CASE WHEN i = 1 THEN l ELSE ({_sep('l', L + '[i - 1]')}) || l END"
    return f"replace(array_to_string(list_transform({L}, lambda l, i: {body}), ''), {NL} || {NL}, {NL})"


def fix_error_space_of_chars(C: str) -> str:
    """Per-character form (RE2 has no lookahead) over a list column ``C`` of
    characters whose space runs are already collapsed."""
    body = f"CASE WHEN ch = ' ' AND {C}[i + 2] = ' ' AND {C}[i + 1] BETWEEN '一' AND '鿿' THEN '' ELSE ch END"
    return strip(f"array_to_string(list_transform({C}, lambda ch, i: {body}), '')")


def preprocess_ctes(src: str, key: str, raw: str, out: str = "pre") -> str:
    """CTEs ending in ``out(key, text)``: fullwidth -> lines -> spaces -> newline runs.

    List columns are materialised so lambdas index a column instead of a
    split that would be recomputed per element.
    """
    return (f"{out}_a AS MATERIALIZED (SELECT {key}, string_split({fullwidth(raw)}, {NL}) AS raw_lines FROM {src}),\n"
            f"{out}_b AS MATERIALIZED (SELECT {key}, string_split(regexp_replace({fix_newlines_of_lines('raw_lines')}, "
            f"' {{2,}}', ' ', 'g'), '') AS chars FROM {out}_a),\n"
            f"{out}_c AS (SELECT {key}, {fix_error_space_of_chars('chars')} AS t FROM {out}_b),\n"
            f"{out} AS (SELECT {key}, regexp_replace(t, {NL} || '{{2,}}', {NL}, 'g') AS text FROM {out}_c)")


def sentences(x: str) -> str:
    return (f"list_filter(list_transform(regexp_extract_all({x}, {lit(SENTENCES)}, 1), "
            f"lambda s: {strip('s')}), lambda s: s <> '')")


def units(x: str, size: int) -> str:
    th = size / 10.0
    lines = f"list_filter(list_transform(string_split({x}, {NL}), lambda l: {strip('l')}), lambda l: l <> '')"
    per_sent = f"CASE WHEN length(s) < {th} THEN [s] ELSE regexp_extract_all(s, {lit(WORDS)}) END"
    per_line = (f"CASE WHEN length(l) < {th} THEN [l] ELSE "
                f"flatten(list_transform({sentences('l')}, lambda s: {per_sent})) END")
    return f"flatten(list_transform({lines}, lambda l: {per_line}))"


def chunk_ctes(src: str, key: str, text: str, size: int, overlap: int, limit: int | None, out: str = "chunks") -> str:
    """CTEs ending in ``out(key, chunk_no, chunk)`` via a recursive CTE over chunks.

    Must sit inside ``WITH RECURSIVE``.
    """
    more = "" if limit is None else f" AND rr.k + 1 < {max(int(limit), 1)}"
    return f"""{out}_u0 AS (SELECT {key}, {units(text, size)} AS us FROM {src}),
{out}_u AS (SELECT {key}, unnest(us) AS u, generate_subscripts(us, 1) AS i FROM {out}_u0),
{out}_c AS (SELECT {key}, i, u, sum(length(u)) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c,
                   count(*) OVER (PARTITION BY {key}) AS n FROM {out}_u),
{out}_c2 AS (SELECT *, c - length(u) AS c0 FROM {out}_c),
{out}_r({key}, k, a, z, closed, n) AS (
  SELECT {key}, 0, 1, coalesce(min(i) FILTER (WHERE c > {size}), max(n)), min(i) FILTER (WHERE c > {size}) IS NOT NULL, max(n)
  FROM {out}_c2 GROUP BY {key}
  UNION ALL
  SELECT r.{key}, r.k + 1, r.a2, coalesce(min(x.i) FILTER (WHERE x.c - r.base > {size}), r.n),
         min(x.i) FILTER (WHERE x.c - r.base > {size}) IS NOT NULL, r.n
  FROM (SELECT rr.*, greatest(1, rr.z - {overlap} + 1) AS a2, b.c0 AS base
        FROM {out}_r rr JOIN {out}_c2 b ON b.{key} = rr.{key} AND b.i = greatest(1, rr.z - {overlap} + 1)
        WHERE rr.closed{more}) r
  LEFT JOIN {out}_c2 x ON x.{key} = r.{key} AND x.i > r.z
  GROUP BY r.{key}, r.k, r.a2, r.n, r.base, r.z
),
{out} AS (SELECT r.{key}, r.k AS chunk_no, string_agg(c.u, ' ' ORDER BY c.i) AS chunk
          FROM {out}_r r JOIN {out}_c2 c ON c.{key} = r.{key} AND c.i BETWEEN r.a AND r.z
          GROUP BY r.{key}, r.k)"""


def corpus_cte(name: str = "corpus") -> str:
    return (f"{name} AS (SELECT concat(source, '_', CAST(doc_id AS VARCHAR), '.txt') AS filename, "
            f"text AS raw_text FROM documents)")


# What is dropped from HTML, stated on its own: comments, doctype, three elements with their content, tags whose
# attributes may hold ``>`` in quotes, declarations.
HTML_PARTS = ["(?s)<!--.*?-->", "(?is)<!doctype[^>]*>", "(?is)<script\\b[^>]*>.*?</script\\s*>",
              "(?is)<style\\b[^>]*>.*?</style\\s*>", "(?is)<template\\b[^>]*>.*?</template\\s*>",
              "(?s)</?[A-Za-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>", "(?s)<[!?][^>]*>"]
REFERENCE = "&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def html_text(x: str) -> str:
    out = x
    for pat in HTML_PARTS:
        out = f"regexp_replace({out}, {lit(pat)}, '', 'g')"
    return entities(out)


def entities(x: str) -> str:
    """Character references decoded by looking at each piece after a split."""
    named = ", ".join(f"{lit('&' + n + ';')}: {c}" for n, c in sorted(name2codepoint.items()))
    code = (f"CASE WHEN regexp_matches(r, '^&#[xX]') THEN CAST('0x' || regexp_extract(r, '([0-9A-Fa-f]+);', 1) AS INTEGER) "
            f"WHEN starts_with(r, '&#') THEN CAST(regexp_extract(r, '([0-9]+);', 1) AS INTEGER) "
            f"WHEN r = '&apos;' THEN 39 ELSE (MAP {{{named}}})[r] END")
    pairs = f"list_transform(regexp_extract_all(h, {lit(REFERENCE)}), lambda r: {{'r': r, 'c': {code}}})"
    refs = (f"list_transform({pairs}, lambda p: CASE WHEN (p.c >= 1 AND p.c < 55296) OR (p.c > 57343 AND p.c <= 1114111) "
            f"THEN chr(p.c) ELSE p.r END)")
    return (f"list_transform([{x}], lambda h: CASE WHEN contains(h, '&') THEN array_to_string(list_transform(list_zip("
            f"regexp_split_to_array(h, {lit(REFERENCE)}), list_append({refs}, '')), lambda z: z[1] || z[2]), '') ELSE h END)[1]")


def bucket(tok: str, dim: int) -> str:
    return f"(('0x' || substr(md5({tok}), 1, 4))::INTEGER % {dim})"


def sparse_embedding_ctes(src: str, key: str, text: str, dim: int, out: str) -> str:
    """CTEs ending in ``out(key, bucket, w)`` (w as FLOAT, L2-normalised counts)."""
    return f"""{out}_t AS (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS tok FROM {src}),
{out}_b AS (SELECT {key}, {bucket('tok', dim)} AS bucket, count(*) AS cnt FROM {out}_t GROUP BY ALL),
{out} AS (SELECT {key}, bucket, CAST(cnt / sqrt(sum(cnt * cnt) OVER (PARTITION BY {key})) AS FLOAT) AS w FROM {out}_b)"""


def file_fp(fn: str, text: str) -> str:
    return f"('文件 ' || {fn} || {NL} || {text})"


def chunk_fp(fn: str, no: str, chunk: str) -> str:
    return f"('文件 ' || {fn} || ' 第' || CAST({no} AS VARCHAR) || '部分' || {NL} || {chunk})"


def sparse_topk_sql(qw: str, vw: str, k: int, metric: str, id_alias: str = "id") -> str:
    """Exact top-k between two sparse weight tables (qid, bucket, w) x (id, bucket, w)."""
    d = "CAST(q.w AS DOUBLE) * CAST(v.w AS DOUBLE)"
    dist = {"L2": "nq + nv - 2 * coalesce(dp, 0)", "IP": "coalesce(dp, 0)",
            "COSINE": "1 - coalesce(dp, 0) / (sqrt(nq) * sqrt(nv))"}[metric]
    order = "round(dist, 9) DESC" if metric == "IP" else "round(dist, 9)"
    return f"""SELECT query_id, id AS {id_alias}, round(dist, 6) AS distance, rk FROM (
  SELECT query_id, id, dist, row_number() OVER (PARTITION BY query_id ORDER BY {order}, id) AS rk FROM (
    SELECT qn.query_id, vn.id, {dist} AS dist FROM
      (SELECT query_id, sum(CAST(w AS DOUBLE) * CAST(w AS DOUBLE)) AS nq FROM {qw} GROUP BY query_id) qn
      CROSS JOIN (SELECT id, sum(CAST(w AS DOUBLE) * CAST(w AS DOUBLE)) AS nv FROM {vw} GROUP BY id) vn
      LEFT JOIN (SELECT q.query_id, v.id, sum({d}) AS dp FROM {qw} q JOIN {vw} v USING (bucket) GROUP BY ALL) dd
        ON dd.query_id = qn.query_id AND dd.id = vn.id))
WHERE rk <= {k}"""
