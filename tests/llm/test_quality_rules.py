import math
import re
from collections import Counter

import duckdb
import pytest

from pyspark.sql import functions as F

from textvault.llm import quality_rules as R

SF = "/root/testdata/sf0.1"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    c = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if c[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


def test_whole_table_and_twin(spark):
    import __spark_entry__ as E
    rows = E.queries()["op7_risk_controlled_rules"](spark, SF).collect()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(text)
    assert all(tuple(r[c] for c in BASE) == plain(text[r["doc_id"]]) for r in rows)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cols = ["doc_id", *BASE, "kept"]
    twin = con.execute(f"SELECT {', '.join(cols)} FROM ({E.oracle_sql()['op7_risk_controlled_rules']})").fetchall()
    assert sorted(tuple(r[c] for c in cols) for r in rows) == sorted(twin)
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(label[r["doc_id"]], r["kept"]) for r in rows if r["doc_id"] in label and not r["base_failed"]]
    assert sum(not k for q, k in judged if q) <= R.RISK * sum(1 for q, _ in judged if q)
    assert any(not r["kept"] and not r["base_failed"] for r in rows)     # the thresholds do reject


def test_binomial_tail(spark):
    cases = [(n, k, p) for n in (1, 5, 50, 700, 5000) for k in (0, 1, 2, 7, 40) for p in (0.02, 0.3) if k < n * p]
    for p in (0.02, 0.3):
        mine = [(n, k) for n, k, q in cases if q == p]
        got = spark.createDataFrame(mine, "n long, k long").select("n", "k", R.at_most(F.col("n"), F.col("k"), p).alias("v")).collect()
        for r in got:
            want = sum(math.comb(r["n"], i) * p ** i * (1 - p) ** (r["n"] - i) for i in range(r["k"] + 1))
            assert r["v"] == pytest.approx(want, rel=1e-8, abs=1e-280)
    n, k, p = 10_000_000, 199_000, 0.02                       # twenty thousand terms matter not: a few thousand are walked
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total, term = 0.0, 1.0
    for i in range(k, 0, -1):
        total += term
        term *= i * (1 - p) / ((n - i + 1) * p)
    got = spark.createDataFrame([(n, k)], "n long, k long").select(R.at_most(F.col("n"), F.col("k"), p).alias("v")).first()["v"]
    assert got == pytest.approx(math.exp(log) * (total + term), rel=1e-5)


def test_no_python_in_the_plan(spark):
    plan = R.measured(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan


def test_edges(spark):
    texts = [None, "", " \n\t", "a b c d e a b c d e", "x " * 4, "\n".join(["same line here"] * 4), "é#ö*" * 5, "w " * 30000,
             "a b c d e f g h i j k\x0bl\x0cm", "\x85a\xa0b"]
    schema = "doc_id long, text string, lang string, n_words string, w int, h int, stratum int"
    df = spark.createDataFrame([(i if i != 3 else None, t, "en" if i % 2 else None, "x", 1, 2, 3) for i, t in enumerate(texts)] + [(5, texts[5], "en", "x", 1, 2, 3)], schema)
    labels = spark.createDataFrame([(5, 1, 0), (5, None, 0), (None, 1, 0), (4, 0, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    rows = R.judged(df, labels).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        t = texts[r["doc_id"] if r["doc_id"] is not None else 3]
        assert tuple(r[c] for c in BASE) == plain(t), t
        assert r["kept"] == (not r["base_failed"])           # too few labels for any cutoff
    assert R.judged(df.limit(0), labels).count() == 0
    assert R.judged(df, labels.limit(0)).count() == len(texts) + 1
