"""Expensive column expressions stand once in a plan: no inferred or pushed filter evaluates them again."""
from pyspark.sql import functions as F

from textvault.functions import units as UN
from textvault.operators import numbering as NU


def _docs(spark):
    rows = [("a.txt", "one two. three\nfour"), ("b.txt", ""), ("c.txt", None), ("a.txt", "x " * 300)]
    docs = spark.createDataFrame(rows, "filename string, text string").repartition(2)
    return UN.with_chunks(docs, "text", "chunks", 60, 0)


def _uses(df) -> int:
    """Number of places in the plan where texts are cut into lines."""
    return df._jdf.queryExecution().executedPlan().toString().count("split(coalesce(")


def test_chunk_progress_cuts_a_text_once(spark):
    p = NU.chunk_progress(_docs(spark))
    assert _uses(p) == _uses(_docs(spark)) == 1
    got = sorted(tuple(r) for r in p.collect())
    n = sum(r["filename"] == "a.txt" and r["line"].endswith("=600") for r in p.collect())
    want = [("a.txt", 0, "[1/1] 字符数=19")] + [("a.txt", i, f"[{i + 1}/{n}] 字符数=600") for i in range(n)]
    assert n > 1 and got == sorted(want)


def test_keep_rows_is_a_filter_that_stays(spark):
    d = _docs(spark)
    kept = UN.keep_rows(d, F.size("chunks") > 0)
    assert _uses(kept) == 1 and _uses(d.filter(F.size("chunks") > 0)) > 1
    rows = lambda x: sorted((r["filename"], r["text"], r["chunks"]) for r in x.collect())
    assert kept.columns == d.columns and rows(kept) == rows(d.filter(F.size("chunks") > 0)) and len(rows(kept)) == 2
    assert UN.keep_rows(d, F.col("text") == "none").count() == 0
