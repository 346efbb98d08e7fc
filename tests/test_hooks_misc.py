"""Hooks, scripts, NULL texts and small store operations."""
import tempfile

import numpy as np
from pyspark.sql import functions as F

from textvault.functions import vectors as V
from textvault.functions.text import show_text
from textvault.hooks import HashingEmbedder, PandasEmbedder
from textvault.operators import search as S
from textvault.operators import store as ST
from textvault.operators.positions import occurrence_rows
from textvault.plans import build as B
from textvault.sources import files as FS


def test_embedders_take_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None), (3, "")], "id int, t string")
    rows = {r.id: r.e for r in df.select("id", HashingEmbedder(16)(F.col("t")).alias("e")).collect()}
    assert abs(np.linalg.norm(rows[1]) - 1) < 1e-6 and not any(rows[2]) and not any(rows[3])
    model = PandasEmbedder(lambda: 3, lambda k, texts: [[float(len(t) * k), 1.0] for t in texts], 2, "test")
    rows = {r.id: r.e for r in df.select("id", model(F.col("t")).alias("e")).collect()}
    assert rows == {1: [15.0, 1.0], 2: [0.0, 1.0], 3: [0.0, 1.0]}
    assert df.select(V.embedding_json(F.array(F.lit(1.0))).alias("j")).first().j == "[1.0]"


def test_python_embedder_in_the_build(spark):
    p = B.BuildParams(embedder=PandasEmbedder(lambda: 1, lambda k, texts: [[float(len(t))] for t in texts], 1, "len"))
    docs = spark.createDataFrame([("a.txt", "hello")], "filename string, text string")
    assert B.chunk_rows(docs, p).first().embedding == [float(len("文件 a.txt 第0部分\nhello"))]


def test_undefined_distances_rank_last(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "id int, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id int, embedding array<float>")
    for budget in (S.DEFAULT_BROADCAST_BUDGET, 1):
        for metric in ("COSINE", "TANIMOTO"):
            got = [(r.id, r.distance) for r in S.exact_topk(v, q, 2, metric, budget=budget).orderBy("rk").collect()]
            assert got == [(2, 0.0), (1, None)], (metric, budget)
    assert S.exact_topk(v, q, 0).count() == 0


def test_sql_script(spark):
    with tempfile.NamedTemporaryFile("w", suffix=".sql", delete=False) as fh:
        fh.write("CREATE OR REPLACE TEMP VIEW va AS SELECT 1 AS x;\n ;CREATE OR REPLACE TEMP VIEW vb AS SELECT x + 1 AS y FROM va;")
    assert FS.execute_sql_file(spark, fh.name) == 2
    assert spark.table("vb").first().y == 2


def test_delete_chunks_of_a_file(spark):
    chunks = spark.createDataFrame([("a", "a_0"), ("a", "a_1"), ("b", "b_0")], "filename_md5 string, filename_md5_no string")
    left = ST.delete_chunk_by_filename_md5(chunks, spark.createDataFrame([("a",)], "filename_md5 string"))
    assert [r.filename_md5_no for r in left.collect()] == ["b_0"]


def test_long_texts_stay_linear(spark):
    text = "\n".join(["line <x>", "```py", "a < b", "```"] * 5000)
    df = spark.createDataFrame([(1, text)], "id int, t string")
    html = df.select(show_text(F.col("t")).alias("h")).first().h
    assert html.count("<pre>") == 5000 and html.count("<br></code></pre>") == 5000
    places = [r.place for r in occurrence_rows(df, "id", "t", "```").orderBy("n").collect()]
    assert places[:2] == [text.index("```"), text.index("```", text.index("```") + 1)] and len(places) == 10000
