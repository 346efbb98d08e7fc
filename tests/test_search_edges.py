"""Undefined vectors, empty tables, trained cells and the proved stop."""
import math
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from textvault.operators import search as S
from textvault.sources import tables as TB

SF = "/root/testdata/sf0.01"
NAN, INF = math.nan, math.inf
ROWS = [(1, [0.0, 1.0]), (2, None), (3, [NAN, 1.0]), (4, [1.0, None]), (5, [1.0]), (6, [3.0, 4.0]), (7, [INF, 0.0]), (8, [])]


def frame(spark, rows, name="id"):
    return spark.createDataFrame(rows, f"{name} long, embedding array<double>")


@pytest.mark.parametrize("metric, budget", [(m, S.DEFAULT_BROADCAST_BUDGET) for m in ("L2", "IP", "COSINE", "HAMMING", "TANIMOTO")] + [("L2", 1), ("COSINE", 1)])
def test_undefined_vectors_rank_last_with_null_distance(spark, metric, budget):
    asked = frame(spark, [(10, [1.0, 1.0]), (11, None), (12, [NAN, 0.0]), (13, [1.0])], "query_id")
    got = S.exact_topk(frame(spark, ROWS), asked, 8, metric, budget=budget).collect()
    by = {q: [(r["id"], r["distance"]) for r in sorted(got, key=lambda r: r["rk"]) if r["query_id"] == q] for q in (10, 11, 12, 13)}
    assert [i for i, d in by[10] if d is not None] in ([1, 6], [6, 1])
    assert [i for i, d in by[10]][2:] == [2, 3, 4, 5, 7, 8] and all(d is None for _, d in by[10][2:])
    for q in (11, 12, 13):
        assert by[q] == [(i, None) for i in range(1, 9)]


def test_empty_tables(spark):
    none, some = frame(spark, []), frame(spark, ROWS)
    asked = frame(spark, [(10, [1.0, 1.0]), (11, None)], "query_id")
    assert S.exact_topk(none, asked, 3).collect() == [] and S.exact_topk(some, asked.limit(0), 3).collect() == []
    for rows in (none, some.filter("id = 2")):
        for iterations in (0, 2):
            index = S.CellIndex.build(rows, tempfile.mkdtemp(), iterations=iterations)
            assert index.vectors().collect() == [] and index.topk(asked, 3, 2).collect() == []
            assert S.CellIndex(spark, index.path).topk(asked, 3, 2, exact=True).collect() == []


def test_index_holds_defined_vectors_only(spark):
    index = S.CellIndex.build(frame(spark, ROWS), tempfile.mkdtemp(), 2, iterations=1)
    assert sorted(r["id"] for r in index.vectors().collect()) == [1, 6]
    asked = frame(spark, [(10, [0.0, 1.0]), (11, None)], "query_id")
    got = sorted((r["query_id"], r["rk"], r["id"], r["distance"]) for r in index.topk(asked, 5, 1, exact=True).collect())
    assert got == [(10, 1, 1, 0.0), (10, 2, 6, 18.0)]
    with pytest.raises(ValueError):
        index.topk(asked, 5, 1, "IP", exact=True)


def test_trained_cells_recall_and_proved_stop(spark):
    rows = TB.vectors(spark, "/root/testdata/sf0.1")
    asked = rows.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    index = S.CellIndex.build(rows, tempfile.mkdtemp(), iterations=4)
    cells = {r["cell"]: r for r in index.cells().collect()}
    assert sum(r["n"] for r in cells.values()) == rows.count()
    exact = S.exact_topk(rows, asked, 5)
    nprobe = len(cells) // 3
    recall = S.recall_at_k(exact, index.topk(asked, 5, nprobe)).agg(F.avg("recall")).first()[0]
    visits = index.probes(asked.select("query_id", F.col("embedding").alias("vec")), nprobe).collect()
    read = sum(cells[r["cell"]]["n"] for r in visits) / rows.count() / asked.count()
    assert recall >= 0.9 and read <= 0.4, (recall, read)
    few = S.recall_at_k(exact, index.topk(asked, 5, 3, exact=True)).agg(F.min("recall")).first()[0]
    assert few == 1.0


def test_proved_stop_leaves_far_cells_unread(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8)) * 50
    rows = [(i, (centres[i % 40] + rng.normal(size=8)).tolist()) for i in range(2000)]
    index = S.CellIndex.build(frame(spark, rows), tempfile.mkdtemp(), iterations=6)
    asked = frame(spark, [(i, v) for i, v in rows[:20]], "query_id")
    top = index.topk(asked, 5, 2, exact=True)
    want = S.exact_topk(frame(spark, rows), asked, 5)
    assert sorted(map(tuple, top.select("query_id", "id", "rk").collect())) == sorted(map(tuple, want.select("query_id", "id", "rk").collect()))
    bounded = asked.select("query_id", F.col("embedding").alias("vec"), F.lit(5.0).alias("within"))
    assert index.probes(bounded, 2, "within").count() < 20 * index.cells().count() / 4


def test_overfull_cells_are_split(spark):
    rng = np.random.default_rng(2)
    dense = [(i, rng.normal(size=4).tolist()) for i in range(3000)]
    far = [(5000 + i, (rng.normal(size=4) + 1000 * (i + 1)).tolist()) for i in range(12)]
    rows = frame(spark, dense + far)
    start = np.array([v for _, v in far[:11]] + [[0.0] * 4])           # one centroid for all the dense ones
    trained = S.train_centroids(rows, start, 3012, 6, "embedding")
    assert (np.abs(trained).max(1) < 10).sum() > 1


@pytest.mark.parametrize("metric", ["L2", "IP", "COSINE"])
def test_tiles_equal_the_broadcast_way(spark, monkeypatch, metric):
    monkeypatch.setattr(S, "SLICE_ROWS", 60)
    monkeypatch.setattr(S, "GROUP_BYTES", 8 * 6 * 7)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * 10 ** rng.uniform(-1, 2)).tolist() if i % 5 else [1.0] * 6) for i in range(400)] + [(900, None), (901, [NAN] * 6)]
    asked = [(i, (rng.normal(size=6) * 10 ** rng.uniform(-1, 2)).tolist()) for i in range(20)] + [(50, [1.0] * 6), (51, [0.0] * 6), (52, None)]
    v, q = frame(spark, rows), frame(spark, asked, "query_id")
    near = lambda df: sorted((r["query_id"], r["rk"], r["id"], None if r["distance"] is None else round(r["distance"], 7)) for r in df.collect())
    for k in (4, 402) if metric == "L2" else (4,):
        assert near(S.exact_topk(v, q, k, metric, budget=1)) == near(S.exact_topk(v, q, k, metric))
