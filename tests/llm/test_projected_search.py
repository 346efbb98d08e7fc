import math

import numpy as np
import pytest

from textvault.llm import projected_search as P

SF = "/root/testdata/sf0.1"


def brute(rows, queries, k):
    """{query: [(vec_id, score)]} on the original vectors."""
    ids = np.array([i for i, _ in rows])
    X = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for q, v in queries:
        v = np.asarray(v, np.float64)
        s = (X * v).sum(1) / (np.sqrt((X * X).sum(1)) * np.sqrt((v * v).sum()))
        out[q] = sorted([(-x, i) for x, i in zip(s.tolist(), ids.tolist(), strict=True) if i != q])[:k]
    return out


def check(rows, want, k, least=0.9):
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = n = 0
    assert set(got) == {q for q, v in want.items() if v}
    for q, v in want.items():
        g = sorted(got.get(q, []))
        assert [x[0] for x in g] == list(range(1, len(v) + 1))
        assert [(-s, i) for _, i, s in g] == sorted((-s, i) for _, i, s in g)
        hit += len({i for _, i, _ in g} & {i for _, i in v})
        n += len(v)
    assert n == 0 or hit / n >= least, hit / n
    return hit / max(n, 1)


@pytest.mark.parametrize("want_rows", [4096, 100])
def test_whole_table(spark, monkeypatch, want_rows):
    import __spark_entry__ as E
    monkeypatch.setattr(P, "WANT_ROWS", want_rows)
    e = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute(e, [x for x in e if x[0] % 50 == 0], 5)
    rows = E.queries()["op1_projected_kdtree"](spark, SF).collect()
    check(rows, want, 5)
    score = {(q, i): -s for q, v in want.items() for s, i in v}
    assert all(r["score"] == pytest.approx(score[(r["query_id"], r["vec_id"])], abs=1e-14) for r in rows if (r["query_id"], r["vec_id"]) in score)


def test_chi_square():
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(200_000, P.DIMS)) ** 2).sum(1)
    for sure in (0.5, 0.9, 0.97):
        assert P.chi_square(P.reach(sure)) == pytest.approx(sure)
        assert (x <= P.reach(sure)).mean() == pytest.approx(sure, abs=0.005)


def test_hot_vector_and_salts(spark, monkeypatch):
    """A third of the rows share one vector; small cells are split by salt."""
    monkeypatch.setattr(P, "CELL_ROWS", 50)
    monkeypatch.setattr(P, "WANT_ROWS", 60)
    rng = np.random.default_rng(4)
    X = rng.normal(size=(600, 16)).astype(np.float32)
    X[::3] = X[0]
    X[1::30] = 2 * X[0]
    rows = [(int(i), x.tolist()) for i, x in enumerate(X)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    q = [r for r in rows if r[0] % 50 == 0]
    got = P.nearest(df, df.filter("vec_id % 50 = 0"), 5).collect()
    check(got, brute(rows, q, 5), 5)
    hot = {r["query_id"]: [] for r in got}
    for r in sorted(got, key=lambda r: r["rank"]):
        hot[r["query_id"]].append(r["vec_id"])
    same = [i for i in range(600) if i % 3 == 0 or i % 30 == 1]
    assert hot[0] == [i for i in same if i != 0][:5]


def test_edges(spark):
    nan, inf = float("nan"), math.inf
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, None]), (None, [1.0, 1.0]),
            (7, [1.0, 1.0, 1.0]), (50, [0.0, 2.0]), (50, [0.0, 2.0]), (8, [3.0, 0.0]), (9, [3.0, 0.0]), (9, [3.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<float>, cell int, rank int, score string")
    got = [tuple(r) for r in P.nearest(df, df.filter("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 8, 1.0), (0, 2, 9, 1.0), (0, 3, 50, 0.0), (50, 1, 0, 0.0), (50, 2, 8, 0.0), (50, 3, 9, 0.0)]
    assert P.nearest(df.limit(0), df, 5).count() == 0
    assert P.nearest(df, df.limit(0), 5).count() == 0


def test_more_queries_than_a_block_and_double_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    assert len(rows) > 4 * P.BLOCK
    got = P.nearest(df, df, 3)
    assert got.select("query_id").distinct().count() == 1500
    e = [(i, np.array(v)) for i, v in rows]
    check([r for r in got.collect() if r["query_id"] % 10 == 0], brute(e, e[::10], 3), 3)
