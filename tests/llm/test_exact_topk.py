import math
import random

import numpy as np
import pytest

from textvault.llm import exact_topk as X
from textvault.llm import tiles as T

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, score string, norm2 int"


def ints(v):
    """Integer vector by definition; None where it takes no part."""
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    out = [math.floor(256 * x) for x in v]
    return out if sum(x * x for x in out) < 2 ** 62 else None


def brute(rows, queries, k):
    cands = [(i, z) for i, v, *_ in rows if i is not None and (z := ints(v)) is not None]
    asked = {}
    for i, v, *_ in queries:
        z = ints(v)
        if i is not None and z is not None:
            key = np.array(z, "<i4").tobytes()
            asked[i] = min(asked.get(i, (key, z)), (key, z))
    out = []
    for q, (_, a) in asked.items():
        best = sorted((-sum(x * y for x, y in zip(a, z, strict=False)), i) for i, z in cands if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def vectors(seed, n, dim, kinds):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choice(kinds)
        v = [rng.gauss(0, 1) * 2 ** rng.randint(-3, 3) for _ in range(dim)]
        if kind == "short":
            v = v[:rng.randint(0, dim)]
        elif kind == "zero":
            v = [0.0] * dim
        elif kind == "null":
            v = None
        elif kind == "hole":
            v[rng.randrange(dim)] = rng.choice([None, math.nan, math.inf, -math.inf, 1e300])
        elif kind == "tie":
            v = [1.0] * dim
        elif kind == "huge":
            v = [x * 2 ** 21 for x in v]
        out.append((i if rng.random() > 0.03 else rng.choice([None, 3]), v, "x", 1))
    return out


def got(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("seed, small", [(1, False), (2, True), (3, True)])
def test_equals_brute_force(spark, monkeypatch, seed, small):
    if small:                                     # many slices and groups
        monkeypatch.setattr(T, "SLICE", 23)
        monkeypatch.setattr(T, "GROUP_BYTES", 2000)
    data = vectors(seed, 400, 9, ["plain"] * 12 + ["short", "zero", "null", "hole", "tie", "tie", "huge"])
    data += random.Random(seed).choices(data, k=20)
    queries = [r for r in data if r[0] is None or r[0] % 5 == 0]
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert got(X.top_k(df(data), df(queries), 5)) == brute(data, queries, 5)


def test_equal_lengths_are_dealt_over_slices(spark, monkeypatch):
    monkeypatch.setattr(T, "SLICE", 20)
    data = [(i, [math.cos(i), math.sin(i)] if i % 3 else [1.0, 0.0], "", 0) for i in range(200)]
    df = spark.createDataFrame(data, SCHEMA)
    rows, most = X.cut_by_length(T.integer_vectors(df, ["vec_id"]), 200)
    assert rows.count() == 200 and most == sorted(most, reverse=True)
    assert max(r["count"] for r in rows.groupBy("slice").count().collect()) < 60
    assert got(X.top_k(df, df.filter("vec_id % 7 = 0"), 5)) == brute(data, [r for r in data if r[0] % 7 == 0], 5)


def test_few_rows_and_empty_tables(spark):
    data = [(0, [1.0, 2.0], "", 0), (50, [0.5, -1.0], "", 0), (7, None, "", 0)]
    df = spark.createDataFrame(data, SCHEMA)
    assert got(X.top_k(df, df, 5)) == brute(data, data, 5)
    assert X.top_k(df.limit(0), df.limit(0)).collect() == [] and X.top_k(df, df.limit(0)).collect() == []
    assert got(X.top_k(df.filter("vec_id = 0"), df, 5)) == [(50, 1, 0, 128 * 256 - 256 * 512)]


def test_rotation_keeps_products_and_orders_energy(spark):
    rng = np.random.default_rng(4)
    data = [(i, (rng.normal(size=6) * [1, 9, 1, 1, 3, 1]).tolist(), "", 0) for i in range(100)]
    rows = T.integer_vectors(spark.createDataFrame(data, SCHEMA), ["vec_id"])
    columns, levels = X.rotation(rows, 6)
    assert np.allclose(columns.T @ columns, np.eye(levels[-1])) and levels == sorted(levels) and levels[0] == 1
    assert abs(columns[1, 0]) > 0.9


def test_whole_table_equals_brute_force(spark):
    import __spark_entry__ as E
    data = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert got(E.queries()["op11_norm_sorted_topk"](spark, SF)) == brute(data, [r for r in data if r[0] % 50 == 0], 5)
