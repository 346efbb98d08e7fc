import random

import numpy as np
import pytest
from test_exact_topk import ints, vectors

from textvault.llm import hard_negatives as H
from textvault.llm import tiles as T

SF = "/root/testdata/sf0.01"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "vec_id long, label int, embedding array<double>, goals string, tile int"


def brute(rows, anchors, k=5):
    cands = [(i, b, z) for i, b, v, *_ in rows if i is not None and b is not None and (z := ints(v)) is not None]
    asked = {}
    for i, b, v, *_ in anchors:
        z = ints(v)
        if i is not None and b is not None and z is not None:
            key = (b, np.array(z, "<i4").tobytes())
            asked[i] = min(asked.get(i, (key, z)), (key, z))
    out = []
    for a, ((label, _), x) in asked.items():
        score = [(-sum(p * q for p, q in zip(x, z, strict=False)), i, b) for i, b, z in cands if i != a]
        for p, i, _ in sorted(r for r in score if r[2] == label)[:k]:
            fit = sorted(r[:2] for r in score if r[2] != label and 80 * -p <= 100 * -r[0] <= 100 * -p)[:k]
            out += [(a, i, n + 1, j, -p, -s) for n, (s, j) in enumerate(fit)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select(*NAMES).collect())


def test_strassen_is_exact():
    rng = np.random.default_rng(1)
    for m, k, n in [(1, 1, 1), (3, 5, 7), (64, 64, 64), (65, 33, 100), (40, 129, 70), (0, 5, 3), (5, 0, 3)]:
        for top in (9, 2 ** 20, 2 ** 40):
            a, b = rng.integers(-top, top, (m, k)), rng.integers(-top, top, (k, n))
            want = a.astype(object) @ b.astype(object) if m and k and n else np.zeros((m, n), object)
            assert (H.strassen(a, b, 4) == (want + 2 ** 63) % 2 ** 64 - 2 ** 63).all()


@pytest.mark.parametrize("seed, small", [(1, False), (2, True), (3, True)])
def test_equals_brute_force(spark, monkeypatch, seed, small):
    if small:
        monkeypatch.setattr(T, "SLICE", 23)
        monkeypatch.setattr(T, "GROUP_BYTES", 2000)
    rng = random.Random(seed)
    data = [(i, rng.choice([0, 0, 0, 1, 2, 3, None]), v, "g", 1) for i, v, *_ in
            vectors(seed, 300, 3 if small else 40, ["plain"] * 12 + ["short", "zero", "null", "hole", "tie", "tie", "huge"])]
    data += rng.choices(data, k=20)
    anchors = [r for r in data if r[0] is None or r[0] % 4 == 0]
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    want = brute(data, anchors)
    assert len(want) > 100 and got(H.mine(df(data), df(anchors))) == want


def test_windows_and_empty_tables(spark):
    data = [(0, 1, [1.0, 0.0], "", 0), (1, 1, [0.5, 0.0], "", 0), (2, 2, [0.5, 0.0], "", 0), (3, 2, [0.4, 0.0], "", 0),
            (4, 2, [0.39, 0.0], "", 0), (5, 2, [0.6, 0.0], "", 0), (6, 1, [-1.0, 0.0], "", 0), (7, 2, [-1.0, 0.0], "", 0)]
    df = spark.createDataFrame(data, SCHEMA)
    assert got(H.mine(df, df.filter("vec_id = 0"))) == brute(data, data[:1])
    assert [r[:4] for r in got(H.mine(df, df.filter("vec_id = 0")))] == [(0, 1, 1, 2)]     # 0.4 is floor(102.4) < 0.8 * 128
    assert H.mine(df.limit(0), df).collect() == [] and H.mine(df, df.limit(0)).collect() == []
    assert H.mine(df.filter("vec_id < 2"), df.filter("vec_id = 0")).collect() == []


def test_whole_table_equals_brute_force(spark):
    import __spark_entry__ as E
    data = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"])
            for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute(data, [r for r in data if r[0] % 100 == 0])
    assert want and got(E.queries()["op12_strassen_negatives"](spark, SF)) == want
