"""Packed bits, fuzzy names, numbering and SQL statements against plain Python."""
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from textvault import hooks as HO
from textvault.functions import bits as BT
from textvault.operators import bit_search as BS
from textvault.operators import fuzzy as FZ
from textvault.operators import numbering as NU
from textvault.plans import statements as STM


def packed(spark, rows, dim, name="id"):
    df = spark.createDataFrame(rows, f"{name} long, embedding array<double>")
    return df.select(name, BT.pack_signs(F.col("embedding"), dim).alias("bits"))


def test_packing(spark):
    v = [1.0, -1.0, 0.0] + [2.0] * 64 + [-3.0]
    r = packed(spark, [(1, v), (2, None), (3, [1.0]), (4, [float("nan")] * 68), (5, [None] * 68)], 68).orderBy("id").collect()
    bits = sum(1 << i for i, x in enumerate(v) if x > 0)
    low = bits & (2 ** 64 - 1)
    assert r[0]["bits"] == [low - 2 ** 64 if low >= 2 ** 63 else low, bits >> 64] and all(x["bits"] is None for x in r[1:])
    p = spark.createDataFrame([([0, 3, 63, 64, 3],), ([],)], "p array<int>").select(BT.pack_positions(F.col("p"), 65).alias("b")).collect()
    assert [x["b"] for x in p] == [[(1 | 8 | 1 << 63) - 2 ** 64, 1], [0, 0]]


@pytest.mark.parametrize("dim, spread", [(32, 2), (32, 16), (100, 8)])
def test_bit_search_equals_all_pairs(spark, dim, spread):
    rng = random.Random(dim + spread)
    centres = [[rng.choice([-1.0, 1.0]) for _ in range(dim)] for _ in range(12)]

    def near():
        v = list(rng.choice(centres))
        for i in rng.sample(range(dim), rng.randint(0, spread)):
            v[i] = -v[i]
        return v

    rows = [(i, near() if i % 17 else rng.choice([None, [1.0], [float("nan")] * dim])) for i in range(150)]
    asked = [(i, near()) for i in range(12)] + [(90, None)]
    ok = lambda v: v is not None and len(v) == dim and v[0] == v[0]

    def distance(a, b, metric):
        if not (ok(a) and ok(b)):
            return None
        x, y = {i for i in range(dim) if a[i] > 0}, {i for i in range(dim) if b[i] > 0}
        return len(x ^ y) if metric == "HAMMING" else 1 - len(x & y) / len(x | y)

    index, queries = BS.BitIndex(packed(spark, rows, dim), dim), packed(spark, asked, dim, "query_id")
    for metric in ("HAMMING", "JACCARD"):
        want = []
        for q, a in asked:
            every = sorted((d is None, round(d or 0, 9), i) for i, b in rows for d in [distance(a, b, metric)])
            want += [(q, i, None if none else d, n + 1) for n, (none, d, i) in enumerate(every[:6])]
        got = [(r[0], r[1], None if r[2] is None else round(r[2], 9), r[3]) for r in index.topk(queries, 6, metric).collect()]
        assert sorted(got) == sorted(want)


def test_bit_search_runs_without_python(spark, capsys):
    index = BS.BitIndex(packed(spark, [(i, [1.0, -1.0]) for i in range(5)], 2), 2)
    index.topk(packed(spark, [(1, [1.0, 1.0])], 2, "query_id"), 2).explain()
    assert "Python" not in capsys.readouterr().out


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        old, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(old[j + 1] + 1, row[j] + 1, old[j] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("most", [0, 1, 2])
def test_fuzzy_names_equal_all_pairs(spark, most):
    rng = random.Random(most)
    names = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 14))) + rng.choice(["", ".txt"]) for _ in range(150)] + ["", "x", None]
    patterns = rng.sample([n for n in names if n is not None], 25) + ["", "abab", None, "ab.txt"]
    got = FZ.fuzzy_match(spark.createDataFrame([(n,) for n in names], "filename string"),
                         spark.createDataFrame([(n,) for n in patterns], "pattern string"), most).collect()
    want = [(p, n, edits(p, n)) for p in patterns for n in names if p is not None and n is not None and edits(p, n) <= most]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_numbers_are_gapless_and_ordered(spark):
    rng = random.Random(4)
    names = [f"n{rng.randrange(10 ** 6)}_{i}" for i in range(3000)]
    got = NU.numbered(spark.createDataFrame([(n,) for n in names], "filename string").repartition(16), ["filename"]).collect()
    assert sorted((r["n"], r["filename"], r["total"]) for r in got) == [(i + 1, n, 3000) for i, n in enumerate(sorted(names))]
    assert NU.numbered(spark.createDataFrame([], "filename string"), ["filename"]).collect() == []


def test_statements(spark):
    files = spark.createDataFrame([("k1", "a'b", "m1"), ("k2", "c", "m2")], "filename_md5 string, filename string, text_md5 string")
    assert STM.que_marks(3) == "?, ?, ?" and STM.que_marks(0) == ""
    assert [r["filename"] for r in STM.file_by_key(files, "k1").collect()] == ["a'b"]
    assert STM.file_by_key(files, "k1' OR '1'='1").collect() == []
    assert sorted(r["filename"] for r in STM.files_in(files, ["k1", "k2", "x"]).collect()) == ["a'b", "c"]
    assert STM.files_in(files, []).collect() == []


def test_extractor_table_function(spark):
    files = spark.createDataFrame([("a", b"one\x0ctwo"), ("b", b"\xff"), ("c", b""), ("d", None)], "filename string, content binary")
    HO.register_extractor(spark)
    got = sorted(tuple(r) for r in HO.lateral_pages(files).collect())
    assert got == [("a", 0, "one"), ("a", 1, "two"), ("b", 0, ""), ("c", 0, "")]
    with pytest.raises(AnalysisException):
        spark.sql("SELECT * FROM extract_pages('text')").collect()
