import random
import re
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from textvault.llm import mixing as M

SF = "/root/testdata/sf0.01"


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def slow_quotas(sizes, weights=(1, 2, 3), most=3):
    """Water level by bisection: target = min(cap, level * weight) with sum = total."""
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total = sum(sizes.values())
    low, high = 0.0, 4.0 * total + 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(most * sizes[s], mid * w[s]) for s in names) < total else (low, mid)
    return {s: min(most * sizes[s], high * w[s]) for s in names}


def test_whole_table(spark):
    import __spark_entry__ as E
    f = E.queries()["op9_source_mixing"]
    rows = f(spark, SF).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    sizes = Counter()
    for d in docs.values():
        sizes[d["source"]] += words(d["text"])
    quota = slow_quotas(sizes)
    got = Counter()
    for r in rows:
        d = docs[r["doc_id"]]
        assert r["size"] == words(d["text"]) and r["source_size"] == sizes[d["source"]]
        assert r["target"] == pytest.approx(quota[d["source"]], rel=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        got[d["source"]] += r["taken"]
    assert all(abs(got[s] - quota[s]) <= 0.01 * quota[s] + 5 for s in quota)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, f(spark, SF).collect()))


def test_quotas():
    rng = random.Random(3)
    for _ in range(50):
        sizes = {f"s{i}": rng.choice([0, 1, 50, 10_000]) for i in range(rng.randint(1, 8))} | ({None: 5} if rng.random() < 0.5 else {})
        if sum(sizes.values()):
            want = slow_quotas(sizes)
            assert M.quotas(sizes, (1, 2, 3), 3) == pytest.approx(want, rel=1e-6, abs=1e-6)


def cheapest(patterns, quota, most):
    """Reference min-cost flow: shortest augmenting paths word by word (Bellman-Ford)."""
    source = {s: len(patterns) + i for i, s in enumerate(quota)}
    o, t = len(patterns) + len(quota), len(patterns) + len(quota) + 1
    edges = []

    def edge(a, b, room, cost):
        edges.extend([[a, b, room, cost], [b, a, 0, -cost]])

    for s, q in quota.items():
        edge(source[s], t, round(q), 0)
    for i, (names, n) in enumerate(patterns):
        for s in names:
            edge(i, source[s], most * n, 0)
        for c in range(most):
            edge(o, i, n, c)
    flow = cost = 0
    while True:
        dist, via = {o: 0}, {}
        for _ in range(t + 1):
            for k, (a, b, room, c) in enumerate(edges):
                if room and a in dist and dist[a] + c < dist.get(b, 1e9):
                    dist[b], via[b] = dist[a] + c, k
        if t not in dist:
            return flow, cost
        at = t
        while at != o:
            edges[via[at]][2] -= 1
            edges[via[at] ^ 1][2] += 1
            at = edges[via[at]][0]
        flow, cost = flow + 1, cost + dist[t]


def test_flow_is_cheapest():
    rng = random.Random(5)
    for _ in range(25):
        names = ["a", "b", "c", "d"][:rng.randint(1, 4)]
        patterns = [(tuple(p), rng.randint(0, 6)) for p in {tuple(sorted(rng.sample(names, rng.randint(1, len(names))))) for _ in range(4)}]
        quota = {s: rng.randint(0, 12) for s in names}
        given = M.route(patterns, quota, 3)
        flow = sum(sum(g.values()) for g in given)
        cost = 0
        for (_, n), g in zip(patterns, given, strict=True):
            x = sum(g.values())
            assert x <= 3 * n
            cost += sum(max(0, x - k * n) for k in (1, 2))
        assert all(sum(g.get(s, 0) for g in given) <= quota[s] for s in names)
        assert (flow, cost) == cheapest(patterns, quota, 3)


def test_overlapping_sources(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(1, 9), rng.choice([["a"], ["a", "b"], ["b", "c"], ["c"]])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, members array<string>")
    out, sizes, quota = M.mix(docs, F.col("members"))
    got = out.collect()
    assert len(got) == 400 and all(0 <= r["mix_copies"] <= 3 for r in got)
    by = Counter()
    for r in got:
        by[r["mix_pattern"]] += r["mix_size"] * r["mix_copies"]
    assert abs(sum(by.values()) - sum(quota.values())) <= 12 + 0.01 * sum(quota.values())


def test_more_patterns_than_the_driver_takes(spark, monkeypatch):
    """The wide way gives what the driver's way gives; single sources and overlaps, null source, beyond the limit."""
    rng = random.Random(8)
    groups = [[f"s{i}"] for i in range(30)] + [["s1", "s2"], ["s2", "s3", "t"], ["t"], [None], [None, "u"], ["v", "w"]]
    rows = [(i, "w " * rng.choice([0, 1, 5, 40]), rng.choice(groups)) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, members array<string>")
    key = lambda r: (r["doc_id"], r["mix_copies"])
    small, sizes, quota = M.mix(docs, F.col("members"))
    want = sorted(map(key, small.collect()))
    monkeypatch.setattr(M, "MAX_PATTERNS", 4)
    wide, sizes2, quota2 = M.mix(docs, F.col("members"))
    assert sizes2 == sizes and quota2 == pytest.approx(quota, rel=1e-9)
    assert sorted(map(key, wide.collect())) == want


def test_a_source_per_site(spark):
    n = M.MAX_PATTERNS + 500
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 7 as int))").alias("text"),
                                 F.concat(F.lit("site"), F.col("id")).alias("source"))
    got = M.taken(docs).collect()
    sizes = {f"site{i}": 1 + i % 7 for i in range(n)}
    want = M.quotas(sizes, (1, 2, 3), 3)
    assert len(got) == n
    for r in got:
        s = f"site{r['doc_id']}"
        assert (r["size"], r["source_size"]) == (sizes[s], sizes[s]) and r["target"] == pytest.approx(want[s])
        assert r["taken"] == sizes[s] * (round(want[s]) // sizes[s])


def test_edges(spark):
    schema = "doc_id long, text string, source string, size string, h int, pattern long"
    df = spark.createDataFrame([(1, None, "a", "", 1, 1), (2, "", None, "", 1, 1), (None, "x y", None, "", 1, 1), (3, "w " * 50, "a", "", 1, 1),
                                (3, "w " * 50, "a", "", 1, 1), (4, "u v w", "[null]", None, None, None)], schema)
    rows = M.taken(df).collect()
    assert len(rows) == 6 and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert M.taken(df.limit(0)).count() == 0
    assert M.taken(df.filter("text is null")).collect()[0]["taken"] == 0
    copies = M.mixed(df)
    assert copies.columns == df.columns
    kept = Counter((r["doc_id"], r["text"]) for r in copies.collect())
    want = defaultdict(int)
    for r in rows:
        if r["size"]:
            want[(r["doc_id"], r["size"])] += r["taken"] // r["size"]
    assert {(d, words(t)): n for (d, t), n in kept.items()} == {k: n for k, n in want.items() if n}
