import random
import re

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from textvault.llm import simhash as S

SF = "/root/testdata/sf0.01"


def plain(text, n=3):
    """The contract, word for word."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    parts = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(fps, t=2):
    """Component of each fingerprint by comparing all pairs in blocks."""
    fps = np.array(sorted(set(fps)), np.uint64)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1:]) <= t):
            root[find(i)] = find(int(j) + i + 1)
    return {int(f): find(i) for i, f in enumerate(fps)}


def expected(docs, t=2):
    fp = {i: plain(x) for i, (_, x) in enumerate(docs)}
    comp = brute(fp.values(), t)
    ids = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            c = comp[fp[i]]
            ids[c] = min(ids.get(c, d), d)
    return sorted(((d is None, d or 0), f"{fp[i]:016x}", ids.get(comp[fp[i]])) for i, (d, _) in enumerate(docs))


def rows_of(df):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["fingerprint"], r["component_id"]) for r in df.collect())


def test_code_is_perfect():
    code = S.Covering(2)
    assert (code.count[0] == 1).all()
    rng = np.random.default_rng(0)
    fp = rng.integers(-2**63, 2**63 - 1, 50)
    at, key, home = code.anchors(fp)
    assert len(set(zip(at[home == 0].tolist(), key[home == 0].tolist(), strict=True))) == (home == 0).sum()
    for i in range(50):
        reach = set(key[(at == i) & (home == 0)].tolist())
        for _ in range(60):
            y = fp[i] ^ np.int64(sum(1 << b for b in rng.choice(46, 2, replace=False).tolist()))
            ay, ky, hy = code.anchors(np.array([y]))
            assert ky[hy == 1][0] in reach


def test_whole_table(spark):
    import __spark_entry__ as E
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(E.queries()["op3_simhash_anchors"](spark, SF)) == expected(docs)


def test_dense_groups(spark, monkeypatch):
    """Chains and balls of near fingerprints, split by salt and looked up by neighbour."""
    monkeypatch.setattr(S, "HOT_HOMES", 16)
    rng = random.Random(1)
    fps = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(150):
            fps.add(x)
            x ^= 1 << rng.randrange(64)
            x ^= 1 << rng.randrange(64)
    base = rng.getrandbits(64)
    fps |= {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)}
    fps |= {rng.getrandbits(64) for _ in range(500)}
    signed = [(x - (1 << 64) if x >> 63 else x) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(4)
    comp = brute(fps)
    for many in (1, 10**9):
        monkeypatch.setattr(S, "MANY", many)
        got = {r["fp"]: r["root"] for r in df.join(S.components(S.near_links(df, 2)).toDF("fp", "root"), "fp", "left").collect()}
        root = {}
        for x in fps:
            s = x - (1 << 64) if x >> 63 else x
            c, r = comp[x], got[s] if got[s] is not None else s
            assert root.setdefault(c, r) == r
        assert len(set(root.values())) == len(set(comp.values()))


def test_links_both_ways():
    rng = np.random.default_rng(2)
    h = rng.integers(-2**63, 2**63 - 1, 40)
    o = np.concatenate([h ^ np.int64(3), h ^ np.int64(1 << 62), rng.integers(-2**63, 2**63 - 1, 50)])
    a = S.links(h, o, 2)
    old, S.MANY = S.MANY, 1
    b = S.links(h, o, 2)
    S.MANY = old
    assert sorted(zip(*map(np.ndarray.tolist, a))) == sorted(zip(*map(np.ndarray.tolist, b)))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "a  b\tc\x0bd É é", "x " * 70000])
def test_fingerprint(text):
    got = S.fingerprint(text)
    assert got % (1 << 64) == plain(text)


def test_edges(spark):
    schema = "doc_id long, text string, fp string, root int, fingerprint int"
    docs = [(3, "a b c d"), (1, None), (7, ""), (None, ""), (2, "A b  c D"), (2, "A b  c D"), (None, "lonely words here"), (9, "y " * 30000)]
    df = spark.createDataFrame([(*d, "q", 1, 2) for d in docs], schema)
    assert rows_of(S.near_duplicates(df)) == expected(docs)
    assert S.near_duplicates(df.limit(0)).count() == 0
    kept = S.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect() if r["text"] != "y " * 30000) == [
        (0, "lonely words here"), (1, None), (2, "A b  c D")]
    assert S.keep_first(df.filter(F.lit(False))).count() == 0
