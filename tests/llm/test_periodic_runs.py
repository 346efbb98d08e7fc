import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np

from textvault.llm import periodic_runs as R

SF = "/root/testdata/sf0.001"
NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def brute_runs(w, least=6, exponent=4):
    """Every period, every maximal stretch, its smallest period by definition."""
    out, n = set(), len(w)
    for p in range(1, n // exponent + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            s, e = i, j + p
            if j > i and e - s >= max(least, exponent * p) and not any(all(w[k] == w[k + q] for k in range(s, e - q)) for q in range(1, p)):
                out.add((s, e - s, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_report(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def sorted_rows(rows):
    return sorted(rows, key=repr)


def numbered(texts):
    count, out = itertools.count(1), []
    for t in texts:
        number = defaultdict(count.__next__)
        out += [number[x] for x in t]
    return np.array(out, np.int64), np.array([len(t) for t in texts], np.int64)


def test_extensions_equal_direct_comparison():
    rng = random.Random(2)
    for _ in range(60):
        w = [rng.randrange(1, 3) for _ in range(rng.randint(2, 120))]
        for a in range(len(w) // 2):                          # long repeats
            if rng.random() < 0.02:
                w[len(w) // 2 + a:] = w[a:len(w) - len(w) // 2]
        w = w[:120]
        lce = R.CoverLce(np.array(w, np.int64))
        pairs = [(i, j) for i in range(len(w)) for j in range(i + 1, len(w))]
        i, j = np.array(pairs).T
        want = [next((k for k in range(len(w) - b) if w[a + k] != w[b + k]), len(w) - b) for a, b in pairs]
        assert lce.extend(i, j).tolist() == want


def test_only_cover_positions_are_sorted():
    lce = R.CoverLce(np.arange(1, 1301))
    assert len(lce.rank) == 1300 * len(R.COVER) // R.VERSE
    assert {(a - b) % R.VERSE for a in R.COVER for b in R.COVER} == set(range(R.VERSE))


def test_runs_equal_brute_force():
    rng = random.Random(5)
    found = 0
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 5)):
            t = [rng.randrange(rng.choice([1, 2, 3, 10])) for _ in range(rng.choice([0, 1, 5, 6, 7, 20, 60, 120]))]
            for _ in range(3 if len(t) > 20 and rng.random() < 0.7 else 0):
                p, a = rng.randint(1, len(t) // 4), rng.randrange(len(t))
                for i in range(a + p, rng.randint(a, len(t))):
                    t[i] = t[i - p]
            texts.append(t)
        words, sizes = numbered(texts)
        rows = R.find_runs(words, sizes).tolist()
        for k, t in enumerate(texts):
            want = brute_runs(t)
            found += len(want)
            assert [tuple(r[1:]) for r in rows if r[0] == k] == want
    assert found > 150


def test_long_text_of_one_word_and_of_a_power():
    one = np.ones(200_000, np.int64)
    assert R.find_runs(one, np.array([len(one)])).tolist() == [[0, 0, 200_000, 1]]
    power = np.tile(np.random.default_rng(1).permutation(5000) + 1, 30)
    assert R.find_runs(power, np.array([len(power)])).tolist() == [[0, 0, 150_000, 5000]]


def test_edge_rows_and_clashing_columns(spark):
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "x\u00a0y " * 9, "a b " * 4, "a b a b a b a", "p q r " * 40 + "z", "a\nb\r\nc " * 9]
    data = [(i if i != 5 else None, t, "x", [1]) for i, t in enumerate(texts)] + [(7, "a b " * 4, "y", None)] * 2
    data += [(i, " ".join(f"w{k}" for k in range(50)), "z", None) for i in range(100, 160)]     # some become periodic
    docs = spark.createDataFrame(data, "doc_id long, text string, runs string, best array<int>")
    got = [tuple(r) for r in R.report(docs).collect()]
    assert sorted_rows(got) == sorted_rows(brute_report(i, t) for i, t, *_ in data)
    assert R.report(docs).columns == NAMES
    assert R.report(docs.limit(0)).collect() == []


def test_collapsed_text(spark):
    docs = spark.createDataFrame([(1, "go  on " * 5 + "end")], "doc_id long, text string")
    r = R.runs(docs).first()
    assert [tuple(x) for x in r["runs"]] == [(0, 10, 2)] and r["collapsed"] == "go on end"


def test_whole_table_equals_brute_force(spark):
    import __spark_entry__ as E
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = [tuple(r) for r in E.queries()["op13_periodic_runs"](spark, SF).select(*NAMES).collect()]
    assert sorted_rows(got) == sorted_rows(brute_report(r["doc_id"], r["text"]) for r in docs)
    assert any(r[1] for r in got)
