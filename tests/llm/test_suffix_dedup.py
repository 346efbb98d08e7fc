import hashlib
import random
from collections import defaultdict

import pytest

from pyspark.sql import functions as F

from textvault.llm import suffix_dedup as S

SF = "/root/testdata/sf0.001"


def brute(docs, n=100):
    """(doc_id, bytes, removed, spans, hash of the rest) by looking at every window."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, i))
    seen, out = set(), []
    for i in order:
        b = (docs[i][1] or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            w = b[p:p + n]
            if w in seen:
                gone[p:p + n] = b"\x01" * n
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((docs[i][0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in df.collect()), key=str)


def test_whole_table(spark):
    import __spark_entry__ as E
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = rows_of(E.queries()["op4_suffix_intervals"](spark, SF))
    assert got == brute(docs)
    assert sum(r[2] for r in got) > 0


def made(seed):
    """Texts with shared passages, shifted overlaps, periods, copies and a common line."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(10, 90))) for _ in range(6)]
    line = " ".join(word() for _ in range(14))
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 6)):
            p, k = rng.choice(passages), rng.randint(0, 5)
            parts.append(rng.choice([p, p[rng.randint(0, len(p)):], p[:rng.randint(0, len(p))], " ".join(word() for _ in range(20)),
                                     line, (word() + " ") * rng.randint(1, 80), p[k:] + p[:50]]))
        docs.append((rng.choice([i, i, None, 3]), " ".join(parts)))
    docs += [(100 + i, docs[k][1]) for i, k in enumerate(rng.sample(range(60), 8))]
    return docs


@pytest.mark.parametrize(("seed", "many", "piece"), [(1, 256, 1 << 19), (2, 2, 1 << 19), (3, 256, 300), (4, 3, 150)])
def test_made_texts(spark, monkeypatch, seed, many, piece):
    monkeypatch.setattr(S, "MANY_CLASSES", many)
    monkeypatch.setattr(S, "PIECE", piece)
    docs = made(seed)
    seen = defaultdict(list)            # rows with the same doc_id: order them as the operator does
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for r in S.keyed(df).collect():
        seen[(None if r["d"] == S.LAST else r["d"])].append((r["th"], r["text"]))
    ordered = [(d, t) for d, v in seen.items() for _, t in sorted(v)]
    assert rows_of(S.deduplicated(df)) == brute(ordered)


def test_rows_with_one_doc_id_are_told_apart(spark):
    """Different texts whose 32-bit hashes are equal, under null and under one doc_id."""
    texts = spark.range(300_000).select(F.concat(F.sha2(F.col("id").cast("string"), 512), F.lit(" "), F.col("id")).alias("text"))
    pairs = texts.groupBy(F.hash("text")).agg(F.sort_array(F.collect_list("text")).alias("t")).filter("size(t) > 1").collect()
    docs = [(d, t) for r in pairs for t in r["t"] for d in (None, 7)]
    assert len(docs) >= 8
    got = rows_of(S.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")))
    assert [r for r in got if r[0] is None] == [(None, n, n, 1, hashlib.sha256(b"").hexdigest()) for n in sorted(len(t) for d, t in docs if d is None)]
    assert sorted(r[4] for r in got if r[0] == 7) == sorted(hashlib.sha256(t.encode()).hexdigest() for d, t in docs if d == 7)


def test_maximal_repeats_list_every_place(spark, monkeypatch):
    """Each window that starts at several places has a repeat with all of them, and a repeat's places are equal."""
    monkeypatch.setattr(S, "MANY_CLASSES", 2)
    texts = [t for _, t in made(5)]
    docs = dict(enumerate(t.encode() for t in texts))
    places = defaultdict(set)
    for d, b in docs.items():
        for p in range(len(b) - 99):
            places[b[p:p + 100]].add((d, p))
    groups = defaultdict(list)
    for r in S.maximal_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect():
        groups[r["anchor"], r["repeat"], r["length"]].append((r["doc_id"], r["start"], r["first"]))
    listed = defaultdict(set)
    for (_, _, n), g in groups.items():
        assert len({docs[d][p:p + n] for d, p, _ in g}) == 1 and len(g) == len(set(g)) > 1
        assert [(d, p) for d, p, first in g if first] == [min((d, p) for d, p, _ in g)]
        d0, p0, _ = g[0]
        for o in range(n - 99):
            w = docs[d0][p0 + o:p0 + o + 100]
            listed[w] = max(listed[w], {(d, p + o) for d, p, _ in g}, key=len)
    assert dict(listed) == {w: s for w, s in places.items() if len(s) > 1}


def test_intervals_against_all_pairs():
    rng = random.Random(9)
    for _ in range(40):
        n = 6
        segs = ["".join(rng.choice("ab") for _ in range(rng.randint(8, 20))).encode() for _ in range(rng.randint(2, 5))]
        lead = [rng.randint(0, 1) for _ in segs]
        windows = [max(0, len(s) - k - n + 1) for s, k in zip(segs, lead, strict=True)]
        got = sorted((length, tuple(sorted(places))) for length, places in S.intervals(segs, lead, windows, n))
        spots = [(k, o) for k in range(len(segs)) for o in range(windows[k])]
        want = set()
        for k, o in spots:
            s = segs[k][lead[k] + o:]
            for length in range(n, len(s) + 1):
                occ = tuple(sorted((a, b) for a, b in spots if segs[a][lead[a] + b:lead[a] + b + length] == s[:length]))
                nexts = [segs[a][lead[a] + b + length:lead[a] + b + length + 1] for a, b in occ]
                lefts = [segs[a][lead[a] + b - 1] if b else None for a, b in occ]
                right = len(set(nexts)) > 1 or b"" in nexts
                if len(occ) > 1 and right and (len(set(lefts)) > 1 or None in lefts):
                    want.add((length, occ))
        assert got == sorted(want)


def test_edges(spark):
    schema = "doc_id long, text string, start string, d int, anchor int, spans int"
    docs = [(1, None), (2, ""), (2, ""), (4, "x" * 99), (5, "x" * 100), (5, "x" * 100), (None, "y" * 250), (6, "ab" * 40000)]
    df = spark.createDataFrame([(*d, "s", 1, 2, 3) for d in docs], schema)
    assert rows_of(S.deduplicated(df)) == brute(docs)
    assert S.deduplicated(df.limit(0)).count() == 0
    kept = {r["doc_id"]: r["kept"] for r in S.deduplicated(df, with_text=True).filter("doc_id in (4, 6)").collect()}
    assert kept == {4: "x" * 99, 6: "ab"}     # every window from the third byte on has started before
    assert S.maximal_repeats(df).columns == ["anchor", "repeat", "length", "doc_id", "start", "first"]
