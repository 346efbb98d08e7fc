"""What a step holds or sends stays bounded as its input grows, with the results of the plain way."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textvault.functions import text as TX
from textvault.functions import units as UN
from textvault.functions import vectors as V
from textvault.operators import fuzzy as FZ
from textvault.operators import search as S
from textvault.plans import build as B


def test_topk_hands_on_what_it_cannot_hold(monkeypatch):
    monkeypatch.setattr(S, "HELD_PAIRS", 4096)
    rng = np.random.default_rng(3)
    Q, rows = rng.normal(size=(3, 8)), rng.normal(size=(9_000, 8))
    rows[7] = 0
    top, parts, held = S._TopK(Q, 8_000, "COSINE"), [], 0
    for part in top.add(np.arange(9_000), rows):
        parts.append(part)
        held = max(held, len(part[0]))
    parts += top.taken()
    assert len(parts) > 1 and held <= 2 * 3 * S.ROW_BLOCK + 3 * S.ROW_BLOCK
    q, ids, dist, key = (np.concatenate(x) for x in zip(*parts))
    kept = S._keep_topk(q, key, ids, 8_000)
    want = 1 - (Q @ rows.T) / np.maximum(np.linalg.norm(Q, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None], 1e-300)
    for i in range(3):
        order = sorted(range(9_000), key=lambda j: (np.inf if j == 7 else round(want[i, j], 9), j))[:8_000]
        assert ids[kept][q[kept] == i].tolist() == order


def test_pairs_are_gathered_a_bounded_number_at_a_time(monkeypatch):
    rng = np.random.default_rng(4)
    Q, rows, seen = rng.normal(size=(5, 4)), rng.normal(size=(700, 4)), []
    plain = S._pair_metric
    monkeypatch.setattr(S, "PAIR_BYTES", 8 * 4 * 100)
    monkeypatch.setattr(S, "_pair_metric", lambda a, b, m: seen.append(len(a)) or plain(a, b, m))
    qi, vj = np.repeat(np.arange(5), 700), np.tile(np.arange(700), 5)
    got = S._exact_pairs(Q, rows, qi, vj, "L2")
    assert max(seen) == 100 and np.allclose(got, ((Q[qi] - rows[vj]) ** 2).sum(1))
    assert S._exact_pairs(Q, rows, qi[:0], vj[:0], "L2").tolist() == []


@pytest.mark.parametrize("most", [1, 2])
def test_patterns_of_common_trigrams_are_found_by_deletion(spark, monkeypatch, most):
    monkeypatch.setattr(FZ, "MANY", 2)
    monkeypatch.setattr(FZ, "DELETED_ROWS", 0)
    used = []
    plain = FZ._deletions
    monkeypatch.setattr(FZ, "_deletions", lambda c, e: used.append(1) or plain(c, e))
    rng = random.Random(most)
    names = [f"web_{rng.randrange(10_000, 10_400)}.txt" for _ in range(150)] + ["web_1é7.txt", "x" * 60 + "web_100.txt", None]
    patterns = [f"web-{rng.randrange(10_000, 10_400)}.tx" for _ in range(20)] + names[:5] + ["x" * 60 + "web-100.txt", None]
    got = FZ.fuzzy_match(spark.createDataFrame([(n,) for n in names], "filename string"),
                         spark.createDataFrame([(p,) for p in patterns], "pattern string"), most)
    all_pairs = (spark.createDataFrame([(p,) for p in patterns], "pattern string").crossJoin(spark.createDataFrame([(n,) for n in names], "name string"))
                 .withColumn("distance", F.levenshtein("pattern", "name").cast("bigint")).filter(F.col("distance") <= most))
    assert used and sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in all_pairs.collect())


CHARS = list("abz09_ .!?;,\n\t\"é文。！？；　ＡＢ１\u0301\u200a\uff5f-") + ["  ", "```", "\n\n", "\U0001d538", "\ud7ff", "\uffee"]


def test_cheap_scans_change_no_text(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(CHARS[:n]) for _ in range(rng.randint(0, 60))) for n in (8, 14, len(CHARS)) for _ in range(400)] + ["", "。", "a..b", ".", "a.b", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4)
    t = F.col("t")
    plain_space = TX.py_strip(F.regexp_replace(F.regexp_replace(t, " {2,}", " "), f" (?=[{TX.CJK_CLASS}] )", ""))
    src, dst, multi = TX.fullwidth_table()
    wide = F.translate(F.regexp_replace(t, "　+", " "), src, dst)
    for k, v in multi.items():
        wide = F.replace(wide, F.lit(k), F.lit(v))
    stripped = F.filter(F.transform(F.regexp_extract_all(t, F.lit(UN.SENTENCE_REGEX), 1), TX.py_strip), lambda s: s != "")
    pairs = {"space": (TX.fix_error_space(t), plain_space), "wide": (TX.replace_fullwidth_chars(t), wide),
             "sentences": (UN.text_to_sentences(t), stripped),
             "words": (UN.word_tokens(t), F.regexp_extract_all(t, F.lit(UN.WORD_REGEX), 0)),
             "tokens": (V.tokens(t), F.regexp_extract_all(F.lower(t), F.lit(V.TOKEN_REGEX), 0)),
             "shown": (TX.show_text(t), F.when(t == "", "").otherwise(TX._show_fenced(t)))}
    for name, (got, want) in pairs.items():
        assert d.filter(~got.eqNullSafe(want)).select("t", got, want).collect() == [], name


def test_embedding_counts_the_bucket_of_every_token(spark):
    texts = ["", None, "The the cat", "été 文 文 x1", " ".join(f"w{i}" for i in range(3000))] * 300
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    for r in d.select("t", V.hashed_embedding(F.col("t"), 64).alias("e"), V.token_buckets(F.col("t"), 64).alias("b")).collect():
        m = np.bincount(np.asarray(r["b"] or [], int), minlength=64).astype(float)
        assert np.array_equal(np.asarray(r["e"], np.float32), (m / (np.linalg.norm(m) or 1)).astype(np.float32))


def test_knowledge_computes_a_text_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(t):
        seen.add(1)
        return t

    docs = spark.createDataFrame([(f"{i}.txt", f"one two {i}. " * 40) for i in range(30)], "filename string, text string")
    kb = B.Knowledge.build(docs.select("filename", counted("text").alias("text")), str(tmp_path / "kb"))
    assert seen.value == 30
    want = B.chunk_rows(docs).select("filename_md5_no", "chunk_md5", "embedding")
    assert sorted(map(tuple, kb.chunks().select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_refresh_writes_chunks_once(spark, tmp_path, monkeypatch):
    """Other chunk parameters: chunks are made where they are written, not set aside and dealt with their vectors; chunks without a file in any listing stay."""
    from textvault.operators import store as ST
    from textvault.plans import build as B
    from textvault.plans import sync as SY

    set_aside, scratch = [], SY.scratch_path
    monkeypatch.setattr(SY, "scratch_path", lambda s, name: set_aside.append(name) or scratch(s, name))
    listing = lambda rows: spark.createDataFrame(rows, "filename string, text string")
    old = [(f"f{i}.txt", f"Some words of file {i}. " * 20) for i in range(6)] + [("gone.txt", "It went. " * 20), ("lost.txt", "No file row. " * 20)]
    new = [(n, t + " More." if n == "f1.txt" else t) for n, t in old[:6]] + [("f9.txt", "A new one. " * 20), ("f2.txt", old[2][1]), ("none.txt", None)]
    small = B.BuildParams(chunk_size=60)
    for lost in (False, True):
        store = ST.KnowledgeStore(spark, str(tmp_path / f"store-{lost}"))
        SY.sync_store(store, listing(old[:7] + old[7:] * lost), B.BuildParams())
        if lost:
            files, chunks = (spark.createDataFrame(x.drop("bucket").collect(), x.drop("bucket").schema) for x in (store.files(), store.chunks()))
            store.commit(files.filter("filename <> 'lost.txt'"), chunks, None, params=B.BuildParams().fingerprint())
        set_aside.clear()
        SY.sync_store(store, listing(new), small)
        assert ("refresh-chunks" in set_aside) == lost
        want = {r["filename_md5_no"]: (r["chunk_md5"], r["embedding"]) for r in B.chunk_rows(listing(sorted({(n, t or "") for n, t in new})), small).collect()}
        got = [r for r in store.chunks().collect() if r["filename"] != "lost.txt"]
        assert {r["filename_md5_no"]: (r["chunk_md5"], r["embedding"]) for r in got} == want and len(got) == len(want)
        kept = {r["chunk_md5"] for r in store.chunks().filter("filename = 'lost.txt'").collect()}
        assert kept == ({r["chunk_md5"] for r in B.chunk_rows(listing(old[7:])).collect()} if lost else set())
        assert sorted(r["filename"] for r in store.files().collect()) == sorted({n for n, _ in new})
