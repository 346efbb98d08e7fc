import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from textvault.llm import packing as P
from textvault.llm.queries import word_tokenizer

SF = "/root/testdata/sf0.001"


def whole_ids(tok, text):
    return [*tok.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(word_tokenizer())


def check(rows, docs, tok, size):
    """Exact round trip: pieces rebuild each document, sequences are gapless and fit."""
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by_seq.values():
        at = 0
        for off, n in sorted(v):
            assert off == at
            at += n
        assert at <= size
    want = Counter()
    for doc_id, text in docs:
        ids = whole_ids(tok, text)
        for k, at in enumerate(range(0, len(ids), size)):
            part = ids[at:at + size]
            want[(doc_id, k, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    return len(by_seq)


def test_word_memory_equals_whole_encoding(tok):
    ids = P.WordIds(word_tokenizer())
    rng = random.Random(1)
    parts = ["It's", "ΑΣ", "Σ", "é", "é", "<|endoftext|>", " ", "\x1c", " x", "naïve", "123abc", "!!?", "中文",
             "İ", "'s", "don't", "퟿", "ﬁ", "👍🏽", "a" * 100, "́", "\x00", "\x85", "Größe,", "ÀÉ", "ŸẞŊ", "ªº", "ŉa.", "été.", "A.b,", "Hello,", "x..", "ß", "İx,", "İ$$", "(été)", "$x$",
             "क़.", "-1½-", "a_b", "ſ.", "#'s#", "É)"]
    for _ in range(300):
        t = "".join(rng.choice(parts) + rng.choice(["", " ", "\n", "\t", "  ", "\r\n", "\x0b", "\x0c"]) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(ids(t), "<u4").tolist() == whole_ids(tok, t), repr(t)


def test_whole_table(spark, tok):
    import __spark_entry__ as E
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = E.queries()["op5_best_fit_packing"](spark, SF).collect()
    n = check(rows, docs, tok, 4096)
    assert n <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_edges(spark, tok):
    schema = "doc_id long, text string, offset string, length int"
    docs = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "word " * 9000), (4, "x" * 50000)]
    df = spark.createDataFrame([(*d, "z", 0) for d in docs], schema)
    check(P.pack(df, word_tokenizer(), 64).collect(), docs, tok, 64)
    assert P.pack(df.limit(0), word_tokenizer(), 64).count() == 0


def test_plan_near_the_bound():
    rng = random.Random(2)
    for lo, hi, n in [(1, 4096, 3000), (1300, 1400, 500), (1500, 2600, 400), (2049, 4096, 50), (1, 50, 5000)]:
        h = Counter(rng.randint(lo, hi) for _ in range(n))
        plan = P.plan(h, 4096)
        assert Counter() + Counter({k: sum(r[2] * r[4] for r in plan if r[0] == k) for k in h}) == h
        used = max(r[3] + r[4] for r in plan)
        bound = max(-(-sum(k * c for k, c in h.items()) // 4096), sum(c for k, c in h.items() if k > 2048),
                    -(-n // (4096 // lo)))
        assert used <= bound * 1.05 + 2, (lo, hi, used, bound)


def test_the_programme_finds_what_best_fit_does_not():
    rng = np.random.default_rng(1)
    lengths, need = np.unique(rng.integers(1000, 1701, 9000), return_counts=True)
    used, of_programme = P.packed(lengths, need, 4096, P.PASSES)
    n = sum(t for _, t in used)
    assert n <= 3030 and of_programme >= 0.9 * n
    assert sum(t for _, t in P.best_fit(lengths, need.copy(), 4096)) > 3200
    got = np.zeros(len(lengths), np.int64)
    for conf, times in used:
        assert sum(lengths[k] * c for k, c in conf.items()) <= 4096
        for k, c in conf.items():
            got[k] += c * times
    assert (got == need).all()


def test_knapsack_equals_enumeration():
    from itertools import product
    rng = np.random.default_rng(2)
    for _ in range(30):
        lengths, left, value = rng.integers(1, 9, 4), rng.integers(1, 4, 4), rng.random(4)
        best, steps = P.knapsack(value, lengths, left, 20)
        row, which, copies = P.read(steps, np.arange(21))
        for c in range(21):
            want = max(sum(n * v for n, v in zip(x, value)) for x in product(*(range(n + 1) for n in left)) if np.dot(x, lengths) <= c)
            mine = [(k, n) for r, k, n in zip(row, which, copies) if r == c]
            assert abs(best[c] - want) < 1e-9 and abs(sum(n * value[k] for k, n in mine) - want) < 1e-9
            assert sum(n * lengths[k] for k, n in mine) <= c
