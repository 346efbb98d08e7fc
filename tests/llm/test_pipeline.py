import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import test_secret_scan
import test_simhash

import corpus_pipeline as C
from textvault.llm import mixing, quality_model, secret_scan
from textvault.llm.shared import documents, stored, table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    """Every stage's rows, on the rows of the one before."""
    docs, out = documents(spark, SF), [("documents", documents(spark, SF))]
    for name, stage in C.STAGES:
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs))
    return dict(out)


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_columns(steps):
    assert [n for n, _ in C.STAGES] == list(steps)[1:]
    for name in ("quality", "dedup", "secrets", "mix"):
        assert steps[name].columns == steps["documents"].columns
        assert steps[name].dtypes == steps["documents"].dtypes


def test_quality(spark, steps):
    judged = quality_model.classify(steps["documents"], table(spark, SF, "labels")).collect()
    keep = {r["doc_id"] for r in judged if r["predicted"]}
    assert rows(steps["quality"]) == Counter({r: n for r, n in rows(steps["documents"]).items() if r[0] in keep})
    assert 0 < len(keep) < len(judged)


def test_dedup(steps):
    docs = [(r["doc_id"], r["text"]) for r in steps["quality"].collect()]
    first = {d for (_, d), _, c in test_simhash.expected(docs) if d == c}
    assert rows(steps["dedup"]) == Counter({r: n for r, n in rows(steps["quality"]).items() if r[0] in first})


def test_secrets(steps):
    before, after = {r["doc_id"]: r for r in steps["dedup"].collect()}, {r["doc_id"]: r for r in steps["secrets"].collect()}
    assert set(before) == set(after)
    changed = 0
    for d, r in after.items():
        spans = test_secret_scan.brute(before[d]["text"])
        assert (r["text"] != before[d]["text"]) == bool(secret_scan.scan_text(before[d]["text"]))
        assert not test_secret_scan.brute(r["text"]) and r["n_chars"] == len(r["text"])
        assert all(before[d]["text"][a:b] not in r["text"] for _, a, b in spans)
        changed += bool(spans)
    assert changed


def test_mix(steps):
    taken = {r["doc_id"]: r["taken"] // r["size"] if r["size"] else 0 for r in mixing.taken(steps["secrets"]).collect()}
    assert rows(steps["mix"]) == Counter({r: taken[r[0]] for r in rows(steps["secrets"]) if taken[r[0]]})


def test_pack(steps):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(C.word_tokenizer())
    text = {r["doc_id"]: r["text"] for r in steps["secrets"].collect()}
    copies = Counter(r["doc_id"] for r in steps["mix"].collect())
    want = Counter()
    for d, n in copies.items():
        ids = [*tok.encode(text[d], add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            want[(d, k, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes()))] += n
    got = steps["pack"].collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for off, n in sorted(v):
            assert off == at
            at += n
        assert at <= 4096


def test_run_and_edges(spark, steps, tmp_path):
    assert rows(C.run(spark, SF).drop("sequence_id", "offset")) == rows(steps["pack"].drop("sequence_id", "offset"))
    odd = spark.createDataFrame(
        [(1, None, "en", "a", 0, "x"), (None, "token=abcdefgh some words", None, None, None, "y"), (2, "", "en", "a", 0, "z"),
         (3, "one two three four", "de", "b", 18, "p"), (3, "one two three four", "de", "b", 18, "p"), (4, "w " * 20000, "de", "b", 40000, "q")],
        "doc_id long, text string, lang string, source string, n_chars long, score string")
    for start in (odd, odd.limit(0)):
        docs = start
        for name, stage in C.STAGES:
            docs = stored(stage(spark, docs, SF), f"odd-{name}")
            if name != "pack":
                assert docs.columns == odd.columns
        assert docs.count() == 0 if start is not odd else docs.count() > 0


def test_stages_keep_columns_of_any_name(spark):
    from textvault.llm import mixing, simhash
    names = ["sim_fp", "sim_row", "sim_none", "sim_id", "sim_all", "mix_size", "mix_copy", "mix_copies", "mix_pattern", "mix_order", "mix_row", "a.b"]
    rows = [(i, f"word{i % 3} and more text number {i % 3}", "en", "s", 1, *[f"{n}{i}" for n in names]) for i in range(9)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *names])
    for out in (simhash.keep_first(docs), mixing.mixed(docs)):
        assert out.columns == docs.columns
        got = [tuple(r) for r in out.collect()]
        assert got and set(got) <= set(rows)
