import random

from textvault.llm import license_scan as S

SF = "/root/testdata/sf0.01"
NOTICES = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
           "This work is licensed under the GNU General Public License, version 3.": "GPL", "Licensed under CC BY-NC 4.0.": "CC-BY-NC"}


def longest_increasing(pairs):
    best = [1] * len(pairs)
    for i in range(len(pairs)):
        for j in range(i):
            if pairs[j][1] < pairs[i][1]:
                best[i] = max(best[i], best[j] + 1)
    return max(best, default=0)


def test_patience_alignment():
    rng = random.Random(0)
    for _ in range(200):
        pairs = list(enumerate(rng.sample(range(30), rng.randint(0, 30))))
        got = S.increasing(pairs)
        assert len(got) == longest_increasing(pairs) and set(got) <= set(pairs)
        assert all(x < y for (_, x), (_, y) in zip(got, got[1:], strict=False))
        a = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 15))]
        b = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 15))]
        al = S.aligned(a, b)
        assert all(a[i] == b[j] for i, j in al)
        assert all(i < k and j < m for (i, j), (k, m) in zip(al, al[1:], strict=False))
        assert S.aligned(a, a) == [(i, i) for i in range(len(a))]


def test_templates_and_changes():
    t = S.Templates()
    rng = random.Random(1)
    for lic, kind, text in S.TEMPLATES:
        body = "Some words before. " * 5 + text + " And other words after it, the license ends." * 3
        got = t.scan(body)
        assert [(g["license"], g["kind"]) for g in got] == [(lic, kind)], (lic, kind, got)
        assert got[0]["coverage"] == 1.0 and body[got[0]["start"]:got[0]["end"]].split()[0].strip('"') == text.split()[0]
        if kind != "notice":
            words = [w for w in text.split() if rng.random() > 0.15]
            for k in rng.sample(range(len(words)), 5):
                words.insert(k, "inserted")
            got = t.scan("x y z " + "\n * ".join(words) + " end")
            assert [g["license"] for g in got] == [lic] and 0.6 <= got[0]["coverage"] < 1
    twice = S.TEMPLATES[2][2] + " middle part here " + S.TEMPLATES[2][2] + " then " + S.TEMPLATES[8][2]
    assert [g["license"] for g in t.scan(twice)] == ["MIT", "MIT", "CC-BY-NC"]
    assert t.scan("The license of the public version is free software in the version of the work.") == []


def test_repeated_long_templates():
    t = S.Templates()
    rng = random.Random(2)
    filler = [f"filler{i}" for i in range(100)]
    for lic, kind, text in S.TEMPLATES:
        n = len(S.tokens(text))
        for between in (0, 1, 2, 5, 9, 15, 23, 28, 40, 60, 92):
            for copies in (2, 3):
                body = (" " + " ".join(filler[:between]) + " ").join([text] * copies)
                got = t.scan("before it " + body + " after it")
                assert [(g["license"], g["kind"], g["words"]) for g in got] == [(lic, kind, n)] * copies, (lic, kind, between)
        if kind != "notice":
            for _ in range(5):
                copy = lambda: " ".join(w for w in text.split() if rng.random() > 0.1)
                got = t.scan(copy() + " x y " + copy())
                assert [(g["license"], g["kind"]) for g in got] == [(lic, kind)] * 2


def test_matches_without_a_run_of_three_words():
    t = S.Templates()
    for text, lic in [("Released under an MIT License.", "MIT"), ("Licensed under the (new) CC variant BY-NC 4.0.", "CC-BY-NC"), ("Licensed under an old or new license.", None),
                      ("Licensed under some CC BY-NC, version 4.0", "CC-BY-NC"),
                      ("Licensed, see file, under the said Apache software License, of Version number 2.0.", "Apache-2.0")]:
        assert [g["license"] for g in t.scan("Some words before. " + text + " Other words after it.")] == [lic] * (lic is not None), text
    for lic, kind, text in S.TEMPLATES:
        words = [w for w, _, _ in S.tokens(text)]
        for k in range(len(words)):
            if kind == "notice" and words[k] != "by-sa":          # any one word replaced but the one that tells two apart
                body = " ".join(words[:k] + ["other"] + words[k + 1:])
                assert [g["license"] for g in t.scan("x y " + body + " z")] == [lic], body
        if kind != "notice":                                      # every third word replaced: no run of three is left
            body = " ".join("other" if k % 3 == 2 else w for k, w in enumerate(words))
            assert [(g["license"], g["kind"]) for g in t.scan("x y " + body + " z")] == [(lic, kind)], lic


def test_whole_table(spark):
    import __spark_entry__ as E
    rows = {r["doc_id"]: r for r in E.queries()["op10_license_alignment"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        want = {lic for line, lic in NOTICES.items() if line in d["text"]}
        assert set(filter(None, rows[d["doc_id"]]["licenses"].split(","))) == want, d["doc_id"]


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (2, "Released under the MIT License.", "c"), (2, "Released under the MIT License.", "c"),
                                (3, "license " * 50000, "d")], "doc_id long, text string, licenses string")
    got = sorted((r["doc_id"] or 0, r["n_licenses"], r["licenses"], r["spans"]) for r in S.report(df).collect())
    assert got == [(0, 0, "", ""), (1, 0, "", ""), (2, 1, "MIT", "MIT:notice:0:30"), (2, 1, "MIT", "MIT:notice:0:30"), (3, 0, "", "")]
    assert S.report(df.limit(0)).count() == 0


def test_many_notices_take_linear_time():
    import time
    t = S.Templates()
    t0 = time.time()
    found = t.scan("Released under the MIT License.\n" * 16_000)
    assert len(found) == 16_000 and time.time() - t0 < 30
    assert all(a["end"] <= b["start"] for a, b in zip(found, found[1:]))
