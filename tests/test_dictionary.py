import random

from textvault.operators import dictionary as D


def naive(text, words):
    return sorted((i, len(w)) for w in words for i in range(len(text) - len(w) + 1) if text.startswith(w, i))


def naive_cut(text, words):
    found = naive(text, words)
    covered = {k for i, n in found for k in range(i, i + n)}
    rest = [(i, 1) for i, c in enumerate(text) if i not in covered and not c.isspace()]
    return [text[i:i + n] for i, n in sorted(found + rest)], len(rest)


def test_automaton_equals_naive_search():
    rng = random.Random(1)
    for _ in range(300):
        words = {"".join(rng.choice("ab中") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 12))}
        text = "".join(rng.choice("ab中 c") for _ in range(rng.randint(0, 60)))
        assert D.Automaton(words).occurrences(text) == naive(text, words)


def test_both_ways_equal_naive_cut(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(30)] + ["清华", "清华大学", "华大", "大学", "", None, "abca", "abca"]
    texts = [None, "", " \t", "我来到清华大学", "清华大学"] + ["".join(rng.choice("abcd 清华大学") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    lines = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    table = spark.createDataFrame([(w,) for w in words], "word string")
    want = {i: naive_cut(t or "", {w for w in words if w}) for i, t in enumerate(texts)}
    for budget in (D.DEFAULT_BUDGET, 20):
        got = {r["n"]: (list(r["tokens"]), r["rest"]) for r in D.text_to_tokens(lines, table, budget).collect()}
        assert got == want
    assert want[3][0] == ["我", "来", "到", "清华", "清华大学", "华大", "大学"]


def test_empty_dictionary_and_empty_table(spark):
    lines = spark.createDataFrame([(1, "a b"), (2, None)], "n int, text string")
    none = spark.createDataFrame([], "word string")
    got = {r["n"]: (list(r["tokens"]), r["rest"]) for r in D.text_to_tokens(lines, none).collect()}
    assert got == {1: (["a", "b"], 2), 2: ([], 0)}
    assert D.text_to_tokens(lines.limit(0), spark.createDataFrame([("a",)], "word string")).collect() == []


def test_dealt_lines_travel_once(spark):
    """As many buckets as characters would be needed; long words, long runs, odd characters and other columns."""
    r = random.Random(5)
    words = {"".join(r.choice("ab-]^\\é😀") for _ in range(r.randrange(1, 40))) for _ in range(1500)} | {"a" * 300}
    texts = ["".join(r.choice("ab-]^\\é😀 x\t") for _ in range(r.randrange(0, 80))) for _ in range(60)]
    texts += ["".join(r.choice("ab") for _ in range(1500)), "a" * 700, "", "xx"]
    d = spark.createDataFrame([(w,) for w in words], "word string")
    lines = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    out = D.occurrences(lines, d, budget=1)
    assert out.columns == ["id", "text", "found"]
    longest = max(map(len, words))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "sequence(0," not in plan              # no line is sent past every bucket
    for row in out.collect():
        t = texts[row["id"]]
        want = [(i, n) for i in range(len(t)) for n in range(1, min(longest, len(t) - i) + 1) if t[i:i + n] in words]
        assert row["text"] == t and [(f["start"], f["length"]) for f in row["found"]] == want


def test_dealt_way_with_small_blocks(spark, monkeypatch):
    """Equal rows are one, words with one long beginning are told apart, and a block gets the words that it has."""
    monkeypatch.setattr(D, "BLOCK", 40)
    r = random.Random(8)
    words = {"abcdefghijklmnopq" + x for x in ("r", "s", "rs", "rst")} | {"ab", "中文", "qrs", "a", "pqrst"} | {"".join(r.choice("ab中文é") for _ in range(r.randint(1, 5))) for _ in range(40)}
    texts = ["abcdefghijklmnopqrst abcdefghijklmnopq", "中文 abcdefghijklmnopqs", "x", ""] + ["".join(r.choice("ab中文é -") for _ in range(r.randint(0, 50))) for _ in range(60)]
    rows = list(enumerate(texts)) + [(0, texts[0]), (9, texts[9]), (9, texts[9])]
    table = spark.createDataFrame([(w,) for w in words], "word string")
    got = D.text_to_tokens(spark.createDataFrame(rows, "n int, text string").repartition(2), table, 1).collect()
    assert sorted(x["n"] for x in got) == list(range(len(texts)))
    for x in got:
        assert (list(x["tokens"]), x["rest"]) == naive_cut(texts[x["n"]], words)


def test_one_python_pass_makes_the_tokens(spark):
    """What is found does not go to the JVM and back, word by word, before it becomes tokens."""
    lines = spark.createDataFrame([(1, "abab")], "n int, text string")
    for budget in (D.DEFAULT_BUDGET, 1):
        plan = D.text_to_tokens(lines, spark.createDataFrame([("ab",), ("ba",)], "word string"), budget)._jdf.queryExecution().optimizedPlan().toString()
        assert "EvalPython" not in plan


def test_distinct_lines_are_shuffled_once(spark, monkeypatch):
    """Only rows of repeated hashes travel to find equal rows; a block's words travel, not its pieces with all that is found in them."""
    plans, written = {}, D._written
    monkeypatch.setattr(D, "_written", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and written(df, name))
    lines = spark.createDataFrame([(i, f"ab {i} ba") for i in range(50)], "n int, text string")
    out = D.occurrences(lines, spark.createDataFrame([("ab",), ("ba",)], "word string"), 1)
    assert "Aggregate" not in plans["cut-lines"] and "Join" not in plans["cut-lines"]
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["n"] for r in out.collect()) == list(range(50))
