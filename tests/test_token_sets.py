import random

import pytest

from textvault.operators import token_sets as S


def jaccard(a, b):
    a, b = ({t for t in x or [] if t is not None} for x in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def data(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(n):
        t = rng.choices(words, [1 / (k + 1) for k in range(40)], k=rng.randint(0, 9))
        if rows and rng.random() < 0.3:
            t = list(rng.choice(rows)[1] or [])          # copies
        rows.append((i, None if rng.random() < 0.03 else t))
    return rows


@pytest.mark.parametrize("seed, frequent", [(1, 200_000), (2, 3)])
def test_equals_all_pairs(spark, seed, frequent):
    rows, asked = data(seed, 200), data(seed + 10, 30) + [(900, ["nowhere"]), (901, ["w0", None]), (902, [])]
    sets = S.TokenSets(spark.createDataFrame(rows, "id long, tokens array<string>"), frequent=frequent)
    queries = spark.createDataFrame(asked, "query_id long, tokens array<string>")
    for t in (0.2, 0.8):
        want = sorted((q, i, round(1 - jaccard(a, b), 9)) for q, a in asked for i, b in rows if jaccard(a, b) >= t)
        assert sorted((r[0], r[1], round(r[2], 9)) for r in sets.within(queries, t).collect()) == want
    want = []
    for q, a in asked:
        best = sorted((round(1 - jaccard(a, b), 9), i) for i, b in rows)[:7]
        want += [(q, i, d, k + 1) for k, (d, i) in enumerate(best)]
    got = sorted((r[0], r[1], round(r[2], 9), r[3]) for r in sets.topk(queries, 7).collect())
    assert got == sorted(want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, tokens array<string>")
    asked = spark.createDataFrame([(1, ["a"]), (2, [])], "query_id long, tokens array<string>")
    assert S.TokenSets(none).topk(asked, 3).collect() == [] and S.TokenSets(none).within(asked, 0.5).collect() == []
    rows = S.TokenSets(spark.createDataFrame([(1, ["a"]), (2, None)], "id long, tokens array<string>"))
    assert rows.topk(asked.limit(0), 3).collect() == []
    assert sorted(tuple(r) for r in rows.topk(asked, 3).collect()) == [(1, 1, 0.0, 1), (1, 2, 1.0, 2), (2, 1, 1.0, 2), (2, 2, 0.0, 1)]


def test_the_prefix_leaves_out_frequent_tokens(spark):
    rows = [(i, ["the", "of", "and", f"rare{i}", f"odd{i}"]) for i in range(50)]
    sets = S.TokenSets(spark.createDataFrame(rows, "id long, tokens array<string>"))
    used = sets.sets.select(S.F.explode(S._prefix(S.F.col("tokens"), 0.8)).alias("t")).distinct()
    assert not {"the", "of", "and"} & {r["t"] for r in used.collect()}
    with pytest.raises(ValueError):
        sets.within(sets.sets, 0)
