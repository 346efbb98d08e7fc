import random
import zlib
from collections import defaultdict

import pytest

from textvault.llm import sharding as S

SF = "/root/testdata/sf0.001"


def best(sizes, k):
    """Smallest largest run by plain search over the capacities."""
    low, high = max([*sizes, 0]), sum(sizes)
    while low < high:
        c, n, room = (low + high) // 2, 1, 0
        for s in sizes:
            if room + s > c:
                n, room = n + 1, 0
            room += s
        low, high = (low, c) if n <= k else (c + 1, high)
    return low


def groups_of(docs):
    by = defaultdict(list)
    for d, t in docs:
        by[t or ""].append(d)
    first = lambda v: min((x for x in v if x is not None), default=None)
    return sorted(by.items(), key=lambda g: ((f := first(g[1])) is not None, f or 0))


def check(rows, docs, k=8):
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == sorted(
        (d or 0, size(t), zlib.crc32((t or "").encode())) for d, t in docs)
    slots, total = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        total[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < k
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    shard = {(r["size"], r["text_crc32"]): r["shard"] for r in rows}
    order = groups_of(docs)
    placed = [shard[(size(t), zlib.crc32(t.encode()))] for t, _ in order]
    assert placed == sorted(placed)                                   # runs of the order
    assert len({(r["size"], r["text_crc32"], r["shard"]) for r in rows}) == len(order)   # groups are whole
    assert max(total.values(), default=0) == best([size(t) * len(v) for t, v in order], k)


def test_whole_table(spark):
    import __spark_entry__ as E
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(E.queries()["op8_minimax_sharding"](spark, SF).collect(), docs)


def test_edges(spark):
    schema = "doc_id long, text string, size string, shard int, key int, slot int"
    docs = [(5, "a"), (2, None), (2, None), (None, "b" * 500), (7, ""), (9, "c"), (1, "c")]
    df = spark.createDataFrame([(*d, "x", 3, 1, 0) for d in docs], schema)
    check(S.shard(df).collect(), docs)
    assert S.shard(df.limit(0)).count() == 0
    hot = [(i, "hot" if i % 3 == 0 else f"t{i}" * (i % 5 + 1)) for i in range(200)]
    check(S.shard(spark.createDataFrame(hot, "doc_id long, text string")).collect(), hot)


@pytest.mark.parametrize("seed", range(3))
def test_refinement_is_exact(spark, monkeypatch, seed):
    """Few blocks, so that several rounds of opening are needed."""
    monkeypatch.setattr(S, "BLOCKS", 7)
    monkeypatch.setattr(S, "INNER", 3)
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, rng.randint(1, 1000)]) for _ in range(rng.randint(1, 400))]
    df = spark.createDataFrame([(f"{i:05d}", s) for i, s in enumerate(sizes)], "key string, bytes long").orderBy("key")
    cuts, _, capacity = S.minimax(S.stored(S.summed(df), "t"), 8)
    assert capacity == best(sizes, 8)
    ends = {0}
    for s in sizes:
        ends.add(max(ends) + s)
    assert set(cuts) <= ends and cuts[-1] == sum(sizes)
    assert max(b - a for a, b in zip([0, *cuts], cuts, strict=False)) == capacity
