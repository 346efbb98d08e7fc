"""NULL texts, repeated names, key rules of the upsert, and a store that grows."""
import json
import os
import tempfile

from pyspark.sql import functions as F

from textvault.operators import store as ST
from textvault.plans import build as B
from textvault.plans import retrieve as R
from textvault.plans import sync as SY

ROWS = [("a.txt", None), ("b.txt", "one text."), ("b.txt", "another text."), ("b.txt", "one text."), ("c.txt", ""), (None, "nameless"), ("d.txt", "x; y=z")]


def listing(spark, rows):
    return spark.createDataFrame(rows, "filename string, text string")


def test_second_sync_finds_nothing_to_do(spark):
    store = ST.KnowledgeStore(spark, tempfile.mkdtemp(prefix="tv-edge-"))
    v1, st = SY.sync_store(store, listing(spark, ROWS), B.BuildParams())
    assert {(r["filename"], r["status"]) for r in st.collect()} == {(n, "new") for n in ("a.txt", "b.txt", "c.txt", "d.txt")}
    v2, st = SY.sync_store(store, listing(spark, ROWS[::-1]).repartition(3), B.BuildParams())
    assert v2 == v1 and {r["status"] for r in st.collect()} == {"unchanged"} and st.count() == 4
    files = {r["filename"]: r["text"] for r in store.files().collect()}
    assert store.files().count() == 4 and files["a.txt"] == "" and files["b.txt"] in ("one text.", "another text.")
    keys = store.chunks().select(ST.CHUNK_KEY)
    assert keys.count() == keys.distinct().count()
    # the text of one of the rows changes, and the NULL text appears
    rows = [(n, "first text") if n == "a.txt" else (n, t and t.replace("another", "some other")) for n, t in ROWS]
    _, st = SY.sync_store(store, listing(spark, rows), B.BuildParams())
    kinds = {r["filename"]: r["status"] for r in st.collect()}
    assert kinds["a.txt"] == "changed" and kinds["c.txt"] == kinds["d.txt"] == "unchanged"
    assert store.files().filter("filename = 'b.txt'").count() == 1


def test_empty_listing_first(spark):
    store = ST.KnowledgeStore(spark, tempfile.mkdtemp(prefix="tv-edge-"))
    SY.sync_store(store, listing(spark, []), B.BuildParams())
    assert store.files().collect() == [] and store.chunks().collect() == []
    SY.sync_store(store, listing(spark, ROWS), B.BuildParams())
    assert store.files().count() == 4


def test_upsert_keeps_one_row_a_key(spark):
    base = spark.createDataFrame([(1, "old", [0.0]), (2, "kept", None)], "k int, v string, e array<double>")
    new = spark.createDataFrame([(1, "b", [1.0]), (1, "a", [9.0]), (None, "no key", None), (3, None, None), (3, None, None)], "k int, v string, e array<double>")
    got = sorted((r["k"], r["v"], r["e"]) for r in ST.upsert(base, new, "k").collect())
    assert got == [(1, "b", [1.0]), (2, "kept", None), (3, None, None)]
    assert sorted(r["k"] for r in ST.upsert(base.select("k"), new.select("k"), "k").collect()) == [1, 2, 3]


def test_buckets_follow_the_size(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="tv-grow-")
    store = ST.KnowledgeStore(spark, root)
    docs = [(f"f{i}.txt", f"text number {i}. " * 5) for i in range(30)]
    SY.sync_store(store, listing(spark, docs), B.BuildParams())
    assert store.buckets == 1
    monkeypatch.setattr(ST, "BUCKET_CHARS", 400)
    SY.sync_store(store, listing(spark, docs + [("new.txt", "new")]), B.BuildParams())          # outgrown: dealt anew
    assert 4 < store.buckets == ST.KnowledgeStore(spark, root).buckets and store.files().count() == 31
    _, st = SY.sync_store(store, listing(spark, docs), B.BuildParams())
    assert store.files().count() == 30 and {r["status"] for r in st.collect()} == {"deleted", "unchanged"}
    # a search reads the texts of the hits' buckets alone
    queries = spark.createDataFrame([(1, "text number 7")], "query_id int, text string")
    files, hits = R.search_store(store, queries, 2, 2)
    assert files.count() == 2 and hits.count() == 2 and hits.first()["chunk"].startswith("text number")
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_notes_are_json_whatever_the_schema_says(spark):
    root = tempfile.mkdtemp(prefix="tv-note-")
    store = ST.KnowledgeStore(spark, root)
    docs = listing(spark, ROWS[:2])
    files = B.file_rows(SY.named(docs)).withMetadata("summary", {"comment": "a; b = c"})
    store.rebuild(files, B.chunk_rows(SY.named(docs)), params="1/2;3=4")
    assert ST.KnowledgeStore(spark, root).note()["params"] == "1/2;3=4" and store.files().count() == 2
    with open(os.path.join(root, "_commits", "1")) as fh:
        assert json.load(fh)["buckets"] == 1


def test_knowledge_of_an_empty_table(spark):
    kb = B.Knowledge.build(listing(spark, []), tempfile.mkdtemp(prefix="tv-none-"))
    assert kb.chunks().collect() == [] and kb.files().collect() == []
    qv = R.embed_queries(spark.createDataFrame([(1, "x")], "query_id int, text string"))
    assert R.chunk_hits(kb.chunks(True), qv, 3, buckets=kb.buckets).collect() == []
    again = B.Knowledge(spark, kb.path)
    assert again.buckets == 1 and again.chunks().select(F.col("chunk")).collect() == []
