"""Versioned store, incremental sync invariants and the streaming folder sync."""
import os
import tempfile

from pyspark.sql import functions as F

from textvault.operators.store import KnowledgeStore, upsert, delete_by_keys
from textvault.plans import build as B
from textvault.plans import sync as SY
from textvault.sources import tables as TB
from textvault.streaming import folder_changes as FC
from textvault.streaming import folder_sync

SF = "/root/testdata/sf0.001"


def test_upsert_replaces_by_key(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    upd = spark.createDataFrame([("b", 20), ("c", 30)], "k string, v int")
    got = sorted(tuple(r) for r in upsert(base, upd, "k").collect())
    assert got == [("a", 1), ("b", 20), ("c", 30)]
    assert sorted(r.k for r in delete_by_keys(base, upd.select("k"), "k").collect()) == ["a"]


def test_sync_twice_is_unchanged_and_store_versions(spark):
    root = tempfile.mkdtemp(prefix="tv-store-")
    store = KnowledgeStore(spark, root)
    old, new = TB.snapshots(spark, SF)
    old, new = B.preprocess(old), B.preprocess(new)
    v1, _ = SY.sync_store(store, old, B.BuildParams())
    assert v1 == 1 and store.current_version() == 1
    v2, st = SY.sync_store(store, new, B.BuildParams())
    assert v2 == 2
    kinds = {r.status for r in st.select("status").distinct().collect()}
    assert {"new", "deleted", "changed", "unchanged"} <= kinds
    # running the same listing again changes nothing and commits nothing
    v3, st3 = SY.sync_store(store, new, B.BuildParams())
    assert v3 == 2 and {r.status for r in st3.select("status").distinct().collect()} == {"unchanged"}
    assert store.files().count() == new.count()
    # chunk keys stay unique after the upsert
    c = store.chunks()
    n = c.count()
    assert n == c.select("filename_md5_no").distinct().count()
    want = B.chunk_rows(new, B.BuildParams(), embed=False).select("filename_md5_no", "chunk_md5")
    assert c.select("filename_md5_no", "chunk_md5").exceptAll(want).count() == 0 and n == want.count()
    # other chunk parameters: every file is chunked anew
    small = B.BuildParams(chunk_size=60)
    v4, _ = SY.sync_store(store, new, small)
    assert v4 == 3 and KnowledgeStore(spark, root).note()["params"] == small.fingerprint()
    want = B.chunk_rows(new, small, embed=False).select("filename_md5_no", "chunk_md5")
    got = store.chunks().select("filename_md5_no", "chunk_md5")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    # a listing without any file empties the store
    SY.sync_store(store, new.limit(0), small)
    assert store.files().count() == 0 and store.chunks().count() == 0


def test_only_touched_buckets_are_rewritten(spark):
    root = tempfile.mkdtemp(prefix="tv-buckets-")
    store = KnowledgeStore(spark, root, buckets=16)
    docs = spark.createDataFrame([(f"f{i}.txt", f"text number {i}. more of it.") for i in range(40)], "filename string, text string")
    SY.sync_store(store, docs, B.BuildParams())
    names = lambda: {os.path.join(d, x) for d, _, xs in os.walk(root) for x in xs if x.endswith(".parquet")}
    before = names()
    changed = docs.withColumn("text", F.when(F.col("filename") == "f7.txt", "new text.").otherwise(F.col("text")))
    SY.sync_store(store, changed, B.BuildParams())
    touched = {os.path.dirname(x) for x in names() ^ before}
    assert len(touched) == 2                                  # one bucket of files, one of chunks
    assert {r.filename: r.text for r in store.files().collect()}["f7.txt"] == "new text."


def _write(folder, name, data):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as fh:
        fh.write(data)


def test_stream_folder_sync(spark):
    folder, root, ck = (tempfile.mkdtemp(prefix=f"tv-{x}-") for x in ("src", "kb", "ck"))
    _write(folder, "f0.txt", b"First file. It has two sentences.")
    _write(folder, "f1.txt", b"Second\nfile text")
    _write(folder, "f2.html", b"<html><b>x</b>y</html>")
    _write(folder, "bad.txt", b"\xff\xfe\xfa")
    _write(folder, "a/same.txt", b"one of two.")
    _write(folder, "b/same.txt", b"two of two.")
    _write(folder, "p.pdf", b"page text.")

    def run():
        folder_sync.start(spark, folder, root, ck, B.BuildParams()).awaitTermination(120)
        store = KnowledgeStore(spark, root)
        return store, {r.filename: r.text for r in store.files().collect()}

    store, files = run()
    assert len(files) == 7 and files["f0.txt"] == "First file. It has two sentences."
    assert files["a/same.txt"] == "one of two." and files["b/same.txt"] == "two of two." and files["p.pdf"] == "page text."
    assert files["f2.html"] == "xy" and files["bad.txt"] == ""
    assert store.chunks().filter(F.col("filename") == "f1.txt").count() == 1
    # a second batch: a new path
    _write(folder, "f0b.txt", b"Added later.")
    store, files = run()
    assert len(files) == 8 and files["f0b.txt"] == "Added later."
    assert store.files().count() == store.files().select("filename_md5").distinct().count()
    # a third: new contents of a known path, a removal, and a new file
    _write(folder, "a/same.txt", b"changed text. longer than before.")
    os.remove(os.path.join(folder, "f1.txt"))
    _write(folder, "c/f9.txt", b"new again.")
    store, files = run()
    assert len(files) == 8 and "f1.txt" not in files and files["c/f9.txt"] == "new again."
    assert files["a/same.txt"] == "changed text. longer than before." and files["b/same.txt"] == "two of two."
    assert store.chunks().filter(F.col("filename") == "a/same.txt").count() == 1
    assert store.chunks().filter(F.col("filename") == "f1.txt").count() == 0
    # nothing changes: no batch, no commit
    v = store.current_version()
    store, again = run()
    assert store.current_version() == v and again == files
    # a replayed batch is skipped
    epoch = int(store.note()["epoch"])
    batch = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    assert folder_sync.upsert_batch(store, batch, B.BuildParams(), folder, epoch) is None
    # a listing of files is a batch of its own
    one = spark.read.format("binaryFile").load(os.path.join(folder, "f0.txt"))
    assert folder_sync.upsert_batch(store, one, B.BuildParams(), folder, epoch + 1) == v + 1
    # other chunk parameters in a batch are noted, so that the next sync chunks anew
    folder_sync.upsert_batch(store, one, B.BuildParams(chunk_size=60), folder, epoch + 2)
    docs = folder_sync.documents_of(batch, folder)
    _, st = SY.sync_store(store, docs, B.BuildParams())
    assert {r.status for r in st.collect()} == {"unchanged"} and store.note()["params"] == B.BuildParams().fingerprint()
    want = B.chunk_rows(docs, B.BuildParams(), embed=False).select("filename_md5_no", "chunk_md5")
    assert store.chunks().select("filename_md5_no", "chunk_md5").exceptAll(want).count() == 0


def test_listings_and_changes():
    folder, state = tempfile.mkdtemp(prefix="tv-src-"), tempfile.mkdtemp(prefix="tv-state-")
    reader = FC.FolderReader({"path": f"file://{folder}", "state": state, "files": "2"})
    assert reader.latestOffset() == {"listing": 0} == reader.initialOffset()
    for i in range(5):
        _write(folder, f"x{i}.txt", b"x" * i)
    _write(folder, "_temporary.txt", b"no file of the folder")
    assert reader.latestOffset() == {"listing": 1} == reader.latestOffset()
    parts = reader.partitions({"listing": 0}, {"listing": 1})
    assert [len(p.rows) for p in parts] == [2, 2, 1]
    rows = [r for p in parts for r in reader.read(p)]
    assert [(os.path.basename(r[0]), r[1], r[4]) for r in rows] == [(f"x{i}.txt", "new", b"x" * i) for i in range(5)]
    os.remove(os.path.join(folder, "x1.txt"))
    _write(folder, "x2.txt", b"other length")
    assert reader.latestOffset() == {"listing": 2}
    rows = [r for p in reader.partitions({"listing": 1}, {"listing": 2}) for r in reader.read(p)]
    assert [(os.path.basename(r[0]), r[1]) for r in rows] == [("x1.txt", "removed"), ("x2.txt", "changed")] and rows[0][4] is None
    # a file that goes before it is read
    os.remove(os.path.join(folder, "x2.txt"))
    assert [r[1] for p in reader.partitions({"listing": 1}, {"listing": 2}) for r in reader.read(p)] == ["removed", "removed"]
    reader.commit({"listing": 2})
    assert sorted(os.listdir(state)) == ["listing-0000000001.json", "listing-0000000002.json"]
