"""Search against brute force; binary containers; folder listing; entry smoke."""
import os
import struct
import tempfile

import numpy as np
from pyspark.sql import functions as F

from textvault.operators import search as S
from textvault.sources import files as FS
from textvault.sources import tables as TB

SF = "/root/testdata/sf0.001"


def _brute(V, ids, Q, k, metric):
    out = {}
    for qi, q in enumerate(Q):
        if metric == "L2":
            d = ((V - q) ** 2).sum(1)
            key = np.round(d, 9)
        else:
            d = V @ q
            key = -np.round(d, 9)
        order = np.lexsort((ids, key))[:k]
        out[qi] = [int(ids[j]) for j in order]
    return out


def test_exact_topk_matches_brute_force_and_batching(spark):
    v = TB.vectors(spark, SF)
    rows = v.orderBy("id").collect()
    V = np.array([r.embedding for r in rows], dtype=np.float64)
    ids = np.array([r.id for r in rows])
    q = v.filter(F.col("label") == 0).select(F.col("id").alias("query_id"), "embedding")
    qrows = q.orderBy("query_id").collect()
    Q = np.array([r.embedding for r in qrows], dtype=np.float64)
    for metric in ["L2", "IP"]:
        want = _brute(V, ids, Q, 4, metric)
        # a tiny budget forces several query batches: same answer
        for budget in [S.DEFAULT_BROADCAST_BUDGET, 3000]:
            got = S.exact_topk(v, q, 4, metric, budget=budget).collect()
            by_q = {}
            for r in sorted(got, key=lambda r: (r.query_id, r.rk)):
                by_q.setdefault(r.query_id, []).append(r.id)
            for qi, r in enumerate(qrows):
                assert by_q[r.query_id] == want[qi], (metric, budget, r.query_id)


def test_container_records(spark):
    title = b"Intro".ljust(256, b"\0")
    rec = title + b"\0" * 24 + b"7".ljust(12, b"\0") + b"\0" * 12 + struct.pack("<i", 2)
    body = bytearray(b"CAJ\0" + b"\0" * 0x200)
    body[0x10:0x14] = struct.pack("<i", 3)
    body[0x110:0x114] = struct.pack("<i", 1)
    body += b""
    content = bytes(body[:0x114]) + rec
    df = spark.createDataFrame([(bytes(content),), (b"%PDF-1.4",), (b"\xc8\x00\x00\x00" + b"\0" * 8,)],
                               "content binary")
    h = FS.header_counts(df).select("fmt", "page_num", "toc_num").collect()
    assert [tuple(r) for r in h] == [("CAJ", 3, 1), ("PDF", 0, 0), ("C8", 0, 0)]
    toc = FS.output_toc(FS.toc_entries(df.limit(1))).select("title", "page", "level", "line").collect()
    assert [tuple(r) for r in toc] == [("Intro", 7, 2, "    Intro    7")]


def test_listing_sibling_preference(spark):
    root = tempfile.mkdtemp(prefix="tv-list-")
    os.makedirs(os.path.join(root, "sub"))
    for name in ["a.pdf", "a.caj", "b.caj", "c.txt", "sub/d.md"]:
        with open(os.path.join(root, name), "wb") as fh:
            fh.write(b"x")
    names = sorted(r.filename for r in FS.list_files(FS.read_folder(spark, root)).collect())
    assert names == ["a.pdf", "c.txt", "d.md"]


def test_sql_statements(spark):
    df = spark.createDataFrame([("CREATE TABLE a (x INT);\n ;CREATE TABLE b (y INT);  ",)], "text string")
    got = [r.stmt for r in FS.sql_statements(df).orderBy("stmt_no").collect()]
    assert got == ["CREATE TABLE a (x INT)", "CREATE TABLE b (y INT)"]


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert set(df.columns) == {"query_id", "rk", "filename", "chunk_no", "distance", "chunk_md5"}
    assert set(E.oracle_sql()) <= set(E.queries())
