"""Exact top-k inner products: rows by descending length, SVD-rotated partial sums, residual bounds.

Vectors become integers (:func:`tiles.integer_vectors`), so scores are exact longs.

1. *Rotation.* The Gram matrix of all rows is summed up in the tasks; its eigenvectors (the right
   singular vectors of the table) rotate a vector so that the first coordinates hold most of its
   length. Only the first ``ROTATED`` components are rotated, the others always count as residual.
2. *Slices.* Rows are cut into slices of descending length by quantiles of the length; a slice with
   more than its share of equal lengths is dealt over several of the same bound.
3. *First wave.* Every query meets the longest slice, which gives it a k-th best score.
4. *Second wave.* A query visits the further slices as long as its length times the slice's
   largest length reaches that score (Cauchy-Schwarz); lengths descend, so that is a prefix of the
   slices. Inside a tile rows come by descending length: a query is done when length times length
   is below its k-th best. For the others partial sums over the first rotated coordinates, plus the
   product of the residual lengths, must reach it, at two levels; what is left is computed exactly
   in integers. Rounding of the bounds is covered by a slack; the scores have none.

A task holds one bounded group of queries and streams one slice (:mod:`tiles`). The driver sees
the Gram matrix (at most ``ROTATED`` squared numbers) and one number per slice and per query group.

Defined results: vectors null or holding null or non-finite components take no part, nor do null ids
and vectors with a squared integer length of 2**62 or more; zero and empty vectors do (score 0); of two
vectors of different lengths the shorter counts as followed by zeros. A query's own id is no
candidate. A repeated row is a candidate as often as it occurs; a query id that occurs with several
vectors is searched once, with the smallest by its bytes. Ties go to the smaller id, fewer candidates
give fewer rows, an empty table gives none; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textvault.llm import tiles as T
from textvault.llm.shared import stored

ROTATED = 128
ENERGY = (0.5, 0.8)       # of the squared lengths, which the two levels of partial sums hold
ROWS = 2048               # rows compared together
QUERIES = 512             # queries compared together
SLACK = 1e-9              # of the product of lengths, for the rounding of bounds

ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS z FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.z, c.z)::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id::BIGINT AS query_id, n::INT AS rank, vec_id::BIGINT AS vec_id, score FROM r WHERE n <= 5
"""


def rotation(rows: DataFrame, width: int) -> tuple[np.ndarray, list[int]]:
    """Orthogonal matrix whose columns have descending energy, and how many of them the levels take."""
    d = min(width, ROTATED)
    cell = np.arange(d * d)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((d, d))
        for b in batches:
            x = T.matrix(b.column(0), width)[:, :d].astype(np.float64)
            gram += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(gram.ravel())], ["cell", "value"])

    total = rows.select("vec").mapInArrow(sums, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    gram = np.zeros(d * d)
    for r in total:
        gram[r["cell"]] = r["value"]
    values, columns = np.linalg.eigh(gram.reshape(d, d))
    values, columns = np.maximum(values[::-1], 0), columns[:, ::-1]
    share = np.cumsum(values) / max(values.sum(), 1e-300)
    levels = [min(d, int(np.searchsorted(share, e)) + 1) for e in ENERGY]
    return np.ascontiguousarray(columns[:, :levels[-1]]), levels


class Partial:
    """Integer vectors with their first rotated coordinates, lengths and residual lengths per level."""

    def __init__(self, vec, norm2, width: int, columns: np.ndarray, levels: list[int]):
        self.whole = T.matrix(vec, width)
        self.first = self.whole[:, :len(columns)].astype(np.float64) @ columns
        self.norm2 = norm2.to_numpy().astype(np.float64)
        self.length = np.sqrt(self.norm2)
        self.rest = [np.sqrt(np.maximum(self.norm2 - (self.first[:, :n] ** 2).sum(1), 0)) for n in levels]


def compare(held: pa.RecordBatch, k: int, width: int, columns: np.ndarray, levels: list[int]):
    """The work of a tile, for :func:`tiles.each_tile`."""
    q, qid = Partial(held.column("vec"), held.column("norm2"), width, columns, levels), held.column("id").to_numpy()
    best = T.Best(len(qid), k)
    best.floor = np.maximum(best.floor, held.column("floor").to_numpy())
    cuts = list(zip([0, *levels[:-1]], levels, strict=True))

    def against(rows: Partial, ids: np.ndarray) -> None:
        longest = float(rows.length.max())
        live = np.flatnonzero(q.length * longest * (1 + SLACK) >= best.floor)          # rows descend: the others are done
        for a in range(0, len(live), QUERIES):
            who = live[a:a + QUERIES]
            floor = best.floor[who].astype(np.float64)[:, None]
            slack = SLACK * q.length[who][:, None] * rows.length[None]
            part = np.zeros((len(who), len(ids)))
            for level, (lo, hi) in enumerate(cuts):
                part += q.first[who, lo:hi] @ rows.first[:, lo:hi].T
                may = part + q.rest[level][who][:, None] * rows.rest[level][None] + slack >= floor
                if not may.any():
                    break
            i, j = np.nonzero(may)
            for c in range(0, len(i), 1 << 16):
                x, y = who[i[c:c + (1 << 16)]], j[c:c + (1 << 16)]
                other = qid[x] != ids[y]
                x, y = x[other], y[other]
                score = (q.whole[x] * rows.whole[y]).sum(1)
                enters = score >= best.floor[x]
                best.add(x[enters], score[enters], ids[y[enters]])

    def step(batch: pa.RecordBatch | None):
        if batch is None:
            slot, score, ids = best.entries()
            return [pa.RecordBatch.from_arrays([pa.array(qid[slot]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])]
        for a in range(0, batch.num_rows, ROWS):
            b = batch.slice(a, ROWS)
            against(Partial(b.column("vec"), b.column("norm2"), width, columns, levels), b.column("id").to_numpy())

    return step


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def cut_by_length(rows: DataFrame, n: int) -> tuple[DataFrame, list[float]]:
    """``rows`` with ``slice``, numbered by descending length, and the largest squared length of each slice."""
    want = T.slices(n, rows.sparkSession.sparkContext.defaultParallelism)
    shares = [1 - i / want for i in range(1, want)]
    bounds = rows.agg(F.percentile_approx("norm2", shares, 20 * want).alias("b")).first()["b"] if shares else []
    bounds = sorted(set(bounds), reverse=True)
    length_class = F.size(F.filter(F.array(*[F.lit(int(b)) for b in bounds]), lambda b: b > F.col("norm2"))) if bounds else F.lit(0)
    rows = rows.withColumn("class", length_class.cast("int"))
    counts = rows.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("most")).orderBy("class").collect()
    number, most = [], []
    for c in counts:
        parts = -(-2 * c["n"] * want // (3 * n))              # shares of one and a half at most
        number.append((c["class"], len(most), parts))
        most += [float(c["most"])] * parts
    parts = rows.sparkSession.createDataFrame(number, "class int, base int, parts int")
    at = (F.col("base") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int")
    return rows.join(F.broadcast(parts), "class").withColumn("slice", at).drop("class", "base", "parts"), most


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of every query, over all rows of ``vectors``.

    Both have ``vec_id`` and ``embedding``.
    """
    spark = vectors.sparkSession
    with_id = lambda df: df.withColumn("vec_id", F.col("vec_id").cast("long"))
    rows = stored(T.integer_vectors(with_id(vectors), ["vec_id"]), "topk-rows")
    asked = stored(T.integer_vectors(with_id(queries), ["vec_id"]).groupBy(F.col("vec_id").alias("id"))
                   .agg(F.min(F.struct("vec", "norm2")).alias("m")).select("id", "m.*"), "topk-queries")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("vec")).alias("bytes")).first()
    asked_size = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("vec")).alias("bytes")).first()
    if not size["n"] or not asked_size["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, size["bytes"] // 4, asked_size["bytes"] // 4)
    columns, levels = rotation(rows, width)
    rows, most = cut_by_length(rows, size["n"])
    n_groups = T.groups(asked_size["n"], width)
    grouped = asked.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(n_groups)).cast("int"))
    work = lambda held: compare(held, k, width, columns, levels)
    found_schema, order = "query_id long, vec_id long, score long", [F.desc("norm2"), F.col("id")]

    def wave(visits: DataFrame, of_slice: DataFrame, tiles: int) -> DataFrame:
        some = of_slice.select("tile", F.col("vec_id").alias("id"), "vec", "norm2", F.lit(0).cast("long").alias("floor"))
        return T.each_tile(visits.select("tile", "id", "vec", "norm2", "floor"), some, tiles, order, found_schema, work)

    everyone = F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))
    first = stored(wave(grouped.withColumn("tile", F.col("group")).withColumn("floor", F.lit(-T.LARGEST)),
                        rows.filter("slice = 0").withColumn("tile", everyone), n_groups), "topk-first")
    if len(most) == 1:
        return ranked(first, k)
    kth = ranked(first, k).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    lengths = F.array(*[F.lit(m ** 0.5) for m in most[1:]])
    reached = F.size(F.filter(lengths, lambda m: m * F.sqrt("norm2") * (1 + SLACK) >= F.col("floor")))
    going = stored(grouped.join(kth, "id", "left").fillna({"floor": -T.LARGEST}).withColumn("last", reached.cast("int")).filter("last > 0"), "topk-going")
    # groups in the order of how far they go: slice s is met by the first of them
    far = going.groupBy("group").agg(F.max("last").alias("last")).collect()
    far.sort(key=lambda r: -r["last"])
    if not far:
        return ranked(first, k)
    places = spark.createDataFrame([(r["group"], i) for i, r in enumerate(far)], "group int, place int")
    met = spark.createDataFrame([(s, sum(r["last"] >= s for r in far)) for s in range(1, len(most))], "slice int, met int")
    other = len(most) - 1
    visits = (going.join(F.broadcast(places), "group").withColumn("slice", F.explode(F.sequence(F.lit(1), F.col("last"))))
              .withColumn("tile", F.col("place") * other + F.col("slice") - 1))
    of_slice = (rows.join(F.broadcast(met.filter("met > 0")), "slice").withColumn("place", F.explode(F.sequence(F.lit(0), F.col("met") - 1)))
                .withColumn("tile", F.col("place") * other + F.col("slice") - 1))
    second = wave(visits, of_slice, len(far) * other)
    return ranked(first.unionByName(second), k)
