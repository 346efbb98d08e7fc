"""Hard negatives for anchors by exact Strassen products and mergeable heaps.

Vectors become integers (:func:`tiles.integer_vectors`). Anchors and rows are compared in tiles
(:mod:`tiles`): a task holds one bounded group of anchors and streams one slice of the rows.

1. *Products.* The scores of a block of anchors and rows are one matrix product by Strassen's recursion on
   int64 (:func:`strassen`): odd sizes get a row or column of zeros, seven half-size products and exact
   integer additions replace eight. Blocks with a side of ``LEAF`` or less are multiplied directly:
   in doubles where all sums stay below 2**53, which is exact, else in int64.
2. *Positives.* Rows of a tile come by label, so an anchor only meets rows of its label; a heap
   per anchor keeps the ``k`` best. Heaps of different slices merge by adding their entries.
3. *Negatives.* With its positives known, an anchor meets all rows; one heap per positive keeps the
   ``k`` best rows of other labels whose score lies in the positive's window, merged alike.

The windows need the positives of all slices, so the rows are streamed twice.

Defined results: rows with a null label, id or vector, with null or non-finite components or a squared integer
length of 2**62 or more take no part; of two vectors of different lengths the shorter counts as
followed by zeros. An anchor's own id is never among its positives. A repeated row counts as often as it
occurs; an anchor id that occurs in different rows is taken once, with the smallest (label, bytes of
the vector). No positive, or a negative positive's score (its window is empty), gives no rows; an empty
table gives none; extra columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textvault.llm import tiles as T
from textvault.llm.shared import stored

LEAF = 32                 # side at which the recursion ends
BLOCK = 512               # anchors multiplied together
ROWS = 2048               # rows multiplied together

ORACLE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS z FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.z, c.z)::BIGINT AS score
           FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
     p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same),
     w AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
                  row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS n
           FROM p JOIN s ON p.n <= 5 AND s.anchor_id = p.anchor_id AND NOT s.same
                        AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id::BIGINT AS anchor_id, positive_id::BIGINT AS positive_id, n::INT AS rank, negative_id::BIGINT AS negative_id,
       positive_score, negative_score FROM w WHERE n <= 5
"""


def direct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact product of int64 matrices (modulo 2**64, as all int64 sums)."""
    if not a.size or not b.size:
        return np.zeros((a.shape[0], b.shape[1]), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < 2.0 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Product of int64 matrices by Strassen's recursion, padded with zeros where a side is odd."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return direct(a, b)
    if m % 2 or k % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    h, i, j = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    out = np.empty((2 * h, 2 * j), np.int64)
    c11, c12, c21, c22 = out[:h, :j], out[:h, j:], out[h:, :j], out[h:, j:]
    p = strassen(a11 + a22, b11 + b22, leaf)
    c11[:], c22[:] = p, p
    p = strassen(a21 + a22, b11, leaf)
    c21[:] = p
    c22 -= p
    p = strassen(a11, b12 - b22, leaf)
    c12[:] = p
    c22 += p
    p = strassen(a22, b21 - b11, leaf)
    c11 += p
    c21 += p
    p = strassen(a11 + a12, b22, leaf)
    c11 -= p
    c12 += p
    c22 += strassen(a21 - a11, b11 + b12, leaf)
    c11 += strassen(a12 - a22, b21 + b22, leaf)
    return out[:m, :n]


def find_positives(held: pa.RecordBatch, k: int, width: int):
    """The work of a tile in the first pass."""
    order = np.argsort(held.column("label").to_numpy(), kind="stable")
    label, ids = held.column("label").to_numpy()[order], held.column("id").to_numpy()[order]
    anchors = T.matrix(held.column("vec"), width)[order]
    best = T.Best(len(ids), k)

    def step(batch: pa.RecordBatch | None):
        if batch is None:
            slot, score, found = best.entries()
            return [pa.RecordBatch.from_arrays([pa.array(ids[slot]), pa.array(found), pa.array(score)], ["anchor_id", "positive_id", "score"])]
        labels = batch.column("label").to_numpy()             # ascending in a tile
        cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            a, z = np.searchsorted(label, labels[lo], "left"), np.searchsorted(label, labels[lo], "right")
            for at in range(lo, hi if z > a else lo, ROWS):
                part = batch.slice(at, min(ROWS, hi - at))
                rows, rid = T.matrix(part.column("vec"), width).T, part.column("id").to_numpy()
                for q in range(a, z, BLOCK):
                    to = min(z, q + BLOCK)
                    score = strassen(anchors[q:to], rows)
                    i, j = np.nonzero((score >= best.floor[q:to, None]) & (ids[q:to, None] != rid[None]))
                    best.add(q + i, score[i, j], rid[j])

    return step


def find_negatives(held: pa.RecordBatch, k: int, width: int):
    """The work of a tile in the second pass; a slot is a positive of an anchor."""
    label, ids = held.column("label").to_numpy(), held.column("id").to_numpy()
    anchors, goals = T.matrix(held.column("vec"), width), held.column("goals")
    count = goals.value_lengths().to_numpy()
    goal, first = goals.flatten().to_numpy(), np.cumsum(count) - count
    best = T.Best(len(goal), k)
    best.floor = goal - goal // 5                             # 0.8 of a score, rounded up

    def step(batch: pa.RecordBatch | None):
        if batch is None:
            slot, score, found = best.entries()
            who = np.repeat(np.arange(len(ids)), count)[slot]
            return [pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array((slot - first[who]).astype(np.int32)), pa.array(found), pa.array(score)],
                                               ["anchor_id", "place", "negative_id", "negative_score"])]
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            rows, rid, rlabel = T.matrix(part.column("vec"), width).T, part.column("id").to_numpy(), part.column("label").to_numpy()
            for q in range(0, len(ids), BLOCK):
                score = strassen(anchors[q:q + BLOCK], rows)
                other = label[q:q + BLOCK, None] != rlabel[None]
                for place in range(int(count[q:q + BLOCK].max(initial=0))):
                    who = np.flatnonzero(count[q:q + BLOCK] > place)
                    slot = first[q + who] + place
                    s = score[who]
                    i, j = np.nonzero(other[who] & (s <= goal[slot][:, None]) & (s >= best.floor[slot][:, None]))
                    best.add(slot[i], s[i, j], rid[j])

    return step


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` and ``anchors`` have ``vec_id``, ``label`` and ``embedding``. A negative's score is at least 0.8 times
    the positive's and at most the positive's.
    """
    spark = rows.sparkSession
    typed = lambda df: df.filter("label is not null").withColumn("vec_id", F.col("vec_id").cast("long")).withColumn("label", F.col("label").cast("long"))
    ints = stored(T.integer_vectors(typed(rows), ["vec_id", "label"]), "negatives-rows")
    asked = stored(T.integer_vectors(typed(anchors), ["vec_id", "label"]).groupBy(F.col("vec_id").alias("id"))
                   .agg(F.min(F.struct("label", "vec")).alias("m")).select("id", "m.*"), "negatives-anchors")
    sizes = [df.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("vec")).alias("bytes")).first() for df in (ints, asked)]
    if not sizes[0]["n"] or not sizes[1]["n"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width = max(1, *[s["bytes"] // 4 for s in sizes])
    n_slices = T.slices(sizes[0]["n"], spark.sparkContext.defaultParallelism)
    n_groups = T.groups(sizes[1]["n"], width)
    none = F.lit(None).cast("array<bigint>")
    spread = (ints.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(n_slices)).cast("int"))
              .withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
              .select((F.col("group") * n_slices + F.col("slice")).alias("tile"), F.col("vec_id").alias("id"), "label", "vec", none.alias("goals")))

    def tiles(queries: DataFrame, order: list, schema: str, work) -> DataFrame:
        sent = (queries.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(n_groups)).cast("int"))
                .withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))))
                .select((F.col("group") * n_slices + F.col("slice")).alias("tile"), "id", "label", "vec", "goals"))
        return T.each_tile(sent, spread, n_slices * n_groups, order, schema, work)

    found = tiles(asked.withColumn("goals", none), ["label"], "anchor_id long, positive_id long, score long",
                  lambda held: find_positives(held, positives, width))
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    kept = stored(found.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < positives), "negatives-positives")
    goals = kept.groupBy(F.col("anchor_id").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("goals"))
    met = tiles(asked.join(goals, "id"), [], "anchor_id long, place int, negative_id long, negative_score long",
                lambda held: find_negatives(held, negatives, width))
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    best = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return (best.join(kept, ["anchor_id", "place"])
            .select("anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score"))
