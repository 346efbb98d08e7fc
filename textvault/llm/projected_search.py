"""Approximate nearest neighbours by stable projections and a kd-tree.

Vectors are scaled to length one, so the largest cosine is the smallest distance. A seeded
Gaussian (2-stable) matrix projects them to ``DIMS`` numbers: the squared projected
distance of a pair, divided by its true squared distance, is chi-square with ``DIMS``
degrees of freedom. Neighbours are visited in the order of their projected distance and
verified on the original vectors; the search stops when the chi-square test says that a
point nearer than the k-th best found so far would have been met with probability
``sure`` (:func:`reach` is that test solved for the distance).

The kd-tree has two levels. Its upper part is fitted on a bounded sample (``SAMPLE``
vectors with the smallest hashes) and cuts the space into cells, which are the unit of
distribution; *all* vectors are indexed, and cells get the bounding box of all of theirs.
A cell with more than ``CELL_ROWS`` rows is dealt over salts. In each cell the lower part is
built over its rows, with leaves of ``LEAF`` points.

A query first visits its home cell; with the k-th best from there it goes on to the cells
whose box the test does not exclude. A task holds one salted cell and streams the queries
against it in blocks, so memory is bounded by ``CELL_ROWS`` whatever the number of
queries. Rows with equal vectors are reduced to the ``k`` smallest ids before they
shuffle, batch by batch.

Defined results: null, zero, non-finite vectors, vectors with null components, null ids
and vectors whose length isn't the most frequent one take no part; a query's own id is
no candidate; a candidate id that occurs several times is reported once; ties go to the
smaller id; fewer candidates give fewer rows; an empty table gives none. A query id that
occurs with several vectors is searched with the smallest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textvault.llm.shared import stored

DIMS = 8
SAMPLE = 16_384
CELL_ROWS = 32_768      # rows of a salted cell
WANT_ROWS = 4_096       # rows a cell is meant to have, as long as there are fewer than MAX_CELLS
MAX_CELLS = 2_048
LEAF = 128
BLOCK = 256             # queries searched together in a cell
MORE = 3                # neighbours kept beyond k until scores are computed exactly


def chi_square(x: float) -> float:
    """Distribution function with DIMS (even) degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(DIMS // 2))


def reach(sure: float) -> float:
    """Squared projected distance per squared distance up to which the test lets a search go on."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid) < sure else (low, mid)
    return high


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1))[:, None]


def projection(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim, DIMS))


def split_tree(points: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """(dimension, value) of the inner nodes of a complete binary tree, as a heap."""
    nodes = [(0, 0.0)] * (leaves - 1)
    parts = {0: points}
    for k in range(leaves - 1):
        p = parts.pop(k)
        d = int((p.max(0) - p.min(0)).argmax()) if len(p) else 0
        value = float(np.median(p[:, d])) if len(p) else 0.0
        nodes[k] = (d, value)
        if 2 * k + 2 < leaves - 1:
            parts[2 * k + 1], parts[2 * k + 2] = p[p[:, d] < value], p[p[:, d] >= value]
    return nodes


def cell_of(points: np.ndarray, nodes: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(points), np.int64)
    if not nodes:
        return at
    dim, value = np.array([d for d, _ in nodes]), np.array([v for _, v in nodes])
    for _ in range(int(math.log2(len(nodes) + 1))):
        at = 2 * at + 1 + (points[np.arange(len(points)), dim[at]] >= value[at])
    return at - len(nodes)


def outside(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points to boxes."""
    gap = np.maximum(np.maximum(low[None] - q[:, None], q[:, None] - high[None]), 0)
    return (gap * gap).sum(2)


class Cell:
    """The rows of one salted cell under a kd-tree of leaves."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, matrix: np.ndarray):
        self.original = vectors
        self.ids, self.units = ids, unit(vectors)
        projected = self.units @ matrix
        parts, leaves = [np.arange(len(ids))], []
        while parts:
            p = parts.pop()
            spread = projected[p].max(0) - projected[p].min(0) if len(p) else np.zeros(DIMS)
            if len(p) <= LEAF or not spread.max() > 0:
                leaves += [p[k:k + LEAF] for k in range(0, len(p), LEAF)]
                continue
            order = p[np.argsort(projected[p, int(spread.argmax())], kind="stable")]
            parts += [order[:len(order) // 2], order[len(order) // 2:]]
        self.leaves = leaves
        self.low = np.array([projected[p].min(0) for p in leaves])
        self.high = np.array([projected[p].max(0) for p in leaves])

    def search(self, qid: np.ndarray, q: np.ndarray, matrix: np.ndarray, best: np.ndarray, k: int, far: float):
        """Per query the rows and approximate cosines of up to k + MORE neighbours.

        ``best`` is the squared distance of the k-th best known so far (inf if none).
        """
        keep = k + MORE
        bound = outside(q @ matrix, self.low, self.high)
        order = np.argsort(bound, axis=1)
        score, row = np.full((len(q), keep), -np.inf), np.full((len(q), keep), -1)
        best, live = best.copy(), np.arange(len(q))
        for step in range(len(self.leaves)):
            leaf = order[live, step]
            go = bound[live, leaf] <= far * best[live]        # the stopping test
            live, leaf = live[go], leaf[go]
            if not len(live):
                break
            for n in np.unique(leaf):
                who, rows = live[leaf == n], self.leaves[n]
                s = np.round(q[who] @ self.units[rows].T, 12)
                s[qid[who][:, None] == self.ids[rows][None]] = -np.inf
                alls = np.concatenate([score[who], s], axis=1)
                allr = np.concatenate([row[who], np.broadcast_to(rows, s.shape)], axis=1)
                top = np.lexsort((self.ids[allr], -alls), axis=-1)[:, :keep]
                score[who], row[who] = np.take_along_axis(alls, top, 1), np.take_along_axis(allr, top, 1)
                best[who] = np.minimum(best[who], np.where(np.isfinite(score[who, k - 1]), np.maximum(2 - 2 * score[who, k - 1], 0), np.inf))
        return score, row


def column_matrix(c) -> np.ndarray:
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    flat = c.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(c), -1) if len(c) else np.zeros((0, 0))


def usable(vectors: DataFrame) -> DataFrame:
    """Vectors that take part, as doubles where the table holds doubles, else as floats."""
    v, kind = F.col("vector"), vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vector"))
            .filter(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)))


def indexed(rows: DataFrame, matrix: np.ndarray, nodes: list, most: int) -> DataFrame:
    """(cell, vec_id, vector, projected); of equal vectors a batch keeps the ``most`` smallest ids."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = column_matrix(b.column(1))
            order = np.argsort(b.column(0).to_numpy(), kind="stable")
            _, same = np.unique(v[order], axis=0, return_inverse=True)
            same = same.ravel()
            by = np.argsort(same, kind="stable")              # ids ascend within equal vectors
            first = np.concatenate([[0], np.flatnonzero(np.diff(same[by])) + 1])
            place = np.arange(len(by)) - np.repeat(first, np.diff(np.concatenate([first, [len(by)]])))
            keep = np.sort(order[by[place < most]])
            b, p = b.take(pa.array(keep)), unit(v[keep]) @ matrix
            yield pa.RecordBatch.from_arrays([pa.array(cell_of(p, nodes)), b.column(0), b.column(1), pa.array(list(p))],
                                             ["cell", "vec_id", "vector", "projected"])

    kind = rows.schema["vector"].dataType.simpleString()
    return rows.select("vec_id", "vector").mapInArrow(assign, f"cell long, vec_id long, vector {kind}, projected array<double>")


def visit(index: DataFrame, visits: DataFrame, matrix: np.ndarray, k: int, far: float) -> DataFrame:
    """(query_id, vec_id, score) of the best rows that each visit finds in its salted cell.

    Rows of a cell come first in its task, then its queries, block by block.
    """
    none = F.lit(None).cast("double")
    both = (index.select("cell", "salt", F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "vector", none.alias("best"))
            .unionByName(visits.select("cell", "salt", F.lit(1).alias("kind"), F.col("query_id").alias("id"), "vector", "best")))
    ordered = both.repartition("cell", "salt").sortWithinPartitions("cell", "salt", "kind", "id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell, ids, vectors = None, None, [], []

        def found(qid, q, best):
            nonlocal cell
            if cell is None:
                if not ids:
                    return
                cell = Cell(np.concatenate(ids), np.concatenate(vectors), matrix)
            for a in range(0, len(qid), BLOCK):
                i, v = qid[a:a + BLOCK], q[a:a + BLOCK]
                score, row = cell.search(i, unit(v), matrix, best[a:a + BLOCK], k, far)
                who, at = np.nonzero(np.isfinite(score))
                r = row[who, at]
                x, y = v[who], cell.original[r]
                exact = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
                yield pa.RecordBatch.from_arrays([pa.array(i[who]), pa.array(cell.ids[r]), pa.array(exact)], ["query_id", "vec_id", "score"])

        for b in batches:
            if not b.num_rows:
                continue
            cells, salts, kinds = (b.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(salts) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if key != (cells[lo], salts[lo]):
                    key, cell, ids, vectors = (cells[lo], salts[lo]), None, [], []
                part = b.slice(lo, hi - lo)
                i, v = part.column(3).to_numpy(), column_matrix(part.column(4))
                if kinds[lo] == 0:
                    ids.append(i)
                    vectors.append(v)
                else:
                    yield from found(i, v, part.column(5).to_numpy(zero_copy_only=False))

    return ordered.mapInArrow(search, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, sure: float = 0.97, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every query row."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows, asked = usable(vectors), usable(queries)
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, n = sizes["dim"], sizes["n"]
    rows, asked = rows.filter(F.size("vector") == dim), asked.filter(F.size("vector") == dim)
    matrix, far = projection(dim, seed), reach(sure)
    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(unit(column_matrix(b.column(0))) @ matrix))], ["point"])

    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").mapInArrow(projected, "point array<double>")
    points = np.array([r["point"] for r in sample.collect()], dtype=np.float64)
    cells = 1 << max(0, min(int(math.log2(MAX_CELLS)), round(math.log2(max(1, n / WANT_ROWS)))))
    nodes = split_tree(points, cells)
    index = stored(indexed(rows, matrix, nodes, k + 1 + MORE), "projected-index")
    boxes = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[f(F.col("projected")[d]).alias(f"{f.__name__}{d}")
                                                                      for d in range(DIMS) for f in (F.min, F.max)]).orderBy("cell").collect()
    number = np.array([b["cell"] for b in boxes])
    salts = np.array([-(-b["n"] // CELL_ROWS) for b in boxes])
    low = np.array([[b[f"min{d}"] for d in range(DIMS)] for b in boxes])
    high = np.array([[b[f"max{d}"] for d in range(DIMS)] for b in boxes])
    parts = spark.createDataFrame([(int(c), int(s)) for c, s in zip(number, salts, strict=True)], "cell long, salts int")
    salted = index.join(F.broadcast(parts), "cell").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int"))

    asked = asked.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector"))

    def targets(batches: Iterator[pa.RecordBatch], home: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            for part in (b.slice(a, BLOCK) for a in range(0, b.num_rows, BLOCK)):      # against all boxes, whatever the batch holds
                best = part.column(2).to_numpy(zero_copy_only=False)
                bound = outside(unit(column_matrix(part.column(1))) @ matrix, low, high)
                at_home = np.zeros(bound.shape, bool)
                at_home[np.arange(len(bound)), bound.argmin(1)] = True
                who, to = np.nonzero(at_home if home else ~at_home & (bound <= far * best[:, None]))
                for s in range(int(salts.max())):
                    on = salts[to] > s
                    yield pa.RecordBatch.from_arrays([pa.array(number[to[on]]), pa.array(np.full(on.sum(), s, np.int32)), part.column(0).take(pa.array(who[on])),
                                                      part.column(1).take(pa.array(who[on])), pa.array(best[who[on]])], ["cell", "salt", "query_id", "vector", "best"])

    to = f"cell long, salt int, query_id long, vector {asked.schema['vector'].dataType.simpleString()}, best double"
    asked = stored(asked.withColumn("best", F.lit(float("inf"))), "projected-queries")
    first = stored(visit(salted, asked.mapInArrow(lambda it: targets(it, True), to), matrix, k, far), "projected-home")
    kth = (ranked_best(first, k).filter(F.col("rank") == k).select("query_id", F.greatest(2 - 2 * F.col("score"), F.lit(0.0)).alias("kth")))
    going = (asked.join(kth, "query_id", "left").select("query_id", "vector", F.coalesce("kth", "best").alias("best")))
    second = visit(salted, going.mapInArrow(lambda it: targets(it, False), to), matrix, k, far)
    return ranked_best(first.unionByName(second), k).select("query_id", "rank", "vec_id", "score")


def ranked_best(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
