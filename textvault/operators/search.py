"""Top-k vector search: exact and cell-probed (IVF), without pair explosion.

Two ways, both exact for the rows they look at, and no (query, vector) pair is ever a row:

* A query batch within a byte budget is collected and broadcast. Each task scans its slice of
  the vector table in Arrow batches, scores it against the queries block by block with one
  matrix product and keeps a running top-k per query.
* Beyond the budget nothing is collected: queries are dealt into groups and vectors into slices, and a
  task holds one group with its running top-k and streams one slice past it (:func:`_tiled`). So a query is sent
  once per slice and a vector once per group. For L2 and inner products slices and groups go by length: a
  first wave finds a k-th distance, a second one visits only slices whose lengths can beat it.
* In an index a query is sent to the cells it visits, and a task holds one cell of bounded size and streams the
  queries against it (:func:`_visit`).

A task emits at most ``queries x k`` rows (per block); the merge is a window top-k over those.
Payload columns are joined to the hits afterwards, so texts never pass through Python.

Undefined vectors are those that are NULL, hold a NULL, NaN or infinite component, or have another length
than the longest query vector. In an exact search all their distances are undefined: they rank last, by
id, with a NULL distance (an undefined query has only such hits). An index holds defined vectors only,
and an undefined query finds nothing in it. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textvault.session import scratch_path

DEFAULT_BROADCAST_BUDGET = 64 << 20   # bytes of query (or centroid) matrix per broadcast
QUERY_BLOCK = 256                     # queries scored together inside a task
ROW_BLOCK = 2048                      # vectors scored together inside a task
PAIR_BYTES = 8 << 20                  # of vectors gathered at once for selected pairs
HELD_PAIRS = 1 << 20                  # pairs in a task's running top-k, beyond which they are handed on
BROADCAST_HITS = 1 << 16              # hits that are sent to the rows they are joined with
BLOCK_ROWS = 16_384                   # vectors a task holds when queries are streamed
GROUP_BYTES = 8 << 20                 # of query vectors a task holds when vectors are streamed
SLICE_ROWS = 1 << 18                  # vectors streamed past a group
LEAST_SLICE = 4_096                   # vectors, below which no more slices are cut for the sake of idle cores
MAX_CELLS = 16_384                    # cells of an index; bounds the centroid matrix


def _stack(series, dim: int) -> np.ndarray:
    """Vectors as rows; undefined ones become rows of NaN."""
    out = np.full((len(series), dim), np.nan)
    for i, v in enumerate(series):
        if v is not None and len(v) == dim:
            out[i] = np.asarray(v, dtype=np.float64)          # None becomes NaN
    out[~np.isfinite(out).all(1)] = np.nan
    return out


def is_defined(v: Column, dim: int | None = None) -> Column:
    """Whether a vector has only finite components (and ``dim`` of them); never NULL."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite & (F.size(v) > 0 if dim is None else F.size(v) == dim), F.lit(False))


def defined(vectors: DataFrame, vec_col: str, dim: int | None = None) -> DataFrame:
    return vectors.filter(is_defined(F.col(vec_col), dim))


def _scores(Q: np.ndarray, V: np.ndarray, metric: str, qn=None, vn=None) -> np.ndarray:
    """(nq, nv) matrix where smaller is better."""
    if metric == "L2":
        qn = (Q * Q).sum(1) if qn is None else qn
        vn = (V * V).sum(1) if vn is None else vn
        return np.maximum(qn[:, None] + vn[None, :] - 2.0 * (Q @ V.T), 0.0)
    if metric == "IP":
        return -(Q @ V.T)
    if metric == "COSINE":
        qn = np.sqrt((Q * Q).sum(1)) if qn is None else np.sqrt(qn)
        vn = np.sqrt((V * V).sum(1)) if vn is None else np.sqrt(vn)
        den = qn[:, None] * vn[None, :]
        with np.errstate(invalid="ignore", divide="ignore"):
            s = 1.0 - (Q @ V.T) / den
        s[den == 0] = np.inf
        return s
    Bq, Bv = (Q > 0).astype(np.float64), (V > 0).astype(np.float64)
    inter = Bq @ Bv.T
    a, b = Bq.sum(1)[:, None], Bv.sum(1)[None, :]
    if metric == "HAMMING":
        return a + b - 2.0 * inter
    union = a + b - inter
    with np.errstate(invalid="ignore", divide="ignore"):
        sim = np.where(union > 0, inter / np.where(union > 0, union, 1), 1.0)
    if metric == "JACCARD":
        return 1.0 - sim
    if metric == "TANIMOTO":
        with np.errstate(divide="ignore"):
            return np.where(sim > 0, -np.log2(np.where(sim > 0, sim, 1)), np.inf)
    raise ValueError(f"unknown metric {metric}")


def _exact_pairs(Q, V, qi, vj, metric):
    """Recompute the metric directly for selected pairs (stable digits), a bounded number at a time."""
    step = max(1, PAIR_BYTES // (8 * Q.shape[1]))
    return np.concatenate([np.zeros(0), *(_pair_metric(Q[qi[i:i + step]], V[vj[i:i + step]], metric) for i in range(0, len(qi), step))])


def _pair_metric(a, b, metric):
    if metric == "L2":
        return ((a - b) ** 2).sum(1)
    if metric == "IP":
        return (a * b).sum(1)
    if metric == "COSINE":
        den = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
        with np.errstate(invalid="ignore", divide="ignore"):
            out = 1.0 - (a * b).sum(1) / den
        out[den == 0] = np.nan
        return out
    ba, bb = a > 0, b > 0
    if metric == "HAMMING":
        return (ba != bb).sum(1).astype(np.float64)
    inter, union = (ba & bb).sum(1), (ba | bb).sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        sim = np.where(union > 0, inter / np.where(union > 0, union, 1), 1.0)
    if metric == "JACCARD":
        return 1.0 - sim
    with np.errstate(divide="ignore"):
        return np.where(sim > 0, -np.log2(np.where(sim > 0, sim, 1)), np.nan)


ORDER_DIGITS = 9  # ranking compares distances rounded to this many digits, then ids


def _order_value(metric, dist):
    """Ascending sort key from the reported metric value.

    Rounding makes the ranking independent of summation order, so ties
    between equal vectors always fall back to the id.
    """
    key = np.round(dist, ORDER_DIGITS)
    if metric == "IP":
        key = -key
    return np.where(np.isnan(key), np.inf, key)


def _keep_topk(q, key, ids, k):
    """Indices of the first k rows per query in (query, key, id) order."""
    order = np.lexsort((ids, key, q))
    if len(order) == 0:
        return order
    qs = q[order]
    starts = np.r_[0, np.flatnonzero(np.diff(qs)) + 1]
    counts = np.diff(np.r_[starts, len(qs)])
    rank = np.arange(len(qs)) - np.repeat(starts, counts)
    return order[rank < k]


class _TopK:
    """Running top-k of a set of queries over vectors that arrive in blocks.

    :meth:`add` hands the pairs on and starts anew when more than ``HELD_PAIRS`` are held and k is beyond a block's
    rows: they hold the top-k of the rows they come from, so that a merge of all that was handed on
    is the same, and memory is bounded whatever k.

    Undefined distances (cosine of a zero vector, Tanimoto without a shared bit) rank
    last and are reported as NaN.
    """

    def __init__(self, Q: np.ndarray, k: int, metric: str):
        self.undefined = np.isnan(Q).any(1)
        self.Q, self.k, self.metric = np.where(self.undefined[:, None], 0.0, Q), k, metric
        self.most = max(HELD_PAIRS, 2 * len(Q) * min(k, ROW_BLOCK))
        self._clear()

    def _clear(self) -> None:
        self.q, self.rows = np.zeros(0, np.int64), 0
        self.key, self.dist, self.ids = np.zeros(0), np.zeros(0), None

    def taken(self) -> Iterator[tuple]:
        """What is held (q, ids, dist, key), if anything; nothing is held afterwards."""
        if len(self.q):
            yield self.q, self.ids, self.dist, self.key
        self._clear()

    def add(self, ids: np.ndarray, V: np.ndarray) -> Iterator[tuple]:
        undefined = np.isnan(V).any(1)
        V = np.where(undefined[:, None], 0.0, V)
        for v0 in range(0, len(V), ROW_BLOCK):
            Vb, ib, ub = V[v0:v0 + ROW_BLOCK], ids[v0:v0 + ROW_BLOCK], undefined[v0:v0 + ROW_BLOCK]
            self.rows += len(Vb)
            for q0 in range(0, len(self.Q), QUERY_BLOCK):
                Qb, uq = self.Q[q0:q0 + QUERY_BLOCK], self.undefined[q0:q0 + QUERY_BLOCK]
                S = _scores(Qb, Vb, self.metric)
                S[uq[:, None] | ub[None]] = np.inf
                kk = min(self.k, S.shape[1])
                thr = np.partition(S, kk - 1, axis=1)[:, kk - 1]
                # a small slack keeps rows that tie with the k-th after rounding
                slack = np.where(np.isfinite(thr), 1e-7 * (1.0 + np.abs(thr)), 0.0)
                qi, vj = np.nonzero(S <= (thr + slack)[:, None])
                dist = _exact_pairs(Qb, Vb, qi, vj, self.metric)
                dist[uq[qi] | ub[vj]] = np.nan
                self._merge(qi + q0, _order_value(self.metric, dist), dist, ib[vj])
                if len(self.q) > self.most:
                    yield from self.taken()
                    self.rows = len(Vb)

    def _merge(self, q, key, dist, ids) -> None:
        q, key, dist = np.r_[self.q, q], np.r_[self.key, key], np.r_[self.dist, dist]
        ids = ids if self.ids is None else np.r_[self.ids, ids]
        if self.rows <= self.k:          # nothing to leave out
            self.q, self.key, self.dist, self.ids = q, key, dist, ids
            return
        sel = _keep_topk(q, key, ids, self.k)
        self.q, self.key, self.dist, self.ids = q[sel], key[sel], dist[sel], ids[sel]


def _ids(column) -> np.ndarray:
    out = column.to_numpy()
    return out.astype(str) if out.dtype == object else out


def _collect_bounded(df: DataFrame, cols: list[str], budget: int, dim: int) -> list[tuple] | None:
    """The rows of a small side, or None beyond the budget (one row more than fits is looked at)."""
    most = max(1, budget // (max(dim, 1) * 8 + 64))
    rows = df.select(*cols).limit(most + 1).collect()
    return None if len(rows) > most else [tuple(r) for r in rows]


def _vector_dim(df: DataFrame, vec_col: str) -> int:
    """Length of the longest vector, 1 if there is none."""
    return max(1, df.agg(F.max(F.size(vec_col)).alias("d")).first()["d"] or 1)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """(query_id, id, distance, rk) from candidates with an order key; undefined distances are NULL."""
    w = Window.partitionBy("query_id").orderBy(F.col("okey"), F.col("id"))
    return (found.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)
            .select("query_id", "id", F.when(~F.isnan("distance"), F.col("distance")).alias("distance"), "rk"))


def _visit(blocks: DataFrame, visits: DataFrame, k: int, metric: str, dim: int) -> DataFrame:
    """Candidates (query_id, id, distance, okey) of queries in the blocks they visit.

    ``blocks``: (block, salt, id, vec); ``visits``: (block, salt, query_id, vec). Rows of a block come first
    in its task and are held (a block is bounded), its queries are streamed.
    """
    id_type, qid_type = (df.schema[c].dataType.simpleString() for df, c in ((blocks, "id"), (visits, "query_id")))
    none = lambda t: F.lit(None).cast(t)
    both = (blocks.select("block", "salt", F.lit(0).alias("kind"), "id", none(qid_type).alias("query_id"), "vec")
            .unionByName(visits.select("block", "salt", F.lit(1).alias("kind"), none(id_type).alias("id"), "query_id", "vec")))
    ordered = both.repartition("block", "salt").sortWithinPartitions("block", "salt", "kind")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, vecs = None, [], []
        for pdf in batches:
            for part, g in pdf.groupby(["block", "salt", "kind"], sort=False):
                if key != part[:2]:
                    key, ids, vecs = part[:2], [], []
                if part[2] == 0:
                    ids.append(_ids(g["id"]))
                    vecs.append(_stack(g["vec"], dim))
                elif ids:
                    if len(ids) > 1:
                        ids, vecs = [np.concatenate(ids)], [np.concatenate(vecs)]
                    top = _TopK(_stack(g["vec"], dim), k, metric)
                    for q, i, dist, okey in chain(top.add(ids[0], vecs[0]), top.taken()):
                        yield pd.DataFrame({"query_id": g["query_id"].to_numpy()[q], "id": i, "distance": dist, "okey": okey})

    return ordered.mapInPandas(search, f"query_id {qid_type}, id {id_type}, distance double, okey double")


def _by_length(df: DataFrame, most: int, by: str, cores: int, least: int = 1) -> tuple[DataFrame, list[tuple[float, float]]]:
    """``df`` with ``by``, numbers of about equal shares of at most ``most`` rows by ascending ``norm``, and the smallest and
    largest norm of each. Equal norms that are more than a share are dealt over several of the same limits."""
    n = df.count()
    want = max(1, math.ceil(n / most), min(2 * cores, n // least) if least > 1 else 1)
    shares = [i / want for i in range(1, want)]
    bounds = df.agg(F.percentile_approx("norm", shares, 20 * want).alias("b")).first()["b"] if shares and n else []
    above = [F.lit(float(b)) for b in sorted(set(bounds))]
    kind = df.withColumn("_class", (F.size(F.filter(F.array(*above), lambda b: b < F.col("norm"))) if above else F.lit(0)).cast("int"))
    counts = kind.groupBy("_class").agg(F.count(F.lit(1)).alias("n"), F.min("norm").alias("low"), F.max("norm").alias("high")).orderBy("_class").collect()
    number, limits = [], []
    for c in counts:
        parts = -(-2 * c["n"] * want // (3 * n))
        number.append((c["_class"], len(limits), parts))
        limits += [(c["low"], c["high"])] * parts
    parts = df.sparkSession.createDataFrame(number, "_class int, _base int, _parts int")        # one row a share
    at = (F.col("_base") + F.pmod(F.xxhash64(df.columns[0]), F.col("_parts"))).cast("int")
    return kind.join(F.broadcast(parts), "_class").withColumn(by, at).drop("_class", "_base", "_parts"), limits


def _tiled(rows: DataFrame, asked: DataFrame, k: int, metric: str, dim: int) -> DataFrame:
    """Candidates (query_id, id, distance, okey) of queries against all rows, tile by tile."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    id_type, qid_type = rows.schema["id"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()
    schema = f"query_id {qid_type}, id {id_type}, distance double, okey double"
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    doubles = F.col("vec").cast("array<double>").alias("vec")
    sliced, limits = _by_length(defined(rows, "vec", dim).select("id", doubles).withColumn("norm", norm), SLICE_ROWS, "slice", cores, LEAST_SLICE)
    path = scratch_path(spark, "tiled-queries")
    grouped, groups = _by_length(defined(asked, "vec", dim).select("query_id", doubles).withColumn("norm", norm), max(1, GROUP_BYTES // (8 * dim)), "group", cores)
    grouped.write.parquet(path)
    grouped = spark.read.schema(grouped.schema).parquet(path)
    # rows and queries that are undefined: last, by id
    lost = lambda df: df.filter(~is_defined(F.col("vec"), dim))
    ids = lambda df: F.array(*[F.lit(r["id"]) for r in df.orderBy("id").limit(k).collect()]).cast(f"array<{id_type}>")
    last = [F.lit(float("nan")).alias("distance"), F.lit(float("inf")).alias("okey")]
    out = (grouped.select("query_id", F.explode(ids(lost(rows))).alias("id"), *last)
           .unionByName(lost(asked).select("query_id", F.explode(ids(rows.select("id"))).alias("id"), *last)))
    if not limits or not groups:
        return out

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, vecs, top = None, [], [], None

        def frames(taken):
            for q, i, dist, okey in taken:
                yield pd.DataFrame({"query_id": np.concatenate(held)[q], "id": i, "distance": dist, "okey": okey})

        def finish():
            if top is not None:
                yield from frames(top.taken())

        for pdf in batches:
            for part, g in pdf.groupby(["group", "slice", "kind"], sort=False):
                if key != part[:2]:
                    yield from finish()
                    key, held, vecs, top = part[:2], [], [], None
                if part[2] == 0:
                    held.append(g["query_id"].to_numpy())
                    vecs.append(_stack(g["vec"], dim))
                elif held:
                    if top is None:
                        top = _TopK(np.concatenate(vecs), k, metric)
                    yield from frames(top.add(_ids(g["id"]), _stack(g["vec"], dim)))
        yield from finish()

    none = lambda t: F.lit(None).cast(t)

    def wave(visits: DataFrame) -> DataFrame:
        """``visits``: grouped queries with ``slice``."""
        tiles = visits.select("group", "slice").distinct()
        sent = sliced.join(tiles, "slice")
        both = (visits.select("group", "slice", F.lit(0).alias("kind"), "query_id", none(id_type).alias("id"), "vec")
                .unionByName(sent.select("group", "slice", F.lit(1).alias("kind"), none(qid_type).alias("query_id"), "id", "vec")))
        parts = min(20_000, len(limits) * len(groups))
        return both.repartition(parts, "group", "slice").sortWithinPartitions("group", "slice", "kind").mapInPandas(scan, schema)

    edges = F.array(*[F.struct(F.lit(i).alias("slice"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for i, (a, b) in enumerate(limits)])
    if metric not in ("L2", "IP") or len(limits) == 1:
        return out.unionByName(wave(grouped.withColumn("slice", F.explode(F.transform(edges, lambda e: e["slice"])))))
    q = F.col("norm")
    far = lambda e: F.greatest(e["low"] - q, q - e["high"], F.lit(0.0))
    nearest = F.array_min(F.transform(edges, far)) if metric == "L2" else F.lit(float(limits[-1][1]))
    home = lambda e: (far(e) <= nearest) if metric == "L2" else (e["high"] >= nearest)
    first_path = scratch_path(spark, "tiled-first")
    wave(grouped.withColumn("slice", F.explode(F.transform(F.filter(edges, home), lambda e: e["slice"])))).write.parquet(first_path)
    first = spark.read.schema(schema).parquet(first_path)
    kth = _merged(first, k).filter(F.col("rk") == k).select("query_id", F.col("distance").alias("kth"))
    reach = (lambda e: far(e) <= F.sqrt("kth") * (1 + 1e-9) + 1e-6) if metric == "L2" else (lambda e: q * e["high"] + 1e-6 * (1 + F.abs("kth")) >= F.col("kth"))
    going = grouped.join(kth, "query_id", "left")
    more = going.withColumn("slice", F.explode(F.transform(F.filter(edges, lambda e: ~home(e) & (F.col("kth").isNull() | reach(e))), lambda e: e["slice"])))
    return out.unionByName(first).unionByName(wave(more))


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "L2", *,
               id_col: str = "id", vec_col: str = "embedding",
               qid_col: str = "query_id", qvec_col: str = "embedding",
               budget: int = DEFAULT_BROADCAST_BUDGET, payload: list[str] = ()) -> DataFrame:
    """Rows (query_id, id, distance, rk, *payload) with rk = 1..k per query.

    Order per query: metric ascending (IP: descending), undefined last, then id. ``distance`` is
    the metric value (L2 is squared, as the search index reports it; NULL if undefined).
    ``payload`` columns are joined to the hits by id.
    """
    spark, metric = vectors.sparkSession, metric.upper()
    id_type, qid_type = vectors.schema[id_col].dataType.simpleString(), queries.schema[qid_col].dataType.simpleString()
    found_schema = f"id {id_type}, distance double, okey double"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    asked = queries.select(F.col(qid_col).alias("query_id"), F.col(qvec_col).alias("vec"))
    dim = _vector_dim(queries, qvec_col)
    small = _collect_bounded(asked, ["query_id", "vec"], budget, dim) if k > 0 else []
    if not small and small is not None:
        hits = spark.createDataFrame([], f"query_id {qid_type}, id {id_type}, distance double, rk int")
    elif small:
        matrix = spark.sparkContext.broadcast(_stack([v for _, v in small], dim))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            top = _TopK(matrix.value, k, metric)
            blocks = ((_ids(pdf["id"]), _stack(pdf["vec"], dim)) for pdf in batches if len(pdf))
            for q, i, dist, okey in chain((taken for ids, V in blocks for taken in top.add(ids, V)), top.taken()):
                yield pd.DataFrame({"qpos": q, "id": i, "distance": dist, "okey": okey})

        names = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(small)], f"qpos long, query_id {qid_type}")
        hits = _merged(rows.mapInPandas(scan, f"qpos long, {found_schema}").join(F.broadcast(names), "qpos"), k)
        if k * len(small) <= BROADCAST_HITS:
            hits = F.broadcast(hits)      # texts joined to them aren't shuffled
    else:
        hits = _merged(_tiled(rows, asked, k, metric, dim), k)
    if not payload:
        return hits
    extra = vectors.select(F.col(id_col).alias("id"), *payload)
    return hits.join(extra, "id").select("query_id", "id", "distance", "rk", *payload)


# --- IVF: cells of sampled or trained centroids ------------------------------

TRAIN_PER_CELL = 64       # vectors a cell's centroid is trained on (a sample by hash; every vector is indexed)
OVERFULL = 3              # times the average number of vectors, from which a cell is split


def default_nlist(n: int) -> int:
    return max(1, min(MAX_CELLS, int(round(4 * math.sqrt(max(n, 1))))))


def sample_centroids(vectors: DataFrame, nlist: int, *, id_col: str = "id",
                     vec_col: str = "embedding") -> DataFrame:
    """Deterministic quantiser: the ``nlist`` vectors with the smallest md5 of
    their id become cells 0..nlist-1 (a top-n, not a global sort)."""
    h = F.md5(F.col(id_col).cast("string"))
    top = vectors.select(h.alias("_h"), F.col(vec_col).alias("centroid")).orderBy("_h").limit(nlist)
    w = Window.orderBy("_h")  # over nlist rows only
    return top.select((F.row_number().over(w) - 1).alias("cell"), "centroid")


def _centroid_matrix(centroids: DataFrame) -> np.ndarray:
    """At most MAX_CELLS rows."""
    rows = [r["centroid"] for r in centroids.orderBy("cell").collect()]
    return np.array(rows, dtype=np.float64) if rows else np.zeros((0, 1))


def _nearest(Q: np.ndarray, C: np.ndarray, m: int) -> np.ndarray:
    """Indices of the m nearest centroids per row, ties by lower cell id.

    The matrix form preselects candidates, block by block; their distances are then
    recomputed term by term so that ties and near-ties resolve like a direct sum.
    """
    m = min(m, C.shape[0])
    pre = min(C.shape[0], m + 8)
    step = max(1, min(QUERY_BLOCK, DEFAULT_BROADCAST_BUDGET // (8 * max(C.shape[0], pre * C.shape[1]))))
    out = np.empty((len(Q), m), dtype=np.int64)
    for a in range(0, len(Q), step):
        Qb = Q[a:a + step]
        S = _scores(Qb, C, "L2")
        cand = np.argpartition(S, pre - 1, axis=1)[:, :pre] if pre < C.shape[0] else np.tile(np.arange(C.shape[0]), (len(Qb), 1))
        exact = np.round(((Qb[:, None, :] - C[cand]) ** 2).sum(2), ORDER_DIGITS)
        order = np.lexsort((cand, exact), axis=-1)[:, :m]
        out[a:a + step] = np.take_along_axis(cand, order, 1)
    return out


def train_centroids(vectors: DataFrame, start: np.ndarray, n: int, iterations: int, vec_col: str = "vec", id_col: str = "id") -> np.ndarray:
    """Lloyd's iterations from the centroids ``start`` on a sample of about TRAIN_PER_CELL vectors a cell.

    A task adds up the vectors of each cell it meets; the sums of a cell are merged in one group of at most
    one row a task. Between iterations only the centroids (at most MAX_CELLS rows) pass the driver, so an
    iteration never depends on the plan of the one before. A cell with more than OVERFULL times its share is split:
    its centroid replaces that of the emptiest cell, both moved a little to either side.
    """
    spark, C = vectors.sparkSession, start.copy()
    share = min(1.0, TRAIN_PER_CELL * len(C) / max(n, 1))
    path = scratch_path(spark, "ivf-train")
    (vectors.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.col(vec_col).alias("vec"))
     .write.parquet(path))
    sample = spark.read.parquet(path)
    for turn in range(iterations):
        known = spark.sparkContext.broadcast(C)

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            C = known.value
            total, count = np.zeros(C.shape), np.zeros(len(C), np.int64)
            for pdf in batches:
                V = _stack(pdf["vec"], C.shape[1])
                cell = _nearest(V, C, 1)[:, 0]
                np.add.at(total, cell, V)
                count += np.bincount(cell, minlength=len(C))
            met = np.flatnonzero(count)
            yield pd.DataFrame({"cell": met, "n": count[met], "total": list(total[met])})

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"cell": pdf["cell"][:1], "n": [int(pdf["n"].sum())], "total": [np.sum(np.stack(pdf["total"]), axis=0)]})

        schema = "cell long, n long, total array<double>"
        count = np.zeros(len(C), np.int64)
        for r in sample.mapInPandas(sums, schema).groupBy("cell").applyInPandas(merge, schema).collect():
            count[r["cell"]] = r["n"]
            C[r["cell"]] = np.array(r["total"]) / r["n"]
        known.destroy()
        if turn + 1 < iterations:
            emptiest = np.argsort(count, kind="stable")
            full = [c for c in np.argsort(-count, kind="stable") if count[c] > OVERFULL * count.mean()]
            side = np.where(np.arange(C.shape[1]) % 2 == 0, 1.0, -1.0) / 1024
            for c, e in zip(full, emptiest[:len(C) // 2]):
                C[e], C[c] = C[c] * (1 + side), C[c] * (1 - side)
    return C.astype(np.float32).astype(np.float64)


def assign_cells(vectors: DataFrame, centroids: DataFrame, *, vec_col: str = "embedding") -> DataFrame:
    """Add ``cell`` = nearest centroid (L2, ties to the lower cell) and ``dist``, the distance to it, to every row."""
    bc = vectors.sparkSession.sparkContext.broadcast(_centroid_matrix(centroids))
    schema = StructType(list(vectors.schema.fields)).add("cell", "integer").add("dist", "double")
    at = vectors.columns.index(vec_col)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C = bc.value
        for b in batches:
            V = _stack(b.column(at).to_pylist(), C.shape[1])
            cell = _nearest(V, C, 1)[:, 0] if b.num_rows else np.zeros(0, np.int64)
            dist = np.sqrt(((V - C[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(dist)], [*b.schema.names, "cell", "dist"])

    return vectors.mapInArrow(assign, schema)


class CellIndex:
    """An IVF index on shared storage: centroids, vectors partitioned by cell, and per cell its size and radius."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, nlist: int | None = None, *, id_col: str = "id",
              vec_col: str = "embedding", iterations: int = 0) -> CellIndex:
        """Write the index: sampled centroids, trained by ``iterations`` of Lloyd's, and every defined vector in the cell of
        its nearest one. A hot cell is written by several tasks."""
        spark = vectors.sparkSession
        index = cls(spark, path)
        rows = defined(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("embedding")), "embedding")
        rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{index.path}/empty")      # the schema, whatever there is
        rows = rows.filter(F.size("embedding") == _vector_dim(rows, "embedding"))
        n = rows.count()
        start = sample_centroids(rows, nlist or default_nlist(n))
        if iterations and n:
            trained = train_centroids(rows, _centroid_matrix(start), n, iterations, "embedding")
            start = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(trained)], "cell int, centroid array<double>").coalesce(1)
        start.write.mode("overwrite").parquet(f"{index.path}/centroids")
        assigned = assign_cells(rows, index.centroids())
        assigned.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{index.path}/vectors")
        size = [F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("salts"), F.max("dist").alias("radius")]
        index.vectors().groupBy("cell").agg(*size).coalesce(1).write.mode("overwrite").parquet(f"{index.path}/cells")
        return index

    def centroids(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/centroids")

    def vectors(self) -> DataFrame:
        empty = self.spark.read.parquet(f"{self.path}/empty").schema
        return self.spark.read.schema(StructType(list(empty.fields)).add("dist", "double").add("cell", "integer")).parquet(f"{self.path}/vectors")

    def cells(self) -> DataFrame:
        """(cell, n, salts, radius): one row a cell."""
        return self.spark.read.parquet(f"{self.path}/cells")

    def probes(self, queries: DataFrame, nprobe: int, within: str | None = None) -> DataFrame:
        """(query_id, vec, cell): the ``nprobe`` non-empty cells nearest to each query.

        With ``within``, a column of ``queries``, the others that can hold a vector nearer than that: the
        distance to the centroid is at most the cell's radius larger (triangle inequality).
        """
        matrix, cells = _centroid_matrix(self.centroids()), self.cells().orderBy("cell").collect()
        number = np.array([r["cell"] for r in cells], np.int64)
        C = self.spark.sparkContext.broadcast((matrix[number], number, np.array([r["radius"] for r in cells])))
        schema = StructType([queries.schema["query_id"], queries.schema["vec"]]).add("cell", "integer")
        dim = matrix.shape[1]

        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            centre, number, radius = C.value
            for pdf in batches:
                V = _stack(pdf["vec"], dim)
                pdf, V = pdf[~np.isnan(V).any(1)], V[~np.isnan(V).any(1)]
                for a in range(0, len(pdf), QUERY_BLOCK):
                    part, Q = pdf.iloc[a:a + QUERY_BLOCK], V[a:a + QUERY_BLOCK]
                    near = _nearest(Q, centre, nprobe)
                    if within is None:
                        who, cell = np.repeat(np.arange(len(Q)), near.shape[1]), near.ravel()
                    else:
                        limit = part[within].to_numpy(dtype=np.float64)[:, None] + radius[None]
                        may = np.sqrt(_scores(Q, centre, "L2")) <= limit * (1 + 1e-9) + 1e-6
                        np.put_along_axis(may, near, False, axis=1)
                        who, cell = np.nonzero(may)
                    yield part[["query_id", "vec"]].iloc[who].assign(cell=number[cell].astype(np.int32))

        return queries.mapInPandas(probe, schema) if len(number) else queries.select("query_id", "vec").limit(0).withColumn("cell", F.lit(0))

    def _found(self, visits: DataFrame, k: int, metric: str, dim: int) -> DataFrame:
        """Candidates from the visited cells.

        Only these are read (the join on the partition column prunes the others), and
        cells of more than BLOCK_ROWS rows are dealt over salts.
        """
        cells = visits.select("cell").distinct()                # at most MAX_CELLS numbers
        rows = self.vectors().join(F.broadcast(cells), "cell", "left_semi")
        salts = F.broadcast(self.cells().select("cell", "salts"))              # one row a cell
        blocks = rows.join(salts, "cell").select(F.col("cell").alias("block"), F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"),
                                                 "id", F.col("embedding").alias("vec"))
        visits = visits.join(salts, "cell").select(F.col("cell").alias("block"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                                                   "query_id", "vec")
        return _visit(blocks, visits, k, metric, dim)

    def topk(self, queries: DataFrame, k: int, nprobe: int, metric: str = "L2", *, qid_col: str = "query_id",
             qvec_col: str = "embedding", exact: bool = False) -> DataFrame:
        """Exact ranking inside the ``nprobe`` cells nearest to each query.

        With ``exact`` (L2 only) the search goes on: the k-th hit of those cells bounds the distance, and every
        cell that the triangle inequality doesn't exclude is visited too, so the result is that of the full search.
        """
        metric = metric.upper()
        if exact and metric != "L2":
            raise ValueError("the triangle inequality stops an L2 search only")
        asked = queries.select(F.col(qid_col).alias("query_id"), F.col(qvec_col).alias("vec"))
        dim = max(1, _centroid_matrix(self.centroids()).shape[1])
        first = self._found(self.probes(asked, nprobe), k, metric, dim)
        if not exact:
            return _merged(first, k)
        path = scratch_path(self.spark, "ivf-first")
        first.write.parquet(path)
        first = self.spark.read.schema(first.schema).parquet(path)
        kth = _merged(first, k).filter(F.col("rk") == k).select("query_id", F.sqrt("distance").alias("within"))
        going = asked.join(kth, "query_id", "left").fillna({"within": float("inf")})
        second = self._found(self.probes(going, nprobe, "within"), k, metric, dim)
        return _merged(first.unionByName(second), k)


def recall_at_k(exact: DataFrame, approx: DataFrame) -> DataFrame:
    """Per query: share of the exact top-k ids that the approximate search found."""
    hit = exact.alias("e").join(approx.alias("a"), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg(
        (F.count(F.col("a.rk")) / F.count(F.lit(1))).alias("recall"))
