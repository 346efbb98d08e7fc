"""Top-k search on packed sign bits without Python workers.

Hamming distance uses multi-index hashing. The bits are cut into blocks of ``WIDTH``; two
vectors within distance ``r`` agree up to ``r / blocks`` bits in some block (pigeonhole). So round s looks up
every block value within s flips in an index of (block, value), which finds all rows within
``blocks * (s + 1) - 1``; a query whose k-th hit is as near is done. The flips are enumerated up to ``MOST_FLIPS``
a block. Queries without k proven hits by then scan the rows: rows are packed into blocks of
``BLOCK_ROWS`` and a block is reduced to a query's k best inside one expression, so a (query, row) pair never
becomes a row. Jaccard and Tanimoto distances, which no block bounds, always scan.

A block value shared by very many rows costs only the queries that look it up: copies of one bit pattern are
one row of the index, with the k smallest of their ids.

Defined results: ids must be unique. Undefined vectors (NULL, of another length, or with a component that is
NULL, NaN or infinite) and undefined distances rank last, by id, with a NULL distance; an undefined query
has only such hits.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textvault.functions import bits as B
from textvault.session import scratch_path

WIDTH = 16
MOST_FLIPS = 2          # 137 values of a block
BLOCK_ROWS = 4_096


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def flips(width: int, most: int) -> list[int]:
    """All numbers of ``width`` bits with at most ``most`` set."""
    return [sum(1 << i for i in c) for n in range(most + 1) for c in combinations(range(width), n)]


class BitIndex:
    """Packed rows and, per distinct bit pattern, its ids; written once, searched many times."""

    def __init__(self, rows: DataFrame, dim: int, id_col: str = "id", bits_col: str = "bits"):
        self.dim = dim
        packed = rows.select(F.col(id_col).alias("id"), F.col(bits_col).alias("bits"))
        self.rows = _written(packed, "bit-rows")
        self.spark = rows.sparkSession
        self.blocks = -(-dim // WIDTH)

    def _patterns(self, k: int) -> DataFrame:
        """(bits, ids): the distinct patterns with the k smallest ids of each; the cut is made before the shuffle, too."""
        few = Window.partitionBy("bits").orderBy("id")
        least = self.rows.filter("bits is not null").withColumn("n", F.row_number().over(few)).filter(F.col("n") <= k)
        return _written(least.groupBy("bits").agg(F.sort_array(F.collect_list("id")).alias("ids")), "bit-patterns")

    def _ranked(self, found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.round("distance", 9).asc_nulls_last(), "id")
        return found.withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= k)

    def _within(self, asked: DataFrame, patterns: DataFrame, most: int, k: int) -> DataFrame:
        """(query_id, id, distance) of the rows that agree with a query up to ``most`` bits in some block."""
        each = lambda df, value: [F.struct(F.lit(b).alias("block"), value(B.block(F.col(df), b, WIDTH)).alias("value")) for b in range(self.blocks)]
        index = patterns.select("bits", "ids", F.inline(F.array(*each("bits", lambda x: x))))
        masks = F.array(*[F.lit(m) for m in flips(min(WIDTH, self.dim), most)])
        probes = asked.select("query_id", F.col("bits").alias("qbits"), F.inline(F.array(*each("bits", lambda x: x)))).select(
            "query_id", "qbits", "block", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("value")))).alias("value"))
        met = index.join(probes, ["block", "value"]).select("query_id", "qbits", "bits", "ids")
        far = met.select("query_id", "ids", B.hamming(F.col("qbits"), F.col("bits")).alias("distance"), "bits").distinct()
        return self._ranked(far.select("query_id", F.explode("ids").alias("id"), F.col("distance").cast("double").alias("distance")), k)

    def _scan(self, asked: DataFrame, patterns: DataFrame, metric: str, k: int) -> DataFrame:
        """(query_id, id, distance) candidates of all rows: the k best of each block of patterns."""
        n = max(1, -(-patterns.count() // BLOCK_ROWS))
        dealt = patterns.withColumn("tile", F.pmod(F.xxhash64("bits"), F.lit(n)).cast("int"))
        tiles = dealt.groupBy("tile").agg(F.collect_list(F.struct("bits", "ids")).alias("held"))
        visits = asked.select("query_id", F.col("bits").alias("qbits"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("tile"))
        both = tiles.join(visits, "tile")
        scored = F.transform("held", lambda r: F.struct(F.round(B.METRICS[metric](r["bits"], F.col("qbits")), 9).alias("o"), r["ids"].alias("ids"),
                                                        B.METRICS[metric](r["bits"], F.col("qbits")).cast("double").alias("distance")))
        # by distance (NULL last), then smallest id: the order of structs, with NULL made the largest double
        keyed = F.transform(scored, lambda r: F.struct(F.coalesce(r["o"].cast("double"), F.lit(float("inf"))).alias("o"), r["ids"].alias("ids"), r["distance"].alias("distance")))
        best = both.select("query_id", F.inline(F.slice(F.array_sort(keyed), 1, k)))
        return best.select("query_id", F.explode("ids").alias("id"), "distance")

    def topk(self, queries: DataFrame, k: int, metric: str = "HAMMING", id_col: str = "query_id", bits_col: str = "bits") -> DataFrame:
        """(query_id, id, distance, rk): the k nearest rows."""
        metric = metric.upper()
        asked = _written(queries.select(F.col(id_col).alias("query_id"), F.col(bits_col).alias("bits")), "bit-queries")
        patterns = self._patterns(k)
        pending, done = asked.filter("bits is not null"), []
        if metric == "HAMMING":
            for s in range(MOST_FLIPS + 1):
                hits = _written(self._within(pending, patterns, s, k), "bit-hits")
                sure = hits.filter((F.col("rk") == k) & (F.col("distance") <= self.blocks * (s + 1) - 1)).select("query_id")
                done.append(hits.join(sure, "query_id", "left_semi"))
                pending = _written(pending.join(sure, "query_id", "left_anti"), "bit-pending")
                if pending.isEmpty():
                    break
        found = self._scan(pending, patterns, metric, k)
        # undefined distances: the k smallest ids among undefined rows, and among all rows for undefined queries
        lost = self.rows.filter("bits is null").orderBy("id").limit(k).select("id").collect()
        least = self.rows.orderBy("id").limit(k).select("id").collect()
        ids = lambda rows: F.array(*[F.lit(r["id"]) for r in rows]).cast(f"array<{self.rows.schema['id'].dataType.simpleString()}>")
        nothing = F.lit(None).cast("double").alias("distance")
        found = (found.unionByName(pending.select("query_id", F.explode(ids(lost)).alias("id"), nothing))
                 .unionByName(asked.filter("bits is null").select("query_id", F.explode(ids(least)).alias("id"), nothing)))
        out = self._ranked(found, k)
        for hits in done:
            out = out.unionByName(hits)
        return out.select("query_id", "id", "distance", F.col("rk").cast("int").alias("rk"))
