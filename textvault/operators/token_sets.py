"""Jaccard search on token sets by a prefix filter, without pairs of everything.

Tokens get one global order, rare ones first: the ``FREQUENT`` most frequent tokens (a bounded table) come
last, by their number of rows, all others before them by name. Two sets of similarity t or more share
a token among their first ``n - ceil(t * n) + 1``, so only those prefixes are joined, under the length
filter ``t * n <= m <= n / t``; candidates are then verified on the whole sets. Rows with equal sets
are one set in the join, so a group of copies costs no more than one of them.

:func:`set_topk` lowers the threshold from round to round; a query is done once ``k`` rows reach it, as no
row below can be nearer. The last round asks for one shared token; what is still missing
shares none and has distance 1.

Defined results: the distance is ``1 - |a and b| / |a or b|``, 0 for two empty sets; a null set is an
empty set; tokens that are null don't count. Ties go to the smaller id. Ids of rows and of queries must
be unique and not null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textvault.functions.vectors import tokens as text_tokens
from textvault.session import scratch_path

FREQUENT = 200_000                   # tokens whose order is by their frequency
ROUNDS = (0.5, 0.2, 0.0)             # similarities a top-k search asks for, one after the other
PART = 256                           # sets a Python worker holds as lists at a time
EMPTY = ""                           # stands for the first token of a set without any


def token_set(text: Column) -> Column:
    return F.array_distinct(text_tokens(F.coalesce(text, F.lit(""))))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _clean(tokens: Column) -> Column:
    return F.array_distinct(F.array_compact(F.coalesce(tokens, F.array().cast("array<string>"))))


def by_frequency(rows: DataFrame, tokens_col: str, frequent: int = FREQUENT):
    """A Column function that puts the tokens of a set in the global order of ``rows``."""
    counts = rows.select(F.explode_outer(tokens_col).alias("token")).filter("token is not null").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(frequent).collect()          # bounded by ``frequent``
    place = rows.sparkSession.sparkContext.broadcast({r["token"]: r["n"] for r in top})

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def order(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        n = place.value
        for sets in batches:
            for a in range(0, len(sets), PART):
                yield pd.Series([sorted(s, key=lambda t: (n.get(t, 0), t)) for s in sets[a:a + PART]], dtype=object)

    return order


def _prefix(ordered: Column, t: float) -> Column:
    """The first tokens, among which sets of similarity t share one; all of them for t = 0."""
    n = F.size(ordered)
    take = n - F.ceil(F.lit(t) * n - 1e-9).cast("int") + 1 if t > 0 else n
    return F.when(n == 0, F.array(F.lit(EMPTY))).otherwise(F.slice(ordered, 1, F.greatest(F.least(take, n), F.lit(1))))


def _similarity(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def _near(queries: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """(query_id, set_id, similarity) of all sets of similarity t or more (above 0 if t is 0)."""
    q = queries.select("query_id", F.size("tokens").alias("nq"), F.explode(_prefix(F.col("tokens"), t)).alias("token"))
    s = sets.select("set_id", F.size("tokens").alias("ns"), F.explode(_prefix(F.col("tokens"), t)).alias("token"))
    fits = (F.col("ns") >= t * F.col("nq") - 1e-9) & (F.col("nq") >= t * F.col("ns") - 1e-9)
    pairs = q.join(s, "token").filter(fits).select("query_id", "set_id").distinct()
    both = (pairs.join(queries.select("query_id", F.col("tokens").alias("a")), "query_id")
            .join(sets.select("set_id", F.col("tokens").alias("b")), "set_id"))
    found = both.select("query_id", "set_id", _similarity(F.col("a"), F.col("b")).alias("similarity"))
    return found.filter(F.col("similarity") >= t if t > 0 else F.col("similarity") > 0)


class TokenSets:
    """The distinct sets of (id, tokens) rows, ordered by frequency, and the rows of each; written once, searched many times."""

    def __init__(self, rows: DataFrame, id_col: str = "id", tokens_col: str = "tokens", frequent: int = FREQUENT):
        clean = rows.select(F.col(id_col).alias("id"), _clean(F.col(tokens_col)).alias("tokens"))
        self.order = by_frequency(clean, "tokens", frequent)
        ordered = clean.withColumn("tokens", self.order(F.col("tokens")))
        # two 64-bit hashes name a set
        name = F.struct(F.xxhash64("tokens").alias("x"), F.xxhash64(F.array_join("tokens", "\x00"), F.size("tokens")).alias("y"))
        all_rows = _written(ordered.withColumn("set_id", name), "token-sets")
        self.members = all_rows.select("set_id", "id")
        self.sets = all_rows.groupBy("set_id").agg(F.first("tokens").alias("tokens"))

    def _asked(self, queries: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
        clean = queries.select(F.col(id_col).alias("query_id"), _clean(F.col(tokens_col)).alias("tokens"))
        return _written(clean.withColumn("tokens", self.order(F.col("tokens"))), "token-queries")

    def within(self, queries: DataFrame, threshold: float, id_col: str = "query_id", tokens_col: str = "tokens") -> DataFrame:
        """(query_id, id, distance) of all rows of similarity ``threshold`` (above 0) or more."""
        if not 0 < threshold <= 1:
            raise ValueError("threshold must be above 0 and at most 1")
        found = _near(self._asked(queries, id_col, tokens_col), self.sets, threshold)
        return found.join(self.members, "set_id").select("query_id", "id", (1 - F.col("similarity")).alias("distance"))

    def topk(self, queries: DataFrame, k: int, id_col: str = "query_id", tokens_col: str = "tokens") -> DataFrame:
        """(query_id, id, distance, rk): the k nearest rows, ties by id."""
        spark = queries.sparkSession
        pending = asked = self._asked(queries, id_col, tokens_col)
        # of a set only the k smallest ids can be hits
        few = Window.partitionBy("set_id").orderBy("id")
        first = _written(self.members.withColumn("n", F.row_number().over(few)).filter(F.col("n") <= k).drop("n"), "token-first")
        order = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id")
        ranked = lambda df: df.withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= k)
        done = []
        for t in ROUNDS:
            hits = _near(pending, self.sets, t).join(first, "set_id").select("query_id", "id", (1 - F.col("similarity")).alias("distance"))
            hits = _written(ranked(hits), "token-hits")
            full = hits.filter(F.col("rk") == k).select("query_id")
            if t > 0:
                done.append(hits.join(full, "query_id", "left_semi"))
                pending = _written(pending.join(full, "query_id", "left_anti"), "token-pending")
                if pending.isEmpty():
                    break
            else:
                # rows that share nothing: among the 2k smallest ids there are k that aren't hits
                smallest = [r["id"] for r in first.orderBy("id").limit(2 * k).collect()]
                kind = f"array<{first.schema['id'].dataType.simpleString()}>"
                short = pending.join(full, "query_id", "left_anti").select("query_id", F.explode(F.array(*[F.lit(i) for i in smallest]).cast(kind)).alias("id"))
                rest = short.join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
                done.append(ranked(hits.drop("rk").unionByName(rest.withColumn("distance", F.lit(1.0)))))
        out = done[0]
        for d in done[1:]:
            out = out.unionByName(d)
        return out.select("query_id", "id", "distance", F.col("rk").cast("int").alias("rk"))
