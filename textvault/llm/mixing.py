"""Mixing overlapping sources to target weights by a min-cost flow.

1. Documents are counted in words and added up by *membership pattern* (the set of sources
   they belong to): one number per pattern.
2. Each source has a quota: its weight's share of all words, at most ``most`` times its own
   size; what a capped source cannot take is shared again by weight (:func:`quotas`).
3. A flow routes words from patterns to quotas. A pattern's words can be used ``most``
   times; the first use is free and each repetition costs one more, so costs are convex and
   repetitions appear only where distinct words run out (:func:`route`).
4. Documents are selected in the order of a seeded hash: every document of a pattern is
   taken as often as the flow goes through all of its words, and those first in the order
   once more until the rest is used. Where to stop is found by adding up hash prefixes
   (``2^BITS`` per level), never by sorting a source; among the ``FILL`` documents on each side
   of the stop, the random set that comes closest is taken.

Up to ``MAX_PATTERNS`` patterns are counted and routed on the driver. If there are more, sizes,
quotas and amounts stay tables (:func:`wide_quotas`, :func:`wide_amounts`): the flow of a source
that shares no document with another is its quota, and only the patterns of sources that do
overlap are routed on the driver. Their number is not limited, it only needs the driver's memory.

Defined results: null text has size 0 and is never taken; a null source is a source of its
own and comes last; equal rows are selected together; reruns agree, because the order
depends on seed, doc_id and text alone; an empty table gives no rows.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textvault.llm.shared import WORD, stored

MAX_PATTERNS = 2048
BITS = 10            # hash bits looked at per level
LEVELS = 2           # after them a prefix holds one document in 2^20
FILL = 128           # documents on each side of the stop that may fill the last words
TRIES = 64


def quotas(sizes: dict[str | None, int], weights: tuple[int, ...], most: int) -> dict[str | None, float]:
    """Target words of each source; weights repeat over the sources by code point, null last."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        rest = total - sum(out.values())
        unit = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > most * sizes[s]}
        if not over:
            return out | {s: unit * weight[s] for s in open_}
        out |= {s: float(most * sizes[s]) for s in over}
        open_ -= over
    return out


class Flow:
    """Maximum flow by blocking flows; capacities may be raised between runs."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []

    def edge(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> None:
        while True:
            far = [-1] * len(self.out)
            far[s], queue = 0, deque([s])
            while queue:
                a = queue.popleft()
                for e in self.out[a]:
                    if self.room[e] and far[self.to[e]] < 0:
                        far[self.to[e]] = far[a] + 1
                        queue.append(self.to[e])
            if far[t] < 0:
                return
            at, path, a = [0] * len(self.out), [], s
            while True:
                if a == t:
                    push = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= push
                        self.room[e ^ 1] += push
                    path, a = [], s
                elif at[a] == len(self.out[a]):
                    if not path:
                        break
                    e = path.pop()
                    a = self.to[e ^ 1]
                    at[a] += 1
                else:
                    e = self.out[a][at[a]]
                    if self.room[e] and far[self.to[e]] == far[a] + 1:
                        path.append(e)
                        a = self.to[e]
                    else:
                        at[a] += 1


def route(patterns: list[tuple[tuple[str | None, ...], int]], quota: dict[str | None, float], most: int) -> list[dict[str | None, int]]:
    """Words that each pattern gives to each source, at least cost.

    Only the edges that leave the origin cost anything (0 for the first use of a
    pattern's words, 1, 2, ... for repetitions), so exhausting the flow use by use
    is a min-cost flow.
    """
    source = {s: len(patterns) + i for i, s in enumerate(quota)}
    origin, sink = len(patterns) + len(quota), len(patterns) + len(quota) + 1
    flow = Flow(sink + 1)
    for s, q in quota.items():
        flow.edge(source[s], sink, round(q))
    member = [{s: flow.edge(i, source[s], most * words) for s in names} for i, (names, words) in enumerate(patterns)]
    uses = [flow.edge(origin, i, 0) for i in range(len(patterns))]
    for _ in range(most):
        for i, (_, words) in enumerate(patterns):
            flow.room[uses[i]] += words
        flow.run(origin, sink)
    return [{s: flow.room[e ^ 1] for s, e in edges.items()} for edges in member]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_prefix(level: int) -> Column:
    return F.shiftrightunsigned("h", 64 - BITS * level)


def closest_fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Of the documents around the stop, a random set whose words come closest to the gap.

    First-fit in ``TRIES`` orders seeded by the documents' own hashes; the best one stays.
    """
    rows = rows.sort_values(["h", "size"])
    words = rows["words"].to_numpy()
    gap = int(rows["gap"].iloc[0]) + int(words[rows["before"].to_numpy()].sum())
    rng = np.random.default_rng(rows["h"].to_numpy().view(np.uint64))
    best, least = np.zeros(len(words), np.int32), gap
    for _ in range(TRIES):
        left, keep = gap, np.zeros(len(words), np.int32)
        for k in rng.permutation(len(words)):
            if words[k] <= left:
                keep[k], left = 1, left - words[k]
        if left < least:
            best, least = keep, left
        if not least:
            break
    return rows[["pattern", "h", "size"]].assign(more=best)


def wide_quotas(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(s, source_size, target) of a table (s, source_size) of any length, as :func:`quotas` gives them."""
    order = F.col("s").asc_nulls_last()
    dealt = stored(sizes.repartitionByRange(64, order).withColumn("part", F.spark_partition_id()), "mix-sources")
    before = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + F.coalesce("before", F.lit(0))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    placed = stored(dealt.join(F.broadcast(before), "part").withColumn("weight", weight).select("s", "source_size", "weight"), "mix-weights")
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    if not total:
        return placed.select("s", "source_size", F.lit(0.0).alias("target"))
    unit, n = 0.0, -1
    while True:
        over = F.lit(unit) * F.col("weight") > most * F.col("source_size")
        r = placed.agg(F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, most * F.col("source_size"))), F.lit(0)).alias("taken"),
                       F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if r["n"] == n or not r["weight"]:
            break
        n, unit = r["n"], (total - r["taken"]) / r["weight"]
    target = F.least(F.lit(unit) * F.col("weight"), (most * F.col("source_size")).cast("double"))
    return placed.select("s", "source_size", target.alias("target"))


def wide_amounts(patterns: DataFrame, facts: DataFrame, most: int) -> DataFrame:
    """(pattern, words, take) of any number of patterns (pattern, words, s): a flow only where sources overlap."""
    spark = patterns.sparkSession
    shared = stored(patterns.filter(F.size("s") > 1).select(F.explode("s").alias("o")).distinct(), "mix-shared")
    first, fact = F.col("s")[0], facts.select(F.col("s").alias("o"), "target")
    same = first.eqNullSafe(F.col("o"))
    single = patterns.filter(F.size("s") == 1)
    lone = single.join(shared, same, "left_anti").join(fact, same).select(
        "pattern", "words", F.least(F.rint("target").cast("long"), most * F.col("words")).alias("take"))
    mixed_ = patterns.filter(F.size("s") > 1).unionByName(single.join(shared, same, "left_semi")).orderBy("pattern").collect()
    quota = {r["o"]: r["target"] for r in fact.alias("f").join(shared.alias("g"), F.col("f.o").eqNullSafe(F.col("g.o")), "left_semi").orderBy(
        F.col("o").asc_nulls_last()).collect()}
    given = route([(tuple(r["s"]), r["words"]) for r in mixed_], quota, most)
    schema = "pattern string, words long, take long"
    routed = spark.createDataFrame([(r["pattern"], r["words"], sum(g.values())) for r, g in zip(mixed_, given, strict=True)], schema)
    none = patterns.filter(F.size("s") == 0).select("pattern", "words", F.lit(0).cast("long").alias("take"))
    return stored(lone.unionByName(routed).unionByName(none), "mix-amounts")


def plan(units: DataFrame, amounts: DataFrame, small: bool) -> tuple[DataFrame, DataFrame]:
    """(pattern, all, stop) and (pattern, h, size, more) of the documents around the stop.

    ``units``: pattern, h, size, words (of all equal rows). ``amounts``: pattern, its
    words and the words to take; ``small`` if it may be broadcast. ``all``: copies of every document;
    documents whose hash prefix is below ``stop`` get one more, unless ``more`` of the second table
    says otherwise.
    """
    hint = F.broadcast if small else lambda df: df
    used = F.col("words") > 0
    state = amounts.select("pattern", F.when(used, F.expr("take div words")).otherwise(0).cast("long").alias("all"), F.lit(0).cast("long").alias("prefix"),
                           F.when(used, F.expr("mod(take, words)")).otherwise(0).cast("long").alias("left"))
    for level in range(1, LEVELS + 1):
        inside = units.join(hint(state.select("pattern", "prefix", "left")), "pattern")
        if level > 1:
            inside = inside.filter(hash_prefix(level - 1) == F.col("prefix"))
        sums = inside.groupBy("pattern", "left", hash_prefix(level).alias("b")).agg(F.sum("words").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("pattern").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
        edge = (sums.withColumn("upto", upto).filter((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("words") <= F.col("left")))
                .select("pattern", "b", (F.col("left") - F.col("upto") + F.col("words")).alias("rest")))
        state = stored(state.join(edge, "pattern", "left").select("pattern", "all", F.coalesce("b", "prefix").alias("prefix"),
                                                                  F.coalesce("rest", "left").alias("left")), "mix-stops")
    stops = hint(state.select("pattern", "all", F.col("prefix").alias("stop"), F.col("left").alias("gap")))
    there = units.join(stops, "pattern").filter("words > 0").withColumn("before", hash_prefix(LEVELS) < F.col("stop"))
    place = F.shiftrightunsigned("h", 1)

    def next_to_stop(before: bool) -> DataFrame:
        order = [place.desc(), F.col("h").desc(), F.col("size").desc()] if before else [place, F.col("h"), F.col("size")]
        side = there.filter(F.col("before") if before else ~F.col("before"))
        return side.withColumn("nth", F.row_number().over(Window.partitionBy("pattern").orderBy(*order))).filter(F.col("nth") <= FILL)

    around = next_to_stop(True).unionByName(next_to_stop(False)).select("pattern", "h", "size", "words", "gap", "before")
    chosen = around.groupBy("pattern").applyInPandas(closest_fill, "pattern string, h long, size long, more int")
    return stops.select("pattern", "all", "stop"), chosen


def driver_amounts(spark: SparkSession, by_pattern: list, weights: tuple[int, ...], most: int) -> tuple[DataFrame, DataFrame]:
    """(s, source_size, target) and (pattern, words, take) of patterns on the driver."""
    by_pattern.sort(key=lambda r: r["pattern"])
    sizes: dict[str | None, int] = {}
    for r in by_pattern:
        for s in r["s"]:
            sizes[s] = sizes.get(s, 0) + r["words"]
    total = sum(r["words"] for r in by_pattern)
    quota = quotas(sizes, weights, most) if total else dict.fromkeys(sizes, 0.0)
    given = route([(tuple(r["s"]), r["words"]) for r in by_pattern], quota, most)
    return (spark.createDataFrame([(s, sizes[s], float(quota[s])) for s in sizes], "s string, source_size long, target double"),
            spark.createDataFrame([(r["pattern"], r["words"], sum(g.values())) for r, g in zip(by_pattern, given, strict=True)],
                                  "pattern string, words long, take long"))


def mix_tables(docs: DataFrame, members: Column, seed: int = 7, weights: tuple[int, ...] = (1, 2, 3), most: int = 3,
               id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Copies of every document: ``docs`` plus ``mix_size``, ``mix_pattern`` and ``mix_copies``; and (s, source_size, target).

    ``members`` is an array of the sources a row belongs to.
    """
    pattern = F.to_json(F.struct(F.array_sort(F.array_distinct(members)).alias("s")), {"ignoreNullFields": "false"})
    order = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    rows = docs.withColumns({"mix_size": word_count(F.col(text_col)), "mix_pattern": pattern, "mix_order": order})
    units = stored(rows.groupBy(F.col("mix_pattern").alias("pattern"), F.col("mix_order").alias("h"), F.col("mix_size").alias("size"))
                   .agg(F.sum("mix_size").alias("words")), "mix-units")
    patterns = units.groupBy("pattern").agg(F.sum("words").alias("words")).select(
        "pattern", "words", F.from_json("pattern", "s array<string>")["s"].alias("s"))
    by_pattern = patterns.limit(MAX_PATTERNS + 1).collect()
    small = len(by_pattern) <= MAX_PATTERNS
    if small:
        facts, amounts = driver_amounts(docs.sparkSession, by_pattern, weights, most)
    else:
        patterns = stored(patterns, "mix-patterns")
        sizes = patterns.select(F.explode("s").alias("s"), "words").groupBy("s").agg(F.sum("words").alias("source_size"))
        facts = stored(wide_quotas(sizes, weights, most), "mix-quotas")
        amounts = wide_amounts(patterns, facts, most)
    hint = F.broadcast if small else lambda df: df
    stops, chosen = plan(units, amounts, small)
    chosen = stored(chosen, "mix-chosen").select(F.col("pattern").alias("mix_pattern"), F.col("h").alias("mix_order"),
                                                 F.col("size").alias("mix_size"), F.col("more").alias("mix_more"))
    stops = stops.select(F.col("pattern").alias("mix_pattern"), F.col("all").alias("mix_all"), F.col("stop").alias("mix_stop"))
    h = F.shiftrightunsigned("mix_order", 64 - BITS * LEVELS)
    more = F.coalesce(F.col("mix_more"), (h < F.col("mix_stop")).cast("int"))
    out = (rows.join(hint(stops), "mix_pattern")
           .join(hint(chosen), ["mix_pattern", "mix_order", "mix_size"], "left")
           .withColumn("mix_copies", F.when(F.col("mix_size") > 0, F.least(F.col("mix_all") + more, F.lit(most))).otherwise(0).cast("long")))
    return out.select(*[F.col(c) for c in docs.columns], "mix_size", "mix_pattern", "mix_copies"), hint(facts)


def mix(docs: DataFrame, members: Column, seed: int = 7, weights: tuple[int, ...] = (1, 2, 3), most: int = 3,
        id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict, dict]:
    """:func:`mix_tables` with sizes and quotas as dictionaries."""
    rows, facts = mix_tables(docs, members, seed, weights, most, id_col, text_col)
    got = facts.collect()
    return rows, {r["s"]: r["source_size"] for r in got}, {r["s"]: r["target"] for r in got}


def taken(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row (each row has one source)."""
    rows, facts = mix_tables(docs.select("doc_id", "text", "source"), F.array("source"), seed)
    rows = rows.withColumnRenamed("source", "origin")
    return (rows.join(facts, F.col("origin").eqNullSafe(F.col("s")))
            .select("doc_id", F.col("mix_size").alias("size"), "source_size", "target",
                    (F.col("mix_size") * F.col("mix_copies")).alias("taken")))


def mixed(docs: DataFrame, seed: int = 7) -> DataFrame:
    """``docs`` as the mix takes them: a row per copy, none for what it leaves out; columns unchanged, whatever their names."""
    rows, _ = mix_tables(docs.select(F.struct("*").alias("mix_row"), "doc_id", "text", "source"), F.array("source"), seed)
    return (rows.filter(F.col("mix_copies") > 0)
            .withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))))
            .select("mix_row.*"))
