"""Minimax contiguous sharding: the smallest capacity that ``shards`` runs of groups need.

Groups (equal texts) are atomic and stand in the order of their smallest doc_id.
Shards are runs of that order; the largest shard is to be as small as possible
(law ``bytes``). The capacity is found by binary search with a greedy check: fill a
shard up to the capacity, cut, go on.

The check only needs prefix sums of the group sizes. The driver sees them coarse to
fine: the sums at the ends of at most ``BLOCKS`` blocks, then, block by block, what
lies inside the few blocks in which a cut can still fall. While a block is closed, a
cut inside it is taken at its start (feasible) or anywhere (not proven infeasible),
which gives a capacity from above and one from below; opening the blocks between them
makes both meet. So the result is exact and the driver never holds more than a few
times ``BLOCKS`` numbers, whatever the input.

A group larger than a fair share is a shard's least capacity; its rows are never
brought together: sizes are added up map-side and places come from counts.

Defined results: a null text has size 1, like an empty one, and belongs to the group of
empty texts; repeated rows are rows of their own; null doc_ids are placed by their
group like others; an empty table gives no rows; with fewer groups than shards the
later shards are empty.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textvault.llm.shared import ranked, stored

BLOCKS = 8192        # prefix sums the driver sees at a time, before refining
INNER = 512          # parts a block is opened into


class Prefix:
    """Known prefix sums ``at`` (0 and the total included); ``closed[i]``: the first row
    number and the rows between ``at[i]`` and ``at[i + 1]`` if sums inside are unknown."""

    def __init__(self, at: list[int], closed: dict[int, tuple[int, int]]):
        self.at, self.closed = at, closed

    def cuts(self, capacity: int, shards: int, hopeful: bool) -> list[int] | None:
        """Greedy cuts; None if ``shards`` runs do not reach the end."""
        pos, out = 0, []
        for _ in range(shards):
            i = bisect_right(self.at, pos + capacity) - 1
            to = self.at[i]
            if hopeful and to < self.at[-1] and to in self.closed:
                to = pos + capacity
            pos = to
            out.append(pos)
        return out if pos >= self.at[-1] else None

    def least(self, low: int, high: int, shards: int, hopeful: bool) -> int:
        """The smallest capacity in (low, high] for which the greedy check succeeds."""
        while low + 1 < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.cuts(mid, shards, hopeful) else (mid, high)
        return high


def grouped(docs: DataFrame) -> DataFrame:
    """One row per equal text: key, first doc_id, bytes. Adds up map-side, so a hot text is one row per task."""
    return (docs.groupBy("key").agg(F.min("doc_id").alias("first"), F.sum("size").alias("bytes")))


def summed(ordered: DataFrame) -> DataFrame:
    """(part, row, key, bytes, upto): rows of each range partition in order with running sums inside it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, rows, total = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            size = b.column(1).to_numpy()
            upto = np.cumsum(size) + total
            row = np.arange(rows, rows + len(size), dtype=np.int64)
            rows, total = rows + len(size), int(upto[-1]) if len(size) else total
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(size), part, np.int32)), pa.array(row), b.column(0), b.column(1), pa.array(upto)],
                ["part", "row", "key", "bytes", "upto"])

    return ordered.select("key", "bytes").mapInArrow(run, "part int, row long, key string, bytes long, upto long")


def ends(sums: DataFrame, runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(part, first row, rows, largest running sum) of the pieces of the given runs of rows.

    A run is (part, first row, rows, rows of a piece); the list is bounded and goes out as a
    broadcast table.
    """
    wanted = sums.sparkSession.createDataFrame(runs, "part int, first long, n long, step long")
    pieces = (sums.join(F.broadcast(wanted), "part")
              .filter((F.col("row") >= F.col("first")) & (F.col("row") < F.col("first") + F.col("n")))
              .groupBy("part", "first", F.floor((F.col("row") - F.col("first")) / F.col("step")).alias("piece"))
              .agg(F.max("upto").alias("upto"), F.min("row").alias("from"), F.count(F.lit(1)).alias("n")))
    return [(r["part"], r["from"], r["n"], r["upto"]) for r in pieces.collect()]


def minimax(sums: DataFrame, shards: int) -> tuple[list[int], dict[int, int], int]:
    """Cut positions (prefix sums), the offset of each partition, and the capacity."""
    parts = sorted((r["part"], r["n"], r["upto"], r["most"]) for r in sums.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.max("upto").alias("upto"), F.max("bytes").alias("most")).collect())
    offset, total = {}, 0
    for part, _, upto, _ in parts:
        offset[part], total = total, total + upto
    if not total:
        return [0] * shards, offset, 0
    rows = sum(n for _, n, _, _ in parts)
    known = {0: None}

    def learn(runs):
        for part, first, n, upto in ends(sums, runs):
            known[offset[part] + upto] = (part, first, n)

    learn([(part, 0, n, -(-rows // BLOCKS)) for part, n, _, _ in parts])
    low = max(-(-total // shards), max(m for _, _, _, m in parts)) - 1
    high = low + max(m for _, _, _, m in parts) + 1
    while True:
        at = sorted(known)
        # what ends at at[i + 1] describes the gap that begins at at[i]
        gaps = {a: known[b] for a, b in zip(at, at[1:], strict=False) if known[b][2] > 1}
        prefix = Prefix(at, gaps)
        high = prefix.least(low, high, shards, False)
        low = prefix.least(low, high, shards, True) - 1
        if low + 1 == high:
            sure, hope = prefix.cuts(high, shards, False), prefix.cuts(high, shards, True)
            if sure == hope:
                return sure, offset, high
        opened, early, late = [], 0, 0
        for _ in range(shards):          # where the k-th cut of any capacity still possible can fall
            i, j = bisect_right(at, early + low + 1) - 1, bisect_right(at, late + high) - 1
            opened += [gaps[a] for a in at[i:j + 1] if a in gaps]
            early, late = at[i], min(late + high, at[-1])
        learn([(part, first, n, -(-n // INNER)) for part, first, n in set(opened)])


def shard(docs: DataFrame, shards: int = 8, text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
                       F.sha2(F.encode(text, "utf-8"), 256).alias("key"))
    rows = stored(rows, "sizes")
    sums = stored(summed(grouped(rows).orderBy("first", "key")), "group-sums")
    cuts, offset, _ = minimax(sums, shards)
    start = F.lit(0).cast("long")
    if offset:
        start = F.element_at(F.create_map(*[F.lit(x) for part in offset for x in (part, offset[part])]), F.col("part"))
    begins = start + F.col("upto") - F.col("bytes")
    index = F.lit(0)
    for c in cuts[:-1]:
        index = index + (begins >= c).cast("int")
    placed = rows.join(sums.select("key", index.alias("shard")), "key").drop("key")
    slots = ranked(placed, ["shard"], [F.col("doc_id"), F.col("size"), F.col("text_crc32")], "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))
