"""Integer vectors, and tiles of a stated query set against all rows.

A tile is one group of queries and one slice of the rows; it is one task's work. Queries of a tile
come first and are held (a group is bounded), then the rows are streamed past them in Arrow
batches. So queries are sent once to each slice and rows once to each group; the memory of a task
depends on the group alone, and neither queries nor rows ever pass through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_BYTES = 8 << 20     # of query components a task holds, as 64-bit numbers
SLICE = 1 << 20           # rows streamed past them
PARTITIONS = 20_000       # partitions the tiles are dealt over, at most
LEAST_SLICE = 4_096       # rows, below which no more slices are cut for the sake of idle cores
LARGEST = 1 << 62         # squared length from which a vector takes no part: scores of two others fit a long


def integers(column) -> list[np.ndarray | None]:
    """floor(256 * x) of every vector of an Arrow list column; None where a vector takes no part."""
    values = column.flatten()
    known = np.ones(len(values), bool) if not values.null_count else values.is_valid().to_numpy(zero_copy_only=False)
    x = np.floor(256.0 * values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64))
    good = known & np.isfinite(x) & (np.abs(x) < 2.0 ** 31)
    ends = np.cumsum(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~good)])
    whole, out = np.where(good, x, 0).astype(np.int64), []
    for i, (end, there) in enumerate(zip(ends.tolist(), valid.tolist(), strict=True)):
        start = int(ends[i - 1]) if i else 0
        v = whole[start:end] if there and bad[start] == bad[end] else None
        out.append(v if v is None or (v.astype(np.float64) ** 2).sum() < LARGEST else None)
    return out


def integer_vectors(vectors: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``vec`` (little-endian 32-bit integers) and ``norm2`` (their squared length).

    Vectors that are null or hold null or non-finite components, and those whose squared integer
    length doesn't fit (:data:`LARGEST`), take no part. Null ids go too, as no result could name them.
    """
    rows = vectors.filter(F.col(keep[0]).isNotNull() & F.col("embedding").isNotNull()).select(*keep, F.col("embedding").cast("array<double>"))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["vec binary", "norm2 long"])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = integers(b.column(len(keep)))
            at = [i for i, v in enumerate(made) if v is not None]
            yield pa.RecordBatch.from_arrays([*b.select(keep).take(pa.array(at, pa.int64())).columns,
                                              pa.array([made[i].astype("<i4").tobytes() for i in at], pa.binary()),
                                              pa.array([int((made[i] ** 2).sum()) for i in at], pa.int64())], [*keep, "vec", "norm2"])

    return rows.mapInArrow(convert, schema)


def matrix(column, width: int) -> np.ndarray:
    """Vectors of a binary column as rows of ``width`` integers; shorter ones are followed by zeros."""
    out = np.zeros((len(column), width), np.int64)
    if not len(column):
        return out
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset:column.offset + len(column) + 1]
    if (np.diff(ends) == 4 * width).all():
        out[:] = np.frombuffer(data, "<i4", len(column) * width, int(ends[0])).reshape(len(column), width)
        return out
    for i, v in enumerate(column.to_pylist()):
        v = np.frombuffer(v, "<i4")
        out[i, :len(v)] = v
    return out


def slices(n: int, cores: int) -> int:
    """How many slices ``n`` rows are cut into."""
    return max(1, math.ceil(n / SLICE), min(2 * cores, n // LEAST_SLICE))


def groups(n: int, width: int) -> int:
    """How many groups ``n`` queries of ``width`` components are dealt over."""
    return max(1, math.ceil(n * 8 * max(width, 16) / GROUP_BYTES))


class Best:
    """The k best (score, id) of each slot, larger scores first, ties by smaller id; mergeable by adding."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score, self.id = np.full((slots, k), -LARGEST), np.zeros((slots, k), np.int64)
        self.floor = np.full(slots, -LARGEST)                 # scores below cannot enter any more

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        order = np.lexsort((ids, -score, slot))
        s = slot[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        place = np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)]))
        keep = place < self.k
        touched, row = np.unique(s[keep], return_inverse=True)
        new_score, new_id = np.full((len(touched), self.k), -LARGEST), np.zeros((len(touched), self.k), np.int64)
        new_score[row, place[keep]], new_id[row, place[keep]] = score[order[keep]], ids[order[keep]]
        both, names = np.concatenate([self.score[touched], new_score], 1), np.concatenate([self.id[touched], new_id], 1)
        top = np.lexsort((names, -both), axis=-1)[:, :self.k]
        self.score[touched], self.id[touched] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
        self.floor[touched] = np.maximum(self.floor[touched], self.score[touched, -1])

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, place = np.nonzero(self.score > -LARGEST)
        return slot, self.score[slot, place], self.id[slot, place]


def each_tile(queries: DataFrame, rows: DataFrame, tiles: int, order: list[str], schema: str,
              work: Callable[[pa.RecordBatch], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | None]]) -> DataFrame:
    """Run ``work`` on every tile.

    ``queries`` and ``rows`` have the same columns, among them ``tile`` (below ``tiles``); ``order`` is the order in which
    a tile's rows are streamed. ``work(queries of the tile)`` returns a function that is called with each batch of
    its rows and at last with None, when it may yield results.
    """
    both = queries.withColumn("kind", F.lit(0)).unionByName(rows.withColumn("kind", F.lit(1)))
    dealt = both.repartitionById(min(tiles, PARTITIONS), F.col("tile").cast("int")).sortWithinPartitions("tile", "kind", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, step = None, [], None

        def finish():
            if step is not None:
                yield from step(None)

        for b in batches:
            if not b.num_rows:
                continue
            at, kind = b.column("tile").to_numpy(), b.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(at) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if tile != at[lo]:
                    yield from finish()
                    tile, held, step = at[lo], [], None
                part = b.slice(lo, hi - lo)
                if kind[lo] == 0:
                    held.append(part)
                elif held:
                    if step is None:
                        step = work(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    step(part)
        yield from finish()

    return dealt.mapInArrow(run, schema)
