"""Periodic runs of words, found with longest common extensions over a difference cover.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and at
least ``max(least, exponent * q)`` words that no neighbouring word extends keeping the period.

1. *Difference cover* (:class:`CoverLce`). Of every ``VERSE`` positions only those whose residue is
   in ``COVER`` are sampled, and only their suffixes are sorted: by their first ``VERSE`` words, then
   by prefix doubling in steps of samples. For any two positions some shift below ``VERSE`` takes both
   to samples; so a longest common extension (LCE) compares at most that many words and then asks
   a sparse table (range minimum over the common prefixes of neighbouring suffixes).
2. *Harmonic grid* (:func:`find_runs`). A run of period p contains a pair (i, i + p) with i on any
   grid of step ``max(least, exponent * p) - p``; for every period the grid points are extended to the
   right and, on the reversed words, to the left. That is O(n log n) constant-time extensions a text.
3. *Smallest period.* A stretch with a period p and a smaller one is the same maximal stretch for
   both (its length is at least 2p), so of equal stretches the smallest period stays.

Documents are independent rows: no shuffle. The texts of an Arrow batch (bounded in bytes) are
handled together, each with word numbers of its own, so that no extension crosses a text.

Defined results: null and empty texts have no words and no runs; repeated rows give repeated
results; an empty table gives none; a null doc_id stays null; extra columns are not looked at.
A very long text is one row and so one task's work, O(n log n) in its words.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textvault.llm.shared import WORD, small_batches

VERSE = 13
COVER = (0, 1, 3, 9)         # every difference modulo 13 occurs among these
GRID = 1 << 18               # grid points extended together

_IN_COVER = np.isin(np.arange(VERSE), COVER)
_SHIFT = np.array([[next(d for d in range(VERSE) if _IN_COVER[(a + d) % VERSE] and _IN_COVER[(b + d) % VERSE])
                    for b in range(VERSE)] for a in range(VERSE)])
_SPLIT = re.compile(WORD)


def _ranks(order: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Dense ranks from 0 of rows sorted by ``order``; rows with equal keys share one."""
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


class CoverLce:
    """Longest common extensions to the right between positions of ``words`` (numbers from 1)."""

    def __init__(self, words: np.ndarray):
        n = self.n = len(words)
        self.words = np.concatenate([words, np.zeros(VERSE, words.dtype)])      # no word: 0
        pos = np.flatnonzero(_IN_COVER[np.arange(n) % VERSE])
        self.sample = np.full(n + VERSE, -1, np.int64)        # position -> number of its sample
        self.sample[pos] = np.arange(len(pos))
        # the first VERSE words, as many to a key as fit
        bits = max(1, int(words.max()).bit_length()) if n else 1
        per = max(1, 62 // bits)
        keys = []
        for a in range(0, VERSE, per):
            key = np.zeros(len(pos), np.int64)
            for t in range(a, min(a + per, VERSE)):
                key = (key << bits) | self.words[pos + t]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        rank, length = _ranks(order, keys), VERSE
        levels = [(length, rank)]
        while len(order) and rank[order[-1]] < len(order) - 1:
            after = self._at(rank, pos + length) + 1
            order = np.argsort(rank * (len(pos) + 1) + after, kind="stable")
            rank, length = _ranks(order, [rank, after]), 2 * length
            levels.append((length, rank))
        self.rank = rank
        # common prefixes of neighbouring suffixes, from the levels downwards and then word by word
        a, b = pos[order[:-1]], pos[order[1:]]
        common = np.zeros(len(a), np.int64)
        for size, level in reversed(levels):
            x, y = self._at(level, a + common), self._at(level, b + common)
            common[(x == y) & (x >= 0)] += size
        common += self._few(a + common, b + common, np.full(len(a), VERSE))[0]
        self.table = [common]
        while 2 << (len(self.table) - 1) <= len(common):
            t, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(t[:-half], t[half:]))

    def _at(self, level: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """The ranks at sampled positions; -1 beyond the end."""
        out = np.full(len(positions), -1, np.int64)
        inside = np.flatnonzero(positions < self.n)
        out[inside] = level[self.sample[positions[inside]]]
        return out

    def _few(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal words from i and j on, at most ``most`` (below or equal VERSE), and which rows got that far."""
        got, live = np.zeros(len(i), np.int64), np.arange(len(i))
        for t in range(VERSE):
            x, y = i[live] + t, j[live] + t
            live = live[(most[live] > t) & (x < self.n) & (y < self.n)]
            live = live[self.words[i[live] + t] == self.words[j[live] + t]]
            if not len(live):
                break
            got[live] += 1
        return got, got == most

    def extend(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Numbers of equal words from positions i and j (i < j) on."""
        got, more = self._few(i, j, _SHIFT[i % VERSE, j % VERSE])
        more = np.flatnonzero(more & (j + got < self.n))
        if len(more):
            a, b = self.rank[self.sample[i[more] + got[more]]], self.rank[self.sample[j[more] + got[more]]]
            low, high = np.minimum(a, b), np.maximum(a, b)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            for k in np.unique(level):
                at = np.flatnonzero(level == k)
                t = self.table[k]
                got[more[at]] += np.minimum(t[low[at]], t[high[at] - (1 << int(k))])
        return got


def find_runs(words: np.ndarray, sizes: np.ndarray, least: int = 6, exponent: int = 4) -> np.ndarray:
    """Rows (text, start, length, period), sorted, of all runs.

    ``words`` holds the word numbers (from 1) of texts of ``sizes`` words one after the other; no
    number occurs in two texts.
    """
    n = len(words)
    offset = np.cumsum(sizes) - sizes
    longest = np.where(sizes >= least, sizes // exponent, 0)
    if not longest.any():
        return np.zeros((0, 4), np.int64)
    right, left = CoverLce(words), CoverLce(words[::-1])
    text = np.repeat(np.arange(len(sizes)), longest)
    period = np.arange(len(text)) - np.repeat(np.cumsum(longest) - longest, longest) + 1
    step = np.maximum(least, exponent * period) - period
    points = -(-(sizes[text] - period) // step)
    ends = np.cumsum(points)
    found, at = [], 0
    while at < len(text):
        base = ends[at] - points[at]
        to = max(at + 1, int(np.searchsorted(ends, base + GRID, side="right")))
        pair = np.repeat(np.arange(at, to), points[at:to])
        k = np.arange(len(pair)) - np.repeat(ends[at:to] - points[at:to] - base, points[at:to])
        p, i = period[pair], offset[text[pair]] + k * step[pair]
        same = np.flatnonzero(words[i] == words[i + p])
        pair, p, i = pair[same], p[same], i[same]
        end = i + p + right.extend(i, i + p)
        start, inner = i.copy(), np.flatnonzero(i > offset[text[pair]])
        x = n - i[inner]                                      # reversed: the word before i is at n - i
        start[inner] -= left.extend(x - p[inner], x)
        keep = end - start >= step[pair] + p
        rows = np.stack([start[keep], end[keep], p[keep], text[pair[keep]]], 1)
        found.append(_distinct(rows))
        at = to
    s, e, p, t = _distinct(np.concatenate(found)).T
    out = np.stack([t, s - offset[t], e - s, p], 1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Of rows (start, end, period, text) with one stretch the one of smallest period."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)
    return rows[first]


def words_of(doc_id, text: str | None) -> list[str]:
    return _SPLIT.findall(text or "")


def periodic_tail(doc_id, text: str | None) -> list[str]:
    """The words, made periodic from some word on in one document of ten (by a checksum of its id; none for a null id)."""
    words = words_of(doc_id, text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a:a + p]
    return words[:a] + (cycle * (-(-(n - a) // p)))[:n - a]


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, exponent: int = 4,
         words: Callable[[object, str | None], list[str]] = words_of) -> DataFrame:
    """Per document its id, ``runs`` (start, length, period of each run by start, then period) and ``collapsed``:
    the words joined by one space, without what any run repeats after its first period.

    ``words`` makes the words of a row from its id and text.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    fields = ["start", "length", "period"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [words(i, t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            sizes, counter, numbers = np.array([len(x) for x in lists], np.int64), itertools.count(1), []
            for x in lists:
                number = defaultdict(counter.__next__)        # numbers go on from text to text
                numbers.append(np.fromiter(map(number.__getitem__, x), np.int64, len(x)))
            all_words = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
            rows = find_runs(all_words, sizes, least, exponent)
            cuts = np.searchsorted(rows[:, 0], np.arange(len(lists) + 1))
            collapsed = []
            for x, lo, hi in zip(lists, cuts[:-1], cuts[1:], strict=True):
                if hi > lo:
                    cover = np.zeros(len(x) + 1, np.int64)
                    _, start, length, period = rows[lo:hi].T
                    np.add.at(cover, start + period, 1)
                    np.add.at(cover, start + length, -1)
                    x = list(itertools.compress(x, (np.cumsum(cover[:-1]) == 0).tolist()))
                collapsed.append(" ".join(x))
            structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in (1, 2, 3)], fields)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), structs), pa.array(collapsed, pa.string())],
                                             [id_col, "runs", "collapsed"])

    return small_batches(docs).select(F.col(id_col), F.col(text_col)).mapInArrow(find, schema)


def greatest(runs_col: Column) -> Column:
    """The run of greatest exact length / period, the first of equals; null without runs."""
    larger = lambda a, b: a["length"] * b["period"] < b["length"] * a["period"]
    return F.aggregate(F.slice(runs_col, 2, F.greatest(F.size(runs_col), F.lit(1))), F.get(runs_col, F.lit(0)),
                       lambda a, b: F.when(larger(a, b), b).otherwise(a))


def report(docs: DataFrame) -> DataFrame:
    """Contract columns: n_runs, the greatest run, and checksums of all runs and of the collapsed text.

    ``exponent_milli`` is floor(1000 * length / period).
    """
    best = runs(docs, words=periodic_tail).withColumn("best", greatest(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
                       F.col("best.period").alias("period"), F.expr("1000L * best.length div best.period").alias("exponent_milli"),
                       F.sha2(F.encode(listed, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))
