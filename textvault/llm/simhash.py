"""SimHash near-duplicates by anchor-point covering.

A covering code splits the fingerprint space into anchors: the perfect binary Golay code
of length 23 reaches every 23-bit word within distance 3 of exactly one codeword. Two
blocks of a fingerprint are covered this way, so an anchor is a pair of codewords and
every fingerprint has one *home* anchor.

If two fingerprints differ in at most ``t`` bits, of which ``d1`` and ``d2`` fall into the
blocks, the second lies within ``3 + d1`` and ``3 + d2`` of the first one's home. So each
fingerprint is replicated to all anchors within covering radius plus threshold
(``d1 + d2 <= t``; about 61 of 16.8 million for ``t = 2``) and compared there with the
fingerprints that are at home. This finds every link, each at the home of either end.

Scale: equal fingerprints are one row from the start, so copies cost nothing. A task
streams its sorted anchors and keeps only the home fingerprints of one; anchors that
are home to very many are split by salt. A fingerprint has at most
``1 + 64 + 2016`` neighbours, and a task reports a spanning forest of what it found, never
all pairs. Components are merged by large-star / small-star rounds on Spark, each cut by a
reliable checkpoint.

Defined results: null or empty text has no words and the fingerprint zero, which links
like any other; fewer words than a shingle make one shingle; equal rows share a
component; null doc_ids take part but are not named as component unless a component has
nothing else (then null); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from textvault.llm.shared import cut, small_batches, stored

SEED = 42
GOLAY = 0b110001110101          # fixed value: generator polynomial of the binary Golay code
N, RADIUS = 23, 3
HOT_HOMES = 2048                # home fingerprints of an anchor that one task compares
HOT_LIST = 10_000               # anchors that may be split; bounds what is broadcast
BLOCK = 1 << 20                 # pairs compared at a time
MANY = 16_384                   # from so many fingerprints at an anchor on, neighbours are looked up instead


# fingerprints

def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits, each set if set in over half of the shingles' hashes (signed)."""
    import xxhash
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()     # ASCII case and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        h = xxhash.xxh64_intdigest(joined, SEED)
        return h - (1 << 64) if h >> 63 else h
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = (end - size)[:len(words) - shingle + 1].tolist()
    end = end[shingle - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(begin), 1 << 15):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(begin[k:k + (1 << 15)], end[k:k + (1 << 15)], strict=True)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(begin), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    @F.pandas_udf(LongType())
    def f(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(t, shingle) for t in batch], dtype="int64")

    return f(text)


# anchors

def syndrome(word: int) -> int:
    """Remainder of a 23-bit word by the generator polynomial."""
    for k in range(N - 1, 10, -1):
        if word >> k & 1:
            word ^= GOLAY << (k - 11)
    return word


class Covering:
    """Error patterns of the Golay code by syndrome and by how far beyond the radius they reach."""

    def __init__(self, threshold: int):
        self.threshold = threshold
        low, high = np.array([syndrome(x) for x in range(1 << 12)]), np.array([syndrome(x << 12) for x in range(1 << 11)])
        self.low, self.high = low, high
        found: list[list[list[int]]] = [[[] for _ in range(1 << 11)] for _ in range(threshold + 1)]
        for weight in range(RADIUS + threshold + 1):
            for bits in combinations(range(N), weight):
                e = sum(1 << b for b in bits)
                found[max(0, weight - RADIUS)][int(low[e & 4095] ^ high[e >> 12])].append(e)
        self.count = [np.array([len(p) for p in level]) for level in found]
        self.start = [np.concatenate([[0], np.cumsum(c)[:-1]]) for c in self.count]
        self.errors = [np.array([e for p in level for e in p], np.int64) for level in found]

    def syndromes(self, block: np.ndarray) -> np.ndarray:
        return self.low[block & 4095] ^ self.high[block >> 12]

    def anchors(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into ``fp``, anchor, home) of all replicas; the home comes with home = 1 as well."""
        blocks = [(fp >> s) & ((1 << N) - 1) for s in (0, N)]
        syn = [self.syndromes(b) for b in blocks]
        rows, keys, homes = [], [], []
        for d1 in range(self.threshold + 1):
            for d2 in range(self.threshold + 1 - d1):
                n1, n2 = self.count[d1][syn[0]], self.count[d2][syn[1]]
                n = n1 * n2
                at = np.repeat(np.arange(len(fp)), n)
                k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                e1 = self.errors[d1][self.start[d1][syn[0][at]] + k // n2[at]]
                e2 = self.errors[d2][self.start[d2][syn[1][at]] + k % n2[at]]
                key = (blocks[0][at] ^ e1) << N | (blocks[1][at] ^ e2)
                rows.append(at)
                keys.append(key)
                homes.append(np.zeros(len(at), np.int8))
                if d1 == d2 == 0:
                    rows.append(at)
                    keys.append(key)
                    homes.append(np.ones(len(at), np.int8))
        return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def replicated(classes: DataFrame, threshold: int) -> DataFrame:
    """(anchor, home, fp) of every distinct fingerprint."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Covering(threshold)
        for b in batches:
            fp = b.column(0).to_numpy()
            for k in range(0, len(fp), 2048):
                at, key, home = code.anchors(fp[k:k + 2048])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(home), pa.array(fp[k:k + 2048][at])], ["anchor", "home", "fp"])

    return classes.select("fp").mapInArrow(spread, "anchor long, home byte, fp long")


# comparison

def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the same components as the links (a, b): node and smallest node."""
    nodes, idx = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = idx[:len(a)], idx[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    off = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[off], nodes[label[off]]


def links(home: np.ndarray, other: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of different fingerprints within the threshold, as a star forest."""
    if len(other) > MANY and threshold <= 2:
        masks = np.array([sum(1 << b for b in bits) for n in range(1, threshold + 1) for bits in combinations(range(64), n)], np.uint64).view(np.int64)
        ordered, parts = np.sort(other), []
        for m in masks:
            want = home ^ m
            at = np.minimum(np.searchsorted(ordered, want), len(ordered) - 1)
            hit = ordered[at] == want
            if hit.any():
                parts.append((home[hit], want[hit]))
            if len(parts) >= 64:
                parts = [forest(*map(np.concatenate, zip(*parts, strict=True)))]
    else:
        parts, step = [], max(1, BLOCK // max(1, len(other)))
        for k in range(0, len(home), step):
            i, j = np.nonzero(np.bitwise_count((home[k:k + step, None] ^ other[None, :]).view(np.uint64)) <= threshold)
            x, y = home[k:k + step][i], other[j]
            parts.append(forest(x[x != y], y[x != y]))
    return forest(*map(np.concatenate, zip(*parts, strict=True))) if parts else (home[:0], home[:0])


def compared(rows: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) found at the anchors; ``rows`` is sorted by anchor, salt, home first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, homes = None, np.zeros(0, np.int64)             # the group that is still open
        for b in batches:
            if not b.num_rows:
                continue
            anchor, salt, home, fp = (b.column(i).to_numpy() for i in range(4))
            new = np.flatnonzero((anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])) + 1
            begin, end = np.concatenate([[0], new]), np.concatenate([new, [len(fp)]])
            if key != (anchor[0], salt[0]):
                homes = fp[:0]
            n_home = np.add.reduceat(home.astype(np.int64), begin)
            parts = []
            # groups of one home inside the batch: all at once
            size = end - begin
            one = (n_home == 1) & (size > 1)
            one[0] &= not len(homes)
            at = np.repeat(begin[one], size[one])
            row = at + np.arange(len(at)) - np.repeat(np.cumsum(size[one]) - size[one], size[one])
            near = (np.bitwise_count((fp[at] ^ fp[row]).view(np.uint64)) <= threshold) & (fp[at] != fp[row])
            if near.any():
                parts.append((fp[at][near], fp[row][near]))
            many = (n_home > 1) & (size > 1)
            many[0] |= bool(len(homes))
            for g in np.flatnonzero(many):
                h = fp[begin[g]:begin[g] + n_home[g]]
                h = np.concatenate([homes, h]) if g == 0 else h
                parts.append(links(h, fp[begin[g] + n_home[g]:end[g]], threshold))
            last = len(begin) - 1
            mine = fp[begin[last]:begin[last] + n_home[last]]
            homes = np.concatenate([homes, mine]) if last == 0 else mine.copy()
            key = (anchor[-1], salt[-1])
            if parts:
                x, y = forest(*map(np.concatenate, zip(*parts, strict=True)))
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return rows.select("anchor", "salt", "home", "fp").mapInArrow(run, "a long, b long")


def near_links(classes: DataFrame, threshold: int) -> DataFrame:
    """A forest of links (a, b) with the components of all links between distinct fingerprints."""
    spark = classes.sparkSession
    rows = replicated(classes, threshold)
    homes = rows.filter("home = 1").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_HOMES)
    hot = homes.orderBy(F.desc("n"), "anchor").limit(HOT_LIST).collect()
    salts = spark.createDataFrame([(r["anchor"], -(-r["n"] // HOT_HOMES)) for r in hot], "anchor long, salts int")
    all_salts = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
    own = F.array(F.pmod(F.xxhash64("fp"), F.coalesce("salts", F.lit(1))).cast("int"))
    dealt = (rows.join(F.broadcast(salts), "anchor", "left")
             .select("anchor", "home", "fp", F.explode(F.when(F.col("home") == 1, own).otherwise(all_salts)).alias("salt")))
    ordered = dealt.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", F.desc("home"))
    return compared(ordered, threshold)


# components

def star_round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges (a, b) with a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    large = (both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
             .filter("a <> b").distinct())
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")),
                                                             F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return small.select("e.a", "e.b").filter("a <> b").distinct()


def components(links_: DataFrame) -> DataFrame:
    """(a, b): every node that isn't the smallest of its component, with the smallest."""
    edges = cut(links_.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == state or not now["n"]:
            return edges
        state = now
        edges = cut(star_round(edges))


def grouped(prints: DataFrame, threshold: int = 2) -> DataFrame:
    """(fp, root, first_id, least_fp): class of every distinct fingerprint.

    ``first_id`` is the smallest doc_id of the component (null only if it has none) and
    ``least_fp`` a fingerprint of that document.
    """
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("fp").alias("fp"))
    classes = stored(prints.groupBy("fp").agg(F.min(own).alias("first")), "simhash-classes")
    stars = components(near_links(classes, threshold)).select(F.col("a").alias("fp"), F.col("b").alias("root"))
    rooted = classes.join(stars, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = rooted.groupBy("root").agg(F.min("first").alias("best"))
    return rooted.join(first, "root").select("fp", "root", F.col("best.id").alias("first_id"), F.col("best.fp").alias("least_fp"))


def prints_of(docs: DataFrame, shingle: int = 3) -> DataFrame:
    return small_batches(docs).select("doc_id", fingerprint_column(F.col("text"), shingle).alias("fp"))


def near_duplicates(docs: DataFrame, threshold: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    prints = stored(prints_of(docs, shingle), "simhash-prints")
    return prints.join(grouped(prints, threshold), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first_id").alias("component_id"))


def keep_first(docs: DataFrame, threshold: int = 2, shingle: int = 3) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id; columns unchanged, whatever their names.

    Equal keys (repeated rows of that document) keep one row. Texts shuffle once, by
    fingerprint and doc_id, so a large group of copies is spread.
    """
    prints = stored(prints_of(docs, shingle), "simhash-prints")
    chosen = grouped(prints, threshold).filter("fp = least_fp").select(
        F.col("fp").alias("sim_fp"), F.col("first_id").isNull().alias("sim_none"), F.coalesce("first_id", F.lit(0)).alias("sim_id"))
    keyed = docs.select(F.struct("*").alias("sim_all"), fingerprint_column(F.col("text"), shingle).alias("sim_fp"),
                        F.col("doc_id").isNull().alias("sim_none"), F.coalesce("doc_id", F.lit(0)).alias("sim_id"))
    kept = keyed.join(chosen, ["sim_fp", "sim_none", "sim_id"], "left_semi")
    one = Window.partitionBy("sim_fp", "sim_none", "sim_id").orderBy(F.xxhash64("sim_all.text"))
    return kept.withColumn("sim_row", F.row_number().over(one)).filter("sim_row = 1").select("sim_all.*")
