"""Exact repeated passages by common-prefix intervals of enhanced suffix arrays.

A repeat is a byte string of at least ``length`` (100) bytes that starts at two places.

1. *Partition of the suffixes.* Among the 32-byte strings of each 100-byte window the one
   with the smallest hash is its anchor; equal windows have equal anchors, so all suffixes
   that share 100 bytes meet under one anchor. Consecutive windows with the same anchor
   form a *run*, one row of about 31 windows.
2. *Classes.* Runs with equal bytes are one class, found by hashes within a batch first and
   then over the sorted anchors. All but the first of a class repeat it wholly. Anchors
   that occur once are dropped.
3. *Suffix arrays.* For anchors with several classes the bytes of one run per class are
   fetched, the suffixes of its windows sorted, their common prefixes scanned with a stack,
   and every interval of common prefix >= 100 whose suffixes differ in the byte to the left
   is a maximal repeat with all its occurrences (:func:`intervals`). All but its
   first occurrence are repeated bytes. Within a run a repeat cannot grow beyond the run;
   a longer passage is reported run by run, overlapping.
4. *The rest.* An anchor with more than ``MANY_CLASSES`` different runs (the edge of a
   passage that very many texts share) is not collected: its runs are cut again by longer
   anchors (``FINER`` bytes), where what lies inside the passage falls into equal runs
   and is done; the windows of what is still too many are split by their own 128-bit hash
   and the first of each is found by a distributed sort.

Nothing is cut off: texts are read whole in pieces of ``PIECE`` bytes, so a very long text
needs no more memory than a short one until its own result is written.

Defined results: null text is empty; texts shorter than ``length`` keep everything; "first"
is by doc_id (null last), then place; rows with the same doc_id are ordered by a 64-bit hash of
the text, and of fully equal rows one is the first; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from textvault.llm.shared import small_batches, stored

GRAM = 32                 # bytes of an anchor
PIECE = 1 << 19           # bytes of texts whose anchors are computed together
FINER = (64, 90)          # bytes of the anchors that split too many runs
MANY_CLASSES = 256        # different runs of one anchor that a task sorts; beyond, see 4.
LAST = (1 << 63) - 1      # stands for a null doc_id, which comes last
MIX = 0x9E3779B97F4A7C15
BASES = (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
WORD64 = (1 << 64) - 1


class Hasher:
    """Polynomial hashes of byte ranges modulo 2^64 from running sums."""

    def __init__(self, base: int, seed: int):
        self.sign = np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)
        self.base, self.back = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, b: np.ndarray) -> np.ndarray:
        n = len(b) + 1
        if len(self.up) < n:
            self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, self.base, np.uint64))])
            self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, self.back, np.uint64))])
        return np.concatenate([[np.uint64(0)], np.cumsum(self.sign[b] * self.up[:len(b)])])

    def ranges(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (sums[end] - sums[begin]) * self.down[begin]
        h ^= h >> np.uint64(32)
        h *= np.uint64(MIX)
        return h ^ (h >> np.uint64(29))


class Runs:
    """Runs of windows with the same anchor, over many texts at once."""

    def __init__(self, length: int, size: int = GRAM):
        self.length, self.size, self.width = length, size, length - size + 1
        self.gram, self.seg = Hasher(BASES[0], 1), Hasher(BASES[1], 2)

    def find(self, b: np.ndarray, ends: np.ndarray, first: int) -> tuple[np.ndarray, ...]:
        """(start in ``b``, windows, anchor, hash of the run) for texts that end at ``ends``.

        ``first`` bytes before the texts belong to the first one's earlier piece.
        """
        n = len(b) - self.length + 1
        if n <= 0:
            none = np.zeros(0, np.int64)
            return none, none, none, none
        sums = self.gram.sums(b)
        at = np.arange(len(b) - self.size + 1)
        h = self.gram.ranges(sums, at, at + self.size)
        low = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
        step = 1
        while step * 2 <= self.width:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < self.width:
            low = np.minimum(low[:step - self.width], low[self.width - step:])
        anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        off = np.zeros(len(b) + 1, np.int64)                 # windows that would cross a text's end
        begins = np.concatenate([[0], ends[:-1]])
        np.add.at(off, np.maximum(begins, ends - self.length + 1), 1)
        np.add.at(off, ends, -1)
        valid = np.cumsum(off)[:n] == 0
        valid[:first] = False
        change = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        start = np.flatnonzero(valid & (change | ~np.concatenate([[False], valid[:-1]])))
        stop = np.flatnonzero(valid & np.concatenate([change[1:] | ~valid[1:], [True]])) + 1
        left = np.maximum(start - 1, 0)
        left = np.where(np.isin(start, begins), start, left)
        s = self.seg.sums(b)
        seg = self.seg.ranges(s, left, stop + self.length - 1) ^ ((stop - left).astype(np.uint64) * np.uint64(MIX))
        return start, stop - start, h[anchor[start]].view(np.int64), seg.view(np.int64)


def pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(first text, last text + 1, from, to, known bytes in front) of pieces of about PIECE bytes.

    Short texts go together; a long one is read in pieces that overlap by a window
    and the byte before it.
    """
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + PIECE, side="right")) - 1
        if j > i:
            yield i, j, int(offsets[i]), int(offsets[j]), 0
            i = j
            continue
        at, end = int(offsets[i]), int(offsets[i + 1])
        while at < end:
            front = 1 if at > offsets[i] else 0
            yield i, i + 1, at - front, min(end, at + PIECE + length - 1), front
            at += PIECE
        i += 1


def run_rows(docs: DataFrame, length: int) -> DataFrame:
    """(kind, anchor, seg, d, th, start, run): kind 1 repeats a kind 0 row of the same batch."""
    schema = "kind byte, anchor long, seg long, d long, th long, start int, run int"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(length)
        for batch in batches:
            d, th, text = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).cast(pa.large_string())
            buffers = text.buffers()
            offsets = np.frombuffer(buffers[1], np.int64)[text.offset:text.offset + len(text) + 1]
            data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
            found = []
            for i, j, a, b, front in pieces(offsets, length):
                start, run, anchor, seg = runs.find(data[a:b], np.minimum(offsets[i + 1:j + 1], b) - a, front)
                doc = i + np.searchsorted(offsets[i + 1:j + 1], start + a, side="right")
                found.append((anchor, seg, doc, start + a - offsets[doc], run))
            if not found:
                continue
            anchor, seg, doc, start, run = map(np.concatenate, zip(*found, strict=True))
            order = np.lexsort((start, th[doc], d[doc], seg, anchor))
            anchor, seg, doc, start, run = (x[order] for x in (anchor, seg, doc, start, run))
            dd, tt = d[doc], th[doc]
            again = np.concatenate([[False], (anchor[1:] == anchor[:-1]) & (seg[1:] == seg[:-1])]) if len(doc) else np.zeros(0, bool)
            same = np.concatenate([[False], (dd[1:] == dd[:-1]) & (tt[1:] == tt[:-1]) & (start[1:] == start[:-1])]) if len(doc) else again
            keep = ~(again & same)                            # rows of fully equal documents
            cols = [x[keep] for x in (again.astype(np.int8), anchor, seg, dd, tt, start.astype(np.int32), run.astype(np.int32))]
            for k in range(0, len(cols[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[k:k + 50_000]) for c in cols], ["kind", "anchor", "seg", "d", "th", "start", "run"])

    return docs.mapInArrow(find, schema)


def marked(rows: DataFrame) -> DataFrame:
    """Rows of anchors that occur more than once: kind 1 repeats an earlier run, kind 0 is a class's first.

    Rows that already are kind 1 only pass; they are dealt apart from their (hot) anchors.
    """
    schema = "kind byte, anchor long, d long, th long, start int, run int"
    dealt = rows.repartition(F.when(F.col("kind") == 0, F.col("anchor")).otherwise(F.xxhash64("d", "start")))
    ordered = dealt.sortWithinPartitions("kind", "anchor", "seg", "d", "th", "start")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "anchor", "seg", "d", "th", "start", "run"]
        held, before = None, None                             # the last row waits for the next one

        def out(c, n):
            """Rows 0..n-1 of the columns, which may have one more row to look at."""
            nonlocal before
            kind, anchor, seg = c["kind"], c["anchor"], c["seg"]
            fields = ("kind", "anchor", "seg", "d", "th", "start")
            prev = before or (-1, 0, 0, 0, 0, 0)
            pk, pa_, ps, pd_, pt, pp = (np.concatenate([np.array([x], c[k].dtype), c[k][:-1]]) for x, k in zip(prev, fields, strict=True))
            same_anchor = (kind == pk) & (anchor == pa_)
            with_next = np.concatenate([same_anchor[1:], [False]])
            later = (kind == 1) | (same_anchor & (seg == ps))
            itself = later & (c["d"] == pd_) & (c["th"] == pt) & (c["start"] == pp) & same_anchor   # a fully equal row
            keep = (((kind == 1) | same_anchor | with_next) & ~itself)[:n]
            before = tuple(int(c[k][n - 1]) for k in fields)
            cols = [later.astype(np.int8)] + [c[k] for k in ("anchor", "d", "th", "start", "run")]
            return pa.RecordBatch.from_arrays([pa.array(x[:n][keep]) for x in cols], ["kind", "anchor", "d", "th", "start", "run"])

        for b in batches:
            c = {k: b.column(i).to_numpy() for i, k in enumerate(names)}
            if not b.num_rows:
                continue
            if held is not None:
                c = {k: np.concatenate([held[k], v]) for k, v in c.items()}
            n = len(c["kind"]) - 1
            held = {k: v[n:] for k, v in c.items()}
            if n:
                yield out(c, n)
        if held is not None:
            yield out(held, 1)

    return ordered.mapInArrow(mark, schema)


def common(a: bytes, b: bytes, least: int) -> int:
    """Length of the common prefix; 0 if below ``least``."""
    n = min(len(a), len(b))
    if n < least or a[:least] != b[:least]:
        return 0
    if a[:n] == b[:n]:
        return n
    low, high = least, n
    while low + 1 < high:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def intervals(segments: list[bytes], lead: list[int], windows: list[int], least: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, occurrences) of the maximal repeats among the windows of the segments.

    An occurrence is (segment, offset of its window). ``lead`` is 1 if a segment's first
    byte stands to the left of its first window. The suffix array is scanned once with a
    stack of open intervals; an interval carries the byte to the left of its suffixes, or
    -1 once two of them differ or one is at the start of its run.
    """
    order = sorted(((s[lead[k] + o:], k, o) for k, s in enumerate(segments) for o in range(windows[k])), key=lambda x: x[0])

    def left(i: int) -> int:
        _, k, o = order[i]
        return segments[k][lead[k] + o - 1] if o else -1

    stack: list[list[int]] = []                    # [common prefix, first suffix, left byte]
    for i in range(1, len(order) + 1):
        lcp = common(order[i - 1][0], order[i][0], least) if i < len(order) else 0
        first, seen = i - 1, left(i - 1)
        while stack and stack[-1][0] > lcp:
            n, first, mine = stack.pop()
            seen = mine if mine == seen else -1
            if seen == -1:
                yield n, [(k, o) for _, k, o in order[first:i]]
        if stack and stack[-1][0] == lcp:
            stack[-1][2] = stack[-1][2] if stack[-1][2] == seen else -1
        elif lcp:
            stack.append([lcp, first, seen])


def compressed(texts: Column) -> Column:
    """Texts as zstandard blobs, to shuffle less."""
    @F.pandas_udf(BinaryType())
    def shrink(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zstandard
        c = zstandard.ZstdCompressor(level=3)
        for s in it:
            yield pd.Series([c.compress((t or "").encode()) for t in s], dtype=object)

    return shrink(texts)


def plain(blob: bytes) -> bytes:
    import zstandard
    return zstandard.ZstdDecompressor().decompress(blob)


def segments(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(anchor, classes, d, th, start, run, lead, body) of the wanted runs."""
    schema = "anchor long, classes long, d long, th long, start int, run int, lead int, body binary"
    per_doc = wanted.groupBy("d", "th").agg(F.collect_list(F.struct("anchor", "classes", "start", "run")).alias("w"))
    pairs = docs.select("d", "th", compressed(F.col("text")).alias("z")).join(per_doc, ["d", "th"])

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text, d, th = plain(b.column(2)[i].as_py()), b.column(0)[i].as_py(), b.column(1)[i].as_py()
                w = b.column(3)[i].as_py()
                lead = [int(x["start"] > 0) for x in w]
                body = [text[x["start"] - k:x["start"] + x["run"] + length - 1] for x, k in zip(w, lead, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["anchor"] for x in w], pa.int64()), pa.array([x["classes"] for x in w], pa.int64()),
                     pa.array([d] * len(w), pa.int64()), pa.array([th] * len(w), pa.int64()), pa.array([x["start"] for x in w], pa.int32()),
                     pa.array([x["run"] for x in w], pa.int32()), pa.array(lead, pa.int32()), pa.array(body, pa.binary())],
                    ["anchor", "classes", "d", "th", "start", "run", "lead", "body"])

    # equal rows of the same document cut the same runs; the sorts below drop them
    return pairs.mapInArrow(cut_out, schema)


def groups_of(rows: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Consecutive rows with the same anchor (bounded by MANY_CLASSES different ones)."""
    group: list[dict] = []
    for b in rows:
        for r in b.to_pylist():
            if group and group[-1]["anchor"] != r["anchor"]:
                yield group
                group = []
            if not group or any(group[-1][k] != r[k] for k in ("d", "th", "start")):
                group.append(r)
    if group:
        yield group


def scanned(segs: DataFrame, length: int, schema: str, rows_of) -> DataFrame:
    """``rows_of(group, repeats)`` of every anchor, whose classes a task holds together."""
    ordered = segs.repartition("anchor").sortWithinPartitions("anchor", "d", "th", "start")
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    kinds = [types[x.split()[1]] for x in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush():
            b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows.clear()
            return b

        for g in groups_of(batches):
            rows += rows_of(g, intervals([r["body"] for r in g], [r["lead"] for r in g], [r["run"] for r in g], length))
            if len(rows) > 20_000:
                yield flush()
        if rows:
            yield flush()

    return ordered.mapInArrow(scan, schema)


def maximal(segs: DataFrame, length: int) -> DataFrame:
    """(anchor, repeat, length, d, th, home, start, first): occurrences of the maximal repeats among the classes, ``home`` their run's start."""
    def listed(g, repeats):
        for number, (n, places) in enumerate(repeats):
            head = min(places)                                # the rows of a group are in the order of "first"
            for k, o in places:
                yield g[k]["anchor"], number, n, g[k]["d"], g[k]["th"], g[k]["start"], g[k]["start"] + o, (k, o) == head

    return scanned(segs, length, "anchor long, repeat int, length int, d long, th long, home int, start int, first boolean", listed)


def later_spans(segs: DataFrame, length: int) -> DataFrame:
    """(d, th, start, end): what the maximal repeats cover besides their first occurrences, united in each run."""
    def united(g, repeats):
        inside: dict[int, list[tuple[int, int]]] = {}
        for n, places in repeats:
            head = min(places)
            for k, o in places:
                if (k, o) != head:
                    inside.setdefault(k, []).append((o, o + n))
        for k, spans in inside.items():
            d, th, start = g[k]["d"], g[k]["th"], g[k]["start"]
            low, high = None, -1
            for a, b in sorted(spans):
                if a > high:
                    if low is not None:
                        yield d, th, start + low, start + high
                    low = a
                high = max(high, b)
            yield d, th, start + low, start + high

    return scanned(segs, length, "d long, th long, start int, end int", united)


def refined(segs: DataFrame, length: int, size: int) -> DataFrame:
    """The runs of ``segs`` cut by anchors of ``size`` bytes: (kind, anchor, classes, d, th, start, run, lead, body).

    Kind 1 repeats an earlier cut wholly; kind 0 is the first of its class, under an anchor with ``classes`` > 1.
    """
    schema = "anchor long, seg long, d long, th long, start int, run int, lead int, body binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(length, size)
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for r in batch.to_pylist():
                body = r["body"]
                start, run, anchor, seg = runs.find(np.frombuffer(body, np.uint8), np.array([len(body)]), r["lead"])
                for s, n, a, h in zip(start.tolist(), run.tolist(), anchor.tolist(), seg.tolist(), strict=True):
                    lead = int(s > 0)
                    row = (a, h, r["d"], r["th"], r["start"] + s - r["lead"], n, lead, body[s - lead:s + n + length - 1])
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    # A passage of very many texts is one class of as many cuts: its first place is found by partial minima, and joined to
    # the cuts, which a skewed join may split; no task has to see a whole class.
    place = F.struct("d", "th", "start")
    cuts = stored(segs.mapInArrow(find, schema).dropDuplicates(["anchor", "seg", "d", "th", "start"]), "suffix-finer")
    firsts = cuts.groupBy("anchor", "seg").agg(F.min(place).alias("first"))
    marks = cuts.join(firsts, ["anchor", "seg"]).withColumn("kind", (place != F.col("first")).cast("byte"))
    marks = stored(marks.select("kind", *[n for n in names if n != "seg"]), "suffix-cuts")
    several = marks.filter("kind = 0").groupBy("anchor").agg(F.count(F.lit(1)).alias("classes"))
    return marks.join(several.filter("classes > 1"), "anchor", "left").filter("kind = 1 or classes > 1")


def split_windows(segs: DataFrame, length: int) -> DataFrame:
    """(d, th, start) of the windows that are not the first with their bytes, for hot anchors."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                body, lead, n = r["body"], r["lead"], r["run"]
                w = [hashlib.blake2b(body[lead + o:lead + o + length], digest_size=16).digest() for o in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array([r["d"]] * n, pa.int64()), pa.array([r["th"]] * n, pa.int64()),
                                                  pa.array(range(r["start"], r["start"] + n), pa.int32())], ["w", "d", "th", "start"])

    rows = segs.mapInArrow(windows, "w binary, d long, th long, start int")
    ordered = rows.repartition("w").sortWithinPartitions("w", "d", "th", "start")

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head = None, None
        for b in batches:
            keep = []
            for i, (w, *place) in enumerate(zip(*[c.to_pylist() for c in b.columns], strict=True)):
                if w != key:
                    key, head = w, place
                elif place != head:
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64())).select(["d", "th", "start"])

    return ordered.mapInArrow(later, "d long, th long, start int")


def row_key() -> list[Column]:
    """d, th: the doc_id (null last) and 64 bits of the text, which tell rows apart even if all share a doc_id."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64("text", F.octet_length("text")).alias("th")]


def keyed(docs: DataFrame) -> DataFrame:
    """d, th, text: the order of documents; th tells rows with the same doc_id apart."""
    return small_batches(docs).select(*row_key(), F.coalesce("text", F.lit("")).alias("text"))


def found_runs(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Marked runs, and the class firsts of anchors with several classes (with their number)."""
    marks = stored(marked(run_rows(keyed(docs), length)), "suffix-runs")
    firsts = marks.filter("kind = 0")
    several = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    return marks, firsts.join(several, "anchor")


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """(d, th, start, end): byte ranges that also start earlier; they may overlap."""
    marks, wanted = found_runs(docs, length)
    segs = stored(segments(keyed(docs), wanted, length), "suffix-segments")
    whole = lambda df: df.filter("kind = 1").select("d", "th", "start", (F.col("start") + F.col("run") + length - 1).alias("end"))
    spans = whole(marks).unionByName(later_spans(segs.filter(F.col("classes") <= MANY_CLASSES), length))
    for size in FINER:
        cuts = refined(segs.filter(F.col("classes") > MANY_CLASSES), length, size)
        segs = cuts.filter("kind = 0")
        spans = spans.unionByName(whole(cuts)).unionByName(later_spans(segs.filter(F.col("classes") <= MANY_CLASSES), length))
    rest = split_windows(segs.filter(F.col("classes") > MANY_CLASSES), length)
    return spans.unionByName(rest.select("d", "th", "start", (F.col("start") + length).alias("end")))


def maximal_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """(anchor, repeat, length, doc_id, start, first): the maximal repeats with all occurrences, run by run.

    A repeat among different runs is found by the suffix arrays and listed for every member of their classes; a
    class of several equal runs is a repeat itself (negative ``repeat``, unless the suffix arrays list it). Fully
    equal rows count as one. No anchor is left out: unlike in :func:`repeated_spans` one task sorts all
    different runs of an anchor, so a passage with very many surroundings needs that task's memory.
    """
    members = stored(run_rows(keyed(docs), length).select("anchor", "seg", "d", "th", "start", "run").distinct(), "suffix-members")
    heads = stored(members.groupBy("anchor", "seg").agg(F.min(F.struct("d", "th", "start", "run")).alias("h"), F.count(F.lit(1)).alias("n"))
                   .select("anchor", "seg", "h.*", "n"), "suffix-heads")
    several = heads.groupBy("anchor").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    wanted = heads.join(several, "anchor").select("anchor", "classes", "d", "th", "start", "run")
    found = stored(maximal(segments(keyed(docs), wanted, length), length), "suffix-maximal")
    listed = found.join(heads.select("anchor", "seg", "d", "th", F.col("start").alias("home"), "run"), ["anchor", "d", "th", "home"])
    done = listed.filter((F.col("start") == F.col("home")) & (F.col("length") == F.col("run") + length - 1)).select("anchor", "seg").distinct()
    number = -F.row_number().over(Window.partitionBy("anchor").orderBy("seg"))
    equal = heads.filter("n > 1").join(done, ["anchor", "seg"], "left_anti").select(
        "anchor", "seg", number.alias("repeat"), (F.col("run") + length - 1).alias("length"), F.col("d").alias("hd"), F.col("th").alias("hth"),
        F.col("start").alias("home"), F.lit(0).alias("off"), F.lit(True).alias("head"))
    every = listed.select("anchor", "seg", "repeat", "length", F.col("d").alias("hd"), F.col("th").alias("hth"), "home",
                          (F.col("start") - F.col("home")).alias("off"), F.col("first").alias("head")).unionByName(equal)
    itself = (F.col("d") == F.col("hd")) & (F.col("th") == F.col("hth")) & (F.col("start") == F.col("home"))
    return every.join(members.drop("run"), ["anchor", "seg"]).select(
        "anchor", "repeat", "length", F.when(F.col("d") != LAST, F.col("d")).alias("doc_id"), (F.col("start") + F.col("off")).alias("start"),
        (F.col("head") & itself).alias("first"))


def without(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The bytes outside the spans, how many are inside, and the number of maximal spans."""
    out, at, n = [], 0, 0
    for a, b in sorted(spans):
        if a > at or not n:
            out.append(text[at:a])
            n += 1
        at = max(at, b)
    kept = b"".join([*out, text[at:]])
    return kept, len(text) - len(kept), n


def deduplicated(docs: DataFrame, length: int = 100, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``: the remaining text, cut characters replaced)."""
    spans = repeated_spans(docs, length).groupBy("d", "th").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    texts = docs.select("doc_id", *row_key(), compressed(F.col("text")).alias("z"))
    pairs = texts.join(spans, ["d", "th"], "left")
    copy = Window.partitionBy("d", "th").orderBy("d")
    pairs = pairs.withColumn("copy", F.row_number().over(copy) > 1)

    def cut_away(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, z, spans_, again in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                text = plain(z)
                ranges = [(x["start"], x["end"]) for x in spans_ or []]
                if again and len(text) >= length:
                    ranges = [(0, len(text))]
                kept, gone, n = without(text, ranges) if ranges else (text, 0, 0)
                rows.append((doc_id, len(text), gone, n, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None))
            types = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    out = pairs.select("doc_id", "z", "spans", "copy").mapInArrow(
        cut_away, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    return out if with_text else out.drop("kept")
