"""License scan by patience alignment of texts with license templates.

A template and a text are compared as sequences of lower-cased words. Words that occur
exactly once in both are anchors; the longest increasing subsequence of their places (by
patience sorting) aligns them, the gaps between neighbouring anchors are aligned in the
same way, and equal words at the ends of a gap are matched directly
(:func:`aligned`). A template's coverage is the share of its words that are aligned.

A whole document is a bad partner for a short notice, because the notice's words are not
unique in it. So a text is first searched for stretches that could reach a template's bar: at
most ``WIDE`` template lengths that hold as many of the template's words (each as often as the
template has it) as the bar asks for; no alignment reaches the bar in a stretch with fewer.
Where runs of ``SEED`` words of the template show a match that is spread wider, that stretch
is searched too; stretches that overlap make one window. A match is a coverage that reaches the
template's bar.

A window may hold several copies, whose words are then not unique in it. So the template is
also aligned with the stretches that begin where one of its words would have it begin
(:meth:`Templates.matches`); of all that reach the bar those stay that don't overlap and have
the most aligned words together, and what is left between them is aligned again.

Defined results: null and empty text has no license; several licenses, or one several
times, are all reported by place; of overlapping windows of different templates the one with
the most aligned words stays; repeated rows are scanned alike; texts are read whole; an
empty table gives no rows. Rows are independent, so nothing shuffles.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from textvault.llm.shared import small_batches

SEED = 3
WIDE = 2              # template lengths that a match may be spread over without seeds
TOKEN = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")

# Public license notices, (license, kind, text).
TEMPLATES = [
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "header", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS",
WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR
A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("GPL", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "header", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("BSD", "text", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("CC-BY", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA", "notice", "Licensed under CC BY-SA 4.0."),
]
BAR = {"notice": 0.8, "header": 0.6, "text": 0.6}

FOUND = ArrayType(StructType([
    StructField("license", StringType()), StructField("kind", StringType()), StructField("start", IntegerType()),
    StructField("end", IntegerType()), StructField("coverage", DoubleType()), StructField("words", IntegerType())]))


def tokens(text: str) -> list[tuple[str, int, int]]:
    """Lower-cased words with their places."""
    return [(m.group(0).lower(), m.start(), m.end()) for m in TOKEN.finditer(text)]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs that increases in both places; ``pairs`` is sorted by the first."""
    tops: list[int] = []
    top_pair: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        back[i] = top_pair[k - 1] if k else -1
        if k == len(tops):
            tops.append(b)
            top_pair.append(i)
        else:
            tops[k], top_pair[k] = b, i
    out, i = [], top_pair[-1] if top_pair else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def aligned(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of two word sequences by patience alignment (gaps on a work list)."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = increasing([(i, place[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in place])
        at = (a0, b0)
        for i, j in anchors:
            out.append((i, j))
            work.append((at[0], i, at[1], j))
            at = (i + 1, j + 1)
        if anchors:
            work.append((at[0], a1, at[1], b1))
    return sorted(out)


def most_words(found: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (from, to, words) those that don't overlap and have the most words together, in the shortest stretches."""
    order = sorted(found, key=lambda m: (m[1], m[0], m[2]))
    ends = [m[1] for m in order]
    best, back = [(0, 0)], [0]                     # of the first i matches
    for i, (a, b, n) in enumerate(order):
        j = bisect_right(ends, a, 0, i)
        mine = (best[j][0] + n, best[j][1] - (b - a))
        back.append(j if mine > best[i] else -1)
        best.append(max(mine, best[i]))
    out, i = [], len(order)
    while i:
        if back[i] >= 0:
            out.append(order[i - 1])
            i = back[i]
        else:
            i -= 1
    return out[::-1]


class Templates:
    """The templates' words and the runs of ``SEED`` words that lead to them."""

    def __init__(self, templates=None):
        self.all = [(lic, kind, [w for w, _, _ in tokens(t)]) for lic, kind, t in templates or TEMPLATES]
        self.seeds: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
        for k, (_, _, words) in enumerate(self.all):
            for i in range(len(words) - SEED + 1):
                self.seeds[tuple(words[i:i + SEED])].append((k, i))
        # where a template's words stand in it; of a longer one the words that it has once tell its beginnings
        self.places: list[dict[str, list[int]]] = []
        for _, kind, words in self.all:
            at = defaultdict(list)
            for j, w in enumerate(words):
                at[w].append(j)
            self.places.append({w: js for w, js in at.items() if kind == "notice" or len(js) == 1})
        self.first_words = {s[0] for s in self.seeds}
        self.bags = [Counter(words) for _, _, words in self.all]
        self.need = [math.ceil(BAR[kind] * len(words) - 1e-9) for _, kind, words in self.all]
        self.holders: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, bag in enumerate(self.bags):
            for w, n in bag.items():
                self.holders[w].append((k, n))

    def possible(self, words: list[str]) -> list[int]:
        """The templates of whose words a text has as many as the bar asks for."""
        have = Counter(words)
        sums = [0] * len(self.all)
        for w in have.keys() & self.holders.keys():
            for k, n in self.holders[w]:
                sums[k] += min(n, have[w])
        return [k for k, n in enumerate(sums) if n >= self.need[k]]

    def dense(self, k: int, words: list[str]) -> Iterator[tuple[int, int]]:
        """Stretches of at most ``WIDE`` template lengths with as many words of the template as the bar asks for."""
        bag, wide = self.bags[k], WIDE * len(self.all[k][2])
        inside: Counter = Counter()
        places: deque[int] = deque()
        n = 0
        for i, w in enumerate(words):
            if w not in bag:
                continue
            places.append(i)
            inside[w] += 1
            n += inside[w] <= bag[w]
            while places[0] <= i - wide:
                v = words[places.popleft()]
                n -= inside[v] <= bag[v]
                inside[v] -= 1
            if n >= self.need[k]:
                yield places[0], i + 1

    def windows(self, k: int, words: list[str]) -> Iterator[tuple[int, int]]:
        """(from, to): where a template may be, as far as it may reach; windows don't overlap."""
        n = len(self.all[k][2])
        spots = [(max(0, a - n // 2), min(len(words), b + n // 2)) for a, b in self.dense(k, words)]
        begins = sorted(i - j for i, w in enumerate(words) if w in self.first_words
                        for t, j in self.seeds.get(tuple(words[i:i + SEED]), ()) if t == k)      # where the template would begin
        low = high = begins[0] if begins else 0
        for b in [*begins[1:], None] if begins else []:
            if b is None or b > high + n // 2:
                spots.append((max(0, low), min(len(words), high + n + n // 2)))
                low = b
            high = b
        spots.sort()
        at: tuple[int, int] | None = None
        for a, b in spots:
            if at and a < at[1]:
                at = at[0], max(at[1], b)
                continue
            if at:
                yield at
            at = a, b
        if at:
            yield at

    def match(self, k: int, words: list[str], a: int, b: int) -> tuple[int, int, int] | None:
        """(from, to, aligned words) of a template in ``words[a:b]`` if it reaches its bar."""
        pairs = aligned(self.all[k][2], words[a:b])
        if not pairs or len(pairs) < BAR[self.all[k][1]] * len(self.all[k][2]):
            return None
        return a + pairs[0][1], a + pairs[-1][1] + 1, len(pairs)

    def matches(self, k: int, words: list[str], a: int, b: int) -> list[tuple[int, int, int]]:
        """The matches of a template in a window that may hold several copies."""
        n = len(self.all[k][2])
        begins = {max(a, i - j) for i in range(a, b) for j in self.places[k].get(words[i], ())}
        tried = {(a, b)} | {(s, min(b, s + size)) for s in begins for size in (n, n + n // 2, 2 * n)}
        found = {m for x, y in tried if (m := self.match(k, words, x, y))}
        while True:
            kept = most_words(found)
            edges = [a, *(x for f, t, _ in kept for x in (f, t)), b]
            rest = set(zip(edges[::2], edges[1::2], strict=True)) - tried
            more = {m for x, y in rest if (m := self.match(k, words, x, y))} - found
            if not more:
                return kept
            tried |= rest
            found |= more

    def scan(self, text: str | None) -> list[dict]:
        """Licenses of a text by place."""
        words = [w.lower() for w in TOKEN.findall(text)] if text else []
        possible = self.possible(words)
        toks = tokens(text) if possible else []
        found = []
        for k, a, b in ((k, a, b) for k in possible for a, b in self.windows(k, words)):
            lic, kind, template = self.all[k]
            for first, end, n in self.matches(k, words, a, b):
                found.append((n, {"license": lic, "kind": kind, "start": toks[first][1], "end": toks[end - 1][2],
                                  "coverage": n / len(template), "words": n}))
        found.sort(key=lambda x: (-x[0], -x[1]["coverage"], x[1]["start"], x[1]["license"], x[1]["kind"]))
        kept: list[dict] = []                      # by place; none overlaps another
        starts: list[int] = []
        for _, f in found:
            at = bisect_right(starts, f["start"])
            if (not at or kept[at - 1]["end"] <= f["start"]) and (at == len(kept) or f["end"] <= starts[at]):
                kept.insert(at, f)
                starts.insert(at, f["start"])
        return kept


@F.pandas_udf(FOUND)
def license_spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    templates = Templates()
    for batch in texts:
        yield pd.Series([templates.scan(t) for t in batch], dtype=object)


def find_licenses(docs: DataFrame, text_col: str = "text", out: str = "licenses") -> DataFrame:
    """``docs`` plus ``out``: array<struct<license, kind, start, end, coverage, words>> by place."""
    return small_batches(docs).withColumn(out, license_spans(F.col(text_col)))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: its licenses, the best coverage and the places."""
    found = find_licenses(docs.select("doc_id", "text"), out="found_")
    place = lambda x: F.concat_ws(":", x["license"], x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    return found.select(
        "doc_id", F.size("found_").cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("found_", lambda x: x["license"]))), ",").alias("licenses"),
        F.round(F.coalesce(F.array_max(F.transform("found_", lambda x: x["coverage"])), F.lit(0.0)), 6).alias("best_coverage"),
        F.array_join(F.transform("found_", place), ",").alias("spans"))
