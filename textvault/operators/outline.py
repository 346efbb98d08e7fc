"""Outline hierarchy from ordered (doc, idx, level) entries.

Parent = nearest earlier entry with a lower level: one pass over each document's
ordered entries with a stack of open levels. Siblings and children follow by windows and
a grouping on (doc, parent).

Defined results: an entry without a level belongs to the entry that is open before it and has no children.
A document's entries are one task's work, as a level may refer to any entry before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def with_parents(entries: DataFrame, doc: str = "doc", idx: str = "idx", level: str = "level") -> DataFrame:
    """Add ``parent``; entries stream through their task in order, which keeps one stack."""
    ordered = entries.repartition(doc).sortWithinPartitions(doc, idx)
    d, i, lv = (entries.columns.index(c) for c in (doc, idx, level))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, stack = object(), []
        for b in batches:
            parents = []
            for this, at, depth in zip(b.column(d).to_pylist(), b.column(i).to_pylist(), b.column(lv).to_pylist(), strict=True):
                if this != current:
                    current, stack = this, []
                while depth is not None and stack and stack[-1][0] >= depth:
                    stack.pop()
                parents.append(stack[-1][1] if stack else None)
                if depth is not None:
                    stack.append((depth, at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(parents, pa.int64())], [*b.schema.names, "parent"])

    return ordered.mapInArrow(link, StructType(list(entries.schema.fields)).add("parent", "long"))


def outline_links(entries: DataFrame, doc: str = "doc", idx: str = "idx", level: str = "level") -> DataFrame:
    """Add parent, prev, next (siblings), first_child, last_child (idx values or NULL)."""
    x = with_parents(entries, doc, idx, level)
    sib = Window.partitionBy(doc, "parent").orderBy(idx)
    x = x.withColumn("prev", F.lag(idx).over(sib)).withColumn("next", F.lead(idx).over(sib))
    kids = (x.filter(F.col("parent").isNotNull()).groupBy(doc, "parent")
            .agg(F.min(idx).alias("first_child"), F.max(idx).alias("last_child"))
            .withColumnRenamed("parent", idx))
    return x.join(kids, [doc, idx], "left")


def toc_line(level: str = "level", title: str = "title", page: str = "page"):
    """Indented outline text: 4 spaces per level below 1, title, 4 spaces, page."""
    return F.concat(F.repeat(F.lit("    "), F.col(level) - 1), F.col(title), F.lit("    "), F.col(page).cast("string"))
