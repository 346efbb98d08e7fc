"""Places of a pattern in texts, and periodic sequences."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def occurrence_rows(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, n, place): every 0-based place of ``pattern``, left to right, without overlaps.

    The text is split at the pattern; places are running sums of the pieces' lengths.
    """
    pieces = F.split(F.col(text), re.escape(pattern), -1)
    x = df.select(key, F.posexplode(F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.length(p))).alias("n", "gap"))
    upto = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return x.select(key, "n", (F.sum("gap").over(upto) + F.col("n") * len(pattern)).alias("place"))


def written_times(sizes: Column, largest: int = 10) -> Column:
    """The N (2..``largest``) for which ``sizes`` has N * N items and repeats every N; 0 if none."""
    root = F.round(F.sqrt(F.size(sizes))).cast("int")
    fits = (root * root == F.size(sizes)) & (root >= 2) & (root <= largest)
    ahead = F.slice(sizes, root + 1, F.size(sizes) - root)
    behind = F.slice(sizes, 1, F.size(sizes) - root)
    same = F.forall(F.zip_with(ahead, behind, lambda a, b: a == b), lambda x: x)
    return F.when(fits, F.when(same, root).otherwise(0)).otherwise(0)
