"""Sentences, units and greedy chunk packing as Column expressions.

The packing is a left fold over unit indices that carries only three small
values (chunk start, running length, list of chunk ends), so it is linear in
the number of units and never copies growing strings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textvault.functions.text import ASCII_ALNUM, SENTENCE_END, WS, WS_CLASS, py_strip

_T = SENTENCE_END
SENTENCE_REGEX = f"(?s)(.[^{_T}]*[{_T}]?)"
# The same class with its ASCII part first, which is looked up in a table, and a range before the other characters: a
# union of ranges and properties costs a call each for every character it doesn't hold.
_T_FAST = ".!?;[\u3002-\uFF1F&&[。！？；]]"
TERMINATOR_FIRST = f"(?s)[{_T_FAST}](?<=^.|[{_T}].)"     # a line in which a terminator starts a sentence
PLAIN_SENTENCE = f"[^{_T_FAST}]+[{_T_FAST}]?"            # a sentence where none does
# Default word tokenizer: runs of letters/marks/digits/underscore, or one other
# non-space character. Our own deterministic rule (documented in the README).
WORD_REGEX = f"[\\p{{L}}\\p{{M}}\\p{{N}}_]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_{WS_CLASS}]"
# the same for Java: the commonest characters of either class are looked up first
_WORD_FAST = f"[{ASCII_ALNUM}_[\\p{{L}}\\p{{M}}\\p{{N}}]]+|[^ \\n{ASCII_ALNUM}_[\\p{{L}}\\p{{M}}\\p{{N}}{WS_CLASS}]]"


def text_to_sentences(c: Column) -> Column:
    """array<string>: a sentence is one char, then up to the next terminator.

    Unless a terminator is the first char of a sentence, these are the runs up to each terminator,
    which take a fraction of the time.
    """
    parts = F.when(c.rlike(TERMINATOR_FIRST), F.regexp_extract_all(c, F.lit(SENTENCE_REGEX), 1)).otherwise(F.regexp_extract_all(c, F.lit(PLAIN_SENTENCE), 0))
    return F.filter(F.transform(parts, py_strip), lambda s: s != "")


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(_WORD_FAST), 0)


class PandasTokenizer:
    """A Python word tokenizer ``tokenize(sentence) -> list[str]``; ``PART`` texts are held as Python words at a time."""

    PART = 128

    def __init__(self, tokenize: Callable[[str], list[str]]):
        self.tokenize = tokenize

    def __call__(self, pieces: Column, threshold: float) -> Column:
        """Words of each piece of a text; pieces below the threshold stay whole."""
        tokenize, part = self.tokenize, self.PART

        @F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
        def words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                for a in range(0, len(texts), part):
                    yield pd.Series([[[s] if len(s) < threshold else list(tokenize(s)) for s in t] for t in texts[a:a + part]], dtype=object)

        return words(pieces)


def text_to_units(c: Column, size: int = 400, word_tokenizer=word_tokens) -> Column:
    """Chunking units: short lines whole, else short sentences whole, else words.

    ``word_tokenizer`` maps a sentence Column to words, or is a :class:`PandasTokenizer`, which gets the
    long sentences of a text as one array (Python cannot run inside a lambda).
    """
    threshold = size / 10.0
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n", -1), py_strip),
                     lambda l: l != "")
    is_short = lambda x: F.length(x) < threshold
    if isinstance(word_tokenizer, PandasTokenizer):
        pieces = F.flatten(F.transform(lines, lambda l: F.when(is_short(l), F.array(l)).otherwise(text_to_sentences(l))))
        return F.flatten(word_tokenizer(pieces, threshold))

    def per_sentence(s):
        return F.when(is_short(s), F.array(s)).otherwise(word_tokenizer(s))

    def per_line(l):
        return F.when(is_short(l), F.array(l)).otherwise(
            F.flatten(F.transform(text_to_sentences(l), per_sentence)))

    return F.flatten(F.transform(lines, per_line))


def _last(arr: Column, k: int) -> Column:
    """The last k elements (all of them when shorter)."""
    return F.slice(arr, F.greatest(F.lit(1), F.size(arr) - k + 1), k)


def _full(items: Column, limit: int | None) -> Column:
    """Whether ``limit`` chunks are closed; None never stops. A first chunk is always kept."""
    return F.lit(False) if limit is None else F.size(items) >= max(int(limit), 1)


def chunk_bounds(units: Column, size: int = 400, overlap: int = 0, limit: int | None = None) -> Column:
    """array<struct<s:int,e:int>>: 0-based inclusive unit ranges of each chunk.

    Greedy rule: add units until the running length exceeds ``size``; close the
    chunk; seed the next one with the last ``overlap`` units (clamped at the
    first unit); stop after ``limit`` chunks; emit a non-empty tail. The fold
    reads only its own state and the current length, never the outer array.
    """
    lens = F.transform(units, lambda u: F.length(u).cast("long"))
    zero = F.lit(0).cast("long")

    def step(acc, ln):
        i = acc["i"]
        run = acc["run"] + ln
        recent = _last(F.array_append(acc["recent"], ln), overlap) if overlap > 0 else None
        carry = F.aggregate(recent, zero, lambda a, x: a + x) if overlap > 0 else zero
        done = _full(acc["ends"], limit)
        closed = run > size
        return F.struct(
            (i + 1).alias("i"),
            F.when(done, acc["run"]).when(closed, carry).otherwise(run).alias("run"),
            F.when(done | ~closed, acc["ends"]).otherwise(F.array_append(acc["ends"], i)).alias("ends"),
            *([recent.alias("recent")] if overlap > 0 else []))

    init = F.struct(F.lit(0).alias("i"), zero.alias("run"), F.array().cast("array<int>").alias("ends"),
                    *([F.array().cast("array<long>").alias("recent")] if overlap > 0 else []))

    def finish(acc):
        ends = acc["ends"]
        tail = ~_full(ends, limit) & (acc["run"] > 0)
        all_ends = F.when(tail, F.array_append(ends, acc["i"] - 1)).otherwise(ends)
        starts = F.concat(F.array(F.lit(0)), F.transform(F.slice(all_ends, 1, F.greatest(F.size(all_ends) - 1, F.lit(0))),
                                                           lambda e: F.greatest(F.lit(0), e - overlap + 1)))
        return F.zip_with(starts, all_ends, lambda s_, e: F.struct(s_.alias("s"), e.alias("e")))

    return F.aggregate(lens, init, step, finish)


def explode_items(df: DataFrame, arr, pos: str, item: str, *keep: str) -> DataFrame:
    """posexplode that keeps the array computation in one place.

    A plain ``posexplode`` makes the optimizer infer ``size(arr) > 0`` and push
    it below the projection, re-evaluating the whole array expression in a
    filter; the outer form has no inferred filter, and nulls are dropped after.
    """
    x = df.select(*keep, F.posexplode_outer(arr).alias(pos, item))
    return x.filter(F.col(pos).isNotNull())


def keep_rows(df: DataFrame, condition: Column) -> DataFrame:
    """``df.filter(condition)`` that keeps the computation of its columns in one place.

    A plain filter on a computed column is pushed below the projection, which evaluates the whole expression
    once more for every use in the condition; a filter on a generated column stays where it is.
    """
    return df.withColumn("_kept", F.explode_outer(F.when(condition, F.array(F.lit(True))))).filter("_kept is not null").drop("_kept")


def with_chunks(df: DataFrame, text_col: str, out: str = "chunks", size: int = 400, overlap: int = 0,
                limit: int | None = None, word_tokenizer=word_tokens) -> DataFrame:
    """Add ``out`` = chunk texts of ``text_col`` in three narrow projections.

    1. units of each text (one column);
    2. chunk bounds from a fold over unit lengths (integer state only);
    3. one ``slice`` + ``array_join`` per chunk.
    The unit column is referenced twice in step 3, so the optimizer keeps it
    as its own projection and the slice lambda reads a column instead of
    recomputing the units.
    """
    u = df.withColumn("_units", text_to_units(F.col(text_col), size, word_tokenizer))
    b = u.withColumn("_bounds", chunk_bounds(F.col("_units"), size, overlap, limit))
    return b.withColumn(out, F.when(F.size("_units") == 0, F.array().cast("array<string>")).otherwise(
        F.transform("_bounds", lambda x: F.array_join(F.slice(F.col("_units"), x["s"] + 1, x["e"] - x["s"] + 1), " ")))
    ).drop("_units", "_bounds")


__all__ = ["text_to_sentences", "word_tokens", "text_to_units", "chunk_bounds", "explode_items",
           "keep_rows", "with_chunks", "SENTENCE_REGEX", "WORD_REGEX", "WS"]
