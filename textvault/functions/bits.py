"""Sign bits of vectors packed into longs, and their distances: JVM-side, no Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BITS = 64


def _or(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))


def pack_signs(v: Column, dim: int) -> Column:
    """array<bigint> of ``dim`` bits: bit i of word w is set where component 64 w + i is above 0.

    NULL where the vector is undefined: NULL, another length, or a component that is NULL, NaN or infinite.
    """
    one = F.lit(1).cast("bigint")
    word = lambda w: _or(F.transform(F.slice(v, w * WORD_BITS + 1, WORD_BITS),
                                     lambda x, i: F.when(x > 0, F.call_function("shiftleft", one, i)).otherwise(F.lit(0).cast("bigint"))))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when((F.size(v) == dim) & finite, F.array(*[word(w) for w in range(-(-dim // WORD_BITS))]))


def pack_positions(positions: Column, dim: int) -> Column:
    """array<bigint> with the bits at ``positions`` (an array of numbers from 0) set."""
    one = F.lit(1).cast("bigint")
    inside = lambda w: F.filter(positions, lambda p: F.floor(p / WORD_BITS) == w)
    return F.array(*[_or(F.transform(inside(w), lambda p: F.call_function("shiftleft", one, (p % WORD_BITS).cast("int"))))
                     for w in range(-(-dim // WORD_BITS))])


def _count(a: Column, b: Column, op) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(op(x, y)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, n: s + n)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two packed vectors."""
    return _count(a, b, lambda x, y: x.bitwiseXOR(y))


def jaccard(a: Column, b: Column) -> Column:
    """1 - |a and b| / |a or b|; 0 when both are empty."""
    shared, union = _count(a, b, lambda x, y: x.bitwiseAND(y)), _count(a, b, lambda x, y: x.bitwiseOR(y))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.lit(1.0) - shared / union)


def tanimoto(a: Column, b: Column) -> Column:
    """-log2(similarity); NULL when nothing is shared, 0 when both are empty."""
    shared, union = _count(a, b, lambda x, y: x.bitwiseAND(y)), _count(a, b, lambda x, y: x.bitwiseOR(y))
    return F.when(union == 0, F.lit(0.0)).when(shared > 0, -F.log2(shared / union))


METRICS = {"HAMMING": hamming, "JACCARD": jaccard, "TANIMOTO": tanimoto}


def block(bits: Column, number: int, width: int) -> Column:
    """The ``number``-th run of ``width`` bits (a divisor of 64) as a number."""
    per = WORD_BITS // width
    shifted = F.call_function("shiftrightunsigned", F.get(bits, F.lit(number // per)), F.lit(number % per * width))
    return shifted.bitwiseAND(F.lit((1 << width) - 1).cast("bigint")).cast("int")
