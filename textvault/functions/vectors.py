"""Vector math on ``array<float>`` columns and the default text embedder.

Pairwise metrics are higher-order-function expressions (JVM-side). The default
embedder cuts tokens in the JVM; an Arrow UDF hashes the distinct ones of a
batch and counts them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textvault.functions.text import ASCII_ALNUM

# Fixed values of the vector store being matched.
DEFAULT_DIM = 512
METRICS = ("L2", "IP", "COSINE", "HAMMING", "JACCARD", "TANIMOTO")

TOKEN_REGEX = r"[\p{L}\p{N}]+"
_TOKEN_FAST = f"[{ASCII_ALNUM}[\\p{{L}}\\p{{N}}]]+"     # the same: the commonest characters are looked up first


def _d(x: Column) -> Column:
    return x.cast("double")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: _d(x) * _d(y)), F.lit(0.0), lambda s, v: s + v)


def sq_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + _d(x) * _d(x))


def l2_squared(a: Column, b: Column) -> Column:
    """Squared euclidean distance: the order used by L2 search."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (_d(x) - _d(y)) * (_d(x) - _d(y))),
                       F.lit(0.0), lambda s, v: s + v)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def inner_product(a: Column, b: Column) -> Column:
    return dot(a, b)


def cosine_distance(a: Column, b: Column) -> Column:
    den = F.sqrt(sq_norm(a)) * F.sqrt(sq_norm(b))
    return F.when(den > 0, F.lit(1.0) - dot(a, b) / den)


def _bits(a: Column) -> Column:
    return F.transform(a, lambda x: x > 0)


def hamming_distance(a: Column, b: Column) -> Column:
    """Differing sign bits."""
    return F.size(F.filter(F.zip_with(_bits(a), _bits(b), lambda x, y: x != y), lambda t: t)).cast("long")


def _inter_union(a: Column, b: Column):
    inter = F.size(F.filter(F.zip_with(_bits(a), _bits(b), lambda x, y: x & y), lambda t: t))
    union = F.size(F.filter(F.zip_with(_bits(a), _bits(b), lambda x, y: x | y), lambda t: t))
    return inter, union


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 - |a and b| / |a or b| over sign bits; 0 when both are empty."""
    inter, union = _inter_union(a, b)
    return F.when(union == 0, F.lit(0.0)).otherwise(F.lit(1.0) - inter / union)


def tanimoto_distance(a: Column, b: Column) -> Column:
    """-log2(similarity) over sign bits; NULL when nothing is shared."""
    inter, union = _inter_union(a, b)
    return F.when(union == 0, F.lit(0.0)).when(inter > 0, -F.log2(inter / union))


def metric(name: str, a: Column, b: Column) -> Column:
    name = name.upper()
    return {
        "L2": l2_squared, "IP": inner_product, "COSINE": cosine_distance,
        "HAMMING": hamming_distance, "JACCARD": jaccard_distance, "TANIMOTO": tanimoto_distance,
    }[name](a, b)


# Words of the distance report.
REPORT = "L2距离: %.{d}f\n余弦距离: %.{d}f"


def distance_report(a: Column, b: Column, digits: int = 4) -> Column:
    """Both distances of a pair as text."""
    return F.format_string(REPORT.replace("{d}", str(digits)), l2_distance(a, b), cosine_distance(a, b))


# --- default embedder -------------------------------------------------------

def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN_FAST), 0)


def token_buckets(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """Bucket of each token: first 4 md5 hex digits as an int, modulo ``dim``."""
    return F.transform(tokens(text),
                       lambda t: (F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int") % dim))


@lru_cache(maxsize=1 << 16)
def _bucket_number(token: bytes) -> int:
    return int.from_bytes(hashlib.md5(token).digest()[:2], "big")


def _dense_from_tokens(dim: int):
    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def dense(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """The vectors of 1024 rows are held at a time; a NULL or empty text is the zero vector. Each
        distinct token of them is hashed once."""
        for lists in batches:
            for a in range(0, len(lists), 1024):
                part = lists.slice(a, 1024)
                n = np.asarray(pc.fill_null(pc.list_value_length(part), 0)).astype(np.int64)
                words = pc.dictionary_encode(part.flatten())
                bucket = np.array([_bucket_number(w) % dim for w in words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)], np.int64)
                at = np.repeat(np.arange(len(part)) * dim, n)
                if len(at):
                    at += bucket[np.asarray(words.indices)]
                at, count = np.unique(at, return_counts=True)          # a vector is mostly zeros, which cost nothing here
                norm = np.sqrt(np.bincount(at // dim, count * count, minlength=len(part)))
                flat = np.zeros(len(part) * dim, np.float32)
                flat[at] = count / norm[at // dim]
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * dim), pa.array(flat))
    return dense


def hashed_embedding(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """L2-normalised hashed bag of lower-cased letter/digit tokens (:func:`token_buckets`).

    A deterministic stand-in for a sentence encoder (not the same vectors).
    """
    return _dense_from_tokens(dim)(tokens(text))


def embedding_json(v: Column) -> Column:
    """JSON text of a vector, as stored next to the SQL rows."""
    return F.to_json(v)
