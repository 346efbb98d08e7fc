"""Quality classifier: regularised quadratic discriminant over document statistics.

1. Every whole text becomes a short vector of variance-stabilised statistics
   (:func:`statistics`): logs of counts and lengths, arcsine roots of shares.
2. The vectors are standardised by mean and deviation over *all* documents and limited to
   ``CLIP`` deviations, so one odd statistic cannot decide alone.
3. Per class, count, sum and outer products of the labelled vectors are added up in the
   tasks and by Spark (about 2 d^2 numbers reach the driver, whatever the input), giving
   class means and covariances. A covariance is shrunk towards the pooled one and that
   towards a multiple of the identity.
4. The score is the logistic of the log-density difference: Mahalanobis distances with
   cached inverse Cholesky factors, log-determinants and the log prior, divided by
   ``temper`` because statistics of one text are not independent draws, and drawn to one
   half for texts of few words, whose statistics say little.

Defined results: null text counts as empty and is scored; ``labels`` may repeat a
document (its majority counts, ties are left out) and hold nulls (left out); without
labelled rows of both classes every score is the smoothed share of label 1; an empty
table gives no rows; repeated documents are each scored. Only the text enters a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from textvault.llm.shared import small_batches, stored

CLIP = 5.0
FEW_WORDS = 20.0     # a text of so many words counts half
NAMES = ["words", "word_length", "upper", "digit", "mark", "stop", "other_sign", "wide", "distinct", "top_word",
         "same_next", "same_line", "line_length", "signed_word", "upper_word"]
D = len(NAMES)

# Byte classes.
UPPER, DIGIT = list(range(65, 91)), list(range(48, 58))
MARK = [ord(c) for c in "#*$%&|<>!=~^_@+{}[]\\/"]
STOP = [ord(c) for c in ".,;:?'\"()-"]
SIGNED = re.compile(r"[#*$%&|<>!=~^_@+{}\[\]\\/]")


def share(a: float, n: float) -> float:
    """Arcsine root of a share: its deviation hardly depends on its size."""
    return float(np.arcsin(np.sqrt(min(1.0, a / n)))) if n else 0.0


def statistics(text: str | None) -> np.ndarray:
    text = text or ""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    n, words = len(text), text.split()
    m = len(words)
    chars = n - int(raw[[9, 10, 13, 32]].sum())
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    same_next = sum(map(str.__eq__, words[1:], words))
    return np.array([
        np.log1p(m), np.log1p(chars / m) if m else 0.0, share(raw[UPPER].sum(), chars), share(raw[DIGIT].sum(), chars),
        share(raw[MARK].sum(), chars), share(raw[STOP].sum(), chars),
        share(raw[33:127].sum() - raw[UPPER].sum() - raw[97:123].sum() - raw[DIGIT].sum() - raw[MARK].sum() - raw[STOP].sum(), chars),
        share(raw[192:].sum(), chars), np.log1p(len(counts)) / np.log1p(m) if m else 1.0,
        share(max(counts.values(), default=0), m), share(same_next, m), share(len(lines) - len(set(lines)), len(lines)),
        np.log1p(m / len(lines)) if lines else 0.0, share(sum(c for w, c in counts.items() if SIGNED.search(w)), m),
        share(sum(c for w, c in counts.items() if w.isupper() and len(w) > 1), m)])


@F.pandas_udf(ArrayType(DoubleType()))
def text_statistics(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([statistics(t) for t in batch], dtype=object)


def matrix(s: pd.Series) -> np.ndarray:
    return np.stack(s.to_numpy()) if len(s) else np.zeros((0, D))


def majority(labels: DataFrame) -> DataFrame:
    """doc_id, label: one row per labelled document; ties and nulls have no label."""
    one = (labels.select("doc_id", F.col("quality").cast("double").alias("q")).dropna()
           .groupBy("doc_id").agg(F.avg("q").alias("q")).filter("q <> 0.5"))
    return one.select("doc_id", (F.col("q") > 0.5).cast("int").alias("label"))


def moments(vectors: DataFrame, mean: np.ndarray, dev: np.ndarray) -> dict[int, np.ndarray]:
    """Per class the vector (count, sums, outer products) over ``vectors`` (label, x)."""
    width = 1 + D + D * D

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {0: np.zeros(width), 1: np.zeros(width)}
        for b in batches:
            z = standard(matrix(b["x"]), mean, dev)
            for k in (0, 1):
                zk = z[(b["label"] == k).to_numpy()]
                total[k] += np.concatenate([[len(zk)], zk.sum(0), (zk.T @ zk).ravel()])
        yield pd.DataFrame({"label": [0, 1], "s": [total[0], total[1]]})

    parts = vectors.select("label", "x").mapInPandas(add_up, "label int, s array<double>")
    sums = parts.select("label", F.posexplode("s")).groupBy("label", "pos").agg(F.sum("col").alias("v")).collect()
    out = {0: np.zeros(width), 1: np.zeros(width)}
    for r in sums:
        out[r["label"]][r["pos"]] = r["v"]
    return out


def standard(x: np.ndarray, mean: np.ndarray, dev: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / dev, -CLIP, CLIP)


class Discriminant:
    """Two Gaussians with shrunken covariances; inverse Cholesky factors are cached."""

    def __init__(self, sums: dict[int, np.ndarray], mean: np.ndarray, dev: np.ndarray,
                 shrink: float, ridge: float, temper: float):
        self.mean, self.dev, self.temper = mean, dev, temper
        n = {k: sums[k][0] for k in (0, 1)}
        self.constant = (n[1] + 1) / (n[0] + n[1] + 2) if min(n.values()) < 2 else None
        if self.constant is not None:
            return
        mu = {k: sums[k][1:1 + D] / n[k] for k in (0, 1)}
        cov = {k: sums[k][1 + D:].reshape(D, D) / n[k] - np.outer(mu[k], mu[k]) for k in (0, 1)}
        pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
        round_ = np.eye(D) * max(np.trace(pooled) / D, 1e-6)
        self.mu, self.inverse, self.bias = mu, {}, {}
        for k in (0, 1):
            c = (1 - ridge) * ((1 - shrink) * cov[k] + shrink * pooled) + ridge * round_
            low = np.linalg.cholesky(c)
            self.inverse[k] = np.linalg.inv(low)
            self.bias[k] = np.log(n[k] / (n[0] + n[1])) - np.log(np.diag(low)).sum()

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-density difference, label 1 against label 0, less for a text of few words."""
        z = standard(x, self.mean, self.dev)
        evidence = np.expm1(x[:, 0]) / (np.expm1(x[:, 0]) + FEW_WORDS)
        side = {k: self.bias[k] - 0.5 * (((z - self.mu[k]) @ self.inverse[k].T) ** 2).sum(1) for k in (0, 1)}
        return evidence * (side[1] - side[0])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.odds(x) / self.temper, -500, 500)))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit(vectors: DataFrame, labels: DataFrame, shrink: float = 0.3, ridge: float = 0.05, temper: float = 6.0) -> Discriminant:
    """Learn from the labelled rows of ``vectors`` (doc_id, x) that aren't held out."""
    stats = vectors.select(*[f(F.col("x")[i]).alias(f"{f.__name__}{i}") for i in range(D) for f in (F.avg, F.stddev_pop)]).first()
    mean = np.array([stats[f"avg{i}"] or 0.0 for i in range(D)])
    dev = np.array([max(stats[f"stddev_pop{i}"] or 0.0, 1e-6) for i in range(D)])
    known = vectors.join(majority(labels), "doc_id").filter(~held_out(F.col("doc_id")))
    return Discriminant(moments(known, mean, dev), mean, dev, shrink, ridge, temper)


def scored(vectors: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for ``vectors`` (doc_id, x)."""
    @F.pandas_udf("double")
    def score(xs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in xs:
            yield pd.Series(model.score(matrix(x)))

    s = vectors.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("x").alias("score"))
    return s.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def vectors_of(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select("doc_id", text_statistics("text").alias("x"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    x = stored(vectors_of(docs), "statistics")
    return scored(x, fit(x, labels), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts; columns unchanged.

    The texts are read again and scored in place, so they never shuffle.
    """
    model = fit(stored(vectors_of(docs), "statistics"), labels)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(model.score(np.array([statistics(t) for t in batch]).reshape(-1, D)))

    return docs.filter(score("text") >= threshold)
