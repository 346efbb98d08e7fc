import zlib

import numpy as np
import pytest

from textvault.llm import quality_model as Q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    import __spark_entry__ as E
    rows = E.queries()["op6_quality_discriminant"](spark, SF).collect()
    docs = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(label[r["doc_id"]], r["score"], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in label]
    assert np.mean([y == p for y, _, p in judged]) >= 0.95
    good, bad = [s for y, s, _ in judged if y], [s for y, s, _ in judged if not y]
    assert np.mean([[g > b for b in bad] for g in good]) >= 0.98
    assert np.mean([s >= 0.3 for s in good]) >= 0.97


def test_moments_against_numpy(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(50, Q.D)), rng.integers(0, 2, 50)
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(y, x, strict=True)], "label int, x array<double>").repartition(7)
    got = Q.moments(df, np.zeros(Q.D), np.ones(Q.D))
    for k in (0, 1):
        z = x[y == k]
        assert np.allclose(got[k], np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()]))


def test_score_is_the_density_difference():
    rng = np.random.default_rng(1)
    x = {0: rng.normal(1, 2, (300, Q.D)), 1: rng.normal(0, 1, (300, Q.D))}
    sums = {k: np.concatenate([[300], v.sum(0), (v.T @ v).ravel()]) for k, v in x.items()}
    model = Q.Discriminant(sums, np.zeros(Q.D), np.ones(Q.D), 0.0, 0.0, 1.0)
    z = np.clip(rng.normal(size=(5, Q.D)), -4, 4)

    def density(k):
        c, m = np.cov(x[k].T, bias=True), x[k].mean(0)
        return -0.5 * np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(c), z - m) - 0.5 * np.linalg.slogdet(c)[1]

    few = np.expm1(z[:, 0]) / (np.expm1(z[:, 0]) + Q.FEW_WORDS)
    assert np.allclose(model.odds(z), few * (density(1) - density(0)))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", None), (2, "", 1.0), (None, "a b c", 2.0), (5, "x " * 50000, 0.0)],
                                 "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 1, 0), (2, 0, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        rows = Q.classify(docs, labels).collect()
        assert len(rows) == 5 and len({r["score"] for r in rows}) == 1
        assert Q.classify(docs.limit(0), labels).count() == 0
    assert Q.keep_good(docs, none).columns == docs.columns
    assert Q.keep_good(docs, none).count() == 5
    assert Q.statistics(None).tolist() == Q.statistics("").tolist()


@pytest.mark.parametrize("text", ["\ud800 x", "\n\n", "###", "é" * 1000, "A" * 10])
def test_statistics_are_finite(text):
    assert np.isfinite(Q.statistics(text)).all()


def test_whole_table_scores_equal_a_direct_computation(spark):
    """Means, deviations, class covariances and densities over the whole table, by numpy and without Cholesky factors."""
    import __spark_entry__ as E
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    x = np.array([Q.statistics(r["text"]) for r in docs])
    z = np.clip((x - x.mean(0)) / np.maximum(x.std(0), 1e-6), -Q.CLIP, Q.CLIP)
    known = [i for i, r in enumerate(docs) if r["doc_id"] in label and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    rows = {k: z[[i for i in known if label[docs[i]["doc_id"]] == k]] for k in (0, 1)}
    cov = {k: np.cov(v.T, bias=True) for k, v in rows.items()}
    n = {k: len(v) for k, v in rows.items()}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    side = {}
    for k, v in rows.items():
        c = 0.95 * (0.7 * cov[k] + 0.3 * pooled) + 0.05 * np.eye(Q.D) * np.trace(pooled) / Q.D
        d = z - v.mean(0)
        side[k] = np.log(n[k] / len(known)) - 0.5 * np.einsum("ij,ij->i", d @ np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1]
    words = np.array([len([w for w in (r["text"] or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w])
                      for r in docs])
    want = 1 / (1 + np.exp(-(words / (words + 20)) * (side[1] - side[0]) / 6))
    got = {r["doc_id"]: r["score"] for r in E.queries()["op6_quality_discriminant"](spark, SF).collect()}
    assert np.allclose([got[r["doc_id"]] for r in docs], want, atol=1e-9)
