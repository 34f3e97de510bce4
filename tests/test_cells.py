"""Exact search over one whole table by angle bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.operators import cells as C
from engram.operators import search as S

M = "memory_id string, embedding array<float>, importance double, deleted_at timestamp_ntz"
Q = "request_id string, embedding array<float>"


def _rows(df):
    return sorted((r["request_id"], r["memory_id"], r["rank"], r["score"] if r["score"] is None
                   else round(r["score"], 9)) for r in df.collect())


def _exact(q, m, k):
    q, m = q.withColumn("_all", F.lit(0)), m.withColumn("_all", F.lit(0))
    return _rows(S.knn_exact(q, m, k, keys=["_all"]))


def _clustered(spark, n=2000, groups=40, asked=50):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(groups, 32))
    centres /= np.linalg.norm(centres, axis=1)[:, None]

    def near(i):
        return (centres[i % groups] * rng.uniform(0.5, 4) + rng.normal(size=32) * 0.05).tolist()

    m = spark.createDataFrame([(f"m{i:04d}", near(i), float(i % 5), None) for i in range(n)], M)
    return spark.createDataFrame([(f"q{i}", near(i * 7)) for i in range(asked)], Q), m


@pytest.fixture
def pairs(monkeypatch):
    """Pairs of a query and a row that the search scores."""
    met = []
    real = C._block_scores

    def counted(q, m, *args):
        n = m.groupBy(C.DIM, C.PACK).count()
        met.append(q.join(n, [C.DIM, C.PACK]).agg(F.sum("count")).first()[0] or 0)
        return real(q, m, *args)

    monkeypatch.setattr(C, "_block_scores", counted)
    return met


def test_clustered_vectors_meet_few_rows(spark, pairs):
    q, m = _clustered(spark)
    assert _rows(C.knn_cells(q, m, 10, block_rows=100)) == _exact(q, m, 10)
    assert sum(pairs) < 0.2 * 50 * 2000


def test_unstructured_vectors_are_exact(spark):
    rng = np.random.default_rng(5)
    m = spark.createDataFrame([(f"m{i:04d}", rng.normal(size=16).tolist(), 0.5, None) for i in range(700)], M)
    q = spark.createDataFrame([(f"q{i}", rng.normal(size=16).tolist()) for i in range(30)], Q)
    assert _rows(C.knn_cells(q, m, 7, block_rows=50)) == _exact(q, m, 7)


def test_one_large_group_of_near_copies(spark):
    rng = np.random.default_rng(6)
    one = rng.normal(size=24)
    rows = [(f"c{i:04d}", (one + rng.normal(size=24) * 1e-3).tolist(), 0.1, None) for i in range(1500)]
    rows += [(f"r{i:03d}", rng.normal(size=24).tolist(), 0.1, None) for i in range(300)]
    q = spark.createDataFrame([("near", one.tolist()), ("far", rng.normal(size=24).tolist())], Q)
    m = spark.createDataFrame(rows, M)
    assert _rows(C.knn_cells(q, m, 10, block_rows=100)) == _exact(q, m, 10)


def test_odd_vectors(spark):
    """Ties, equal rows, several lengths, zero vectors, nulls, opposite vectors."""
    rows = [("a", [1.0, 0.0], 0.5, None), ("b", [2.0, 0.0], 0.9, None), ("c", [-1.0, 0.0], 0.5, None),
            ("d", [0.0, 0.0], 0.5, None), ("e", None, 0.5, None), ("f", [1.0, None], 0.5, None), ("g", [], 0.5, None),
            ("h", [1.0, 2.0, 3.0], None, None), ("i", [3.0, 2.0, 1.0], 0.5, None), ("j", [0.0, 0.0], None, None)]
    m = spark.createDataFrame(rows, M)
    q = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0]), ("zero", [0.0, 0.0]), ("none", None),
                               ("wide", [1.0, 1.0, 1.0]), ("lone", [1.0] * 5)], Q)
    for k in (1, 2, 3, 4, 10):
        assert _rows(C.knn_cells(q, m, k, block_rows=2)) == _exact(q, m, k)


def test_empty_tables(spark):
    q, m = _clustered(spark, 20, 2, 3)
    assert C.knn_cells(q.limit(0), m, 3).count() == 0
    assert C.knn_cells(q, m.limit(0), 3).count() == 0


def test_the_sample_does_not_change_the_answer(spark):
    q, m = _clustered(spark, 400, 8, 20)
    want = _exact(q, m, 5)
    assert all(_rows(C.knn_cells(q, m, 5, cells=n, seed=s, block_rows=30)) == want for n, s in ((1, 1), (3, 2), (300, 3)))
