"""Inverted-file index: equal to the exact search, appended to, no blow-up."""

import numpy as np
import pytest

from engram.operators import ivf as I
from engram.operators import search as S

M = "memory_id string, user_id string, embedding array<float>, importance double, deleted_at timestamp_ntz"
Q = "request_id string, user_id string, embedding array<float>"


def _rows(df):
    return sorted((r["request_id"], r["memory_id"], r["rank"], round(r["score"], 9)) for r in df.collect())


def _tables(spark, clustered, n=1200, dim=32):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(30, dim)) / dim ** 0.5

    def vec(i):
        return (centres[i % 30] + rng.normal(size=dim) * 0.05 if clustered else rng.normal(size=dim)).tolist()

    def user(i):
        return "hot" if i % 3 else f"u{i % 5}"

    m = [(f"m{i:04d}", user(i), vec(i), None if i % 17 == 0 else float(i % 4), None) for i in range(n)]
    return spark.createDataFrame([(f"q{i}", user(i), vec(i)) for i in range(40)], Q), spark.createDataFrame(m, M)


@pytest.mark.parametrize("clustered", [True, False])
def test_index_equals_exact_search(spark, tmp_path, clustered):
    q, m = _tables(spark, clustered)
    I.build_index(m, str(tmp_path / "i"))
    want = _rows(S.knn_exact(q, m, 5))
    assert _rows(I.search_index(q, str(tmp_path / "i"), 5, block_rows=100)) == want
    assert _rows(I.search_index(q, str(tmp_path / "i"), 5, margin=None)) == want


def test_appended_rows_are_found(spark, tmp_path):
    q, m = _tables(spark, True, 600)
    old, new = m.where("memory_id < 'm0300'"), m.where("memory_id >= 'm0300'")
    wide = spark.createDataFrame([(f"w{i}", "hot", [1.0 + i, 2.0, 3.0], 0.5, None) for i in range(9)], M)
    path = str(tmp_path / "i")
    I.build_index(old, path)
    I.append_index(new.unionByName(wide), path)
    q = q.unionByName(spark.createDataFrame([("wide", "hot", [1.0, 2.0, 3.0])], Q))
    assert _rows(I.search_index(q, path, 4)) == _rows(S.knn_exact(q, m.unionByName(wide), 4))


def test_one_large_group_of_near_copies(spark, tmp_path):
    rng = np.random.default_rng(4)
    one = rng.normal(size=24)
    m = spark.createDataFrame([(f"c{i:04d}", "u", (one + rng.normal(size=24) * 1e-3).tolist(), 0.5, None)
                               for i in range(1500)], M)
    q = spark.createDataFrame([(f"q{i}", "u", (one + rng.normal(size=24) * 1e-3).tolist()) for i in range(30)], Q)
    I.build_index(m, str(tmp_path / "i"))
    assert _rows(I.search_index(q, str(tmp_path / "i"), 10, block_rows=400)) == _rows(S.knn_exact(q, m, 10))


def test_odd_rows(spark, tmp_path):
    rows = [("a", "u", [1.0, 0.0], 0.5, None), ("b", "u", [2.0, 0.0], 0.9, None), ("c", "u", [-1.0, 0.0], None, None),
            ("d", "u", None, 0.5, None), ("e", "u", [1.0, None], 0.5, None), ("f", "u", [], 0.5, None),
            ("g", None, [1.0, 0.0], 0.5, None), ("h", "v", [1.0, 1.0, 1.0], 0.5, None)]
    m = spark.createDataFrame(rows, M)
    zero = spark.createDataFrame([("z", "u", [0.0, 0.0], 0.5, None)], M)
    q = spark.createDataFrame([("x", "u", [1.0, 0.0]), ("none", "u", None), ("nobody", "w", [1.0, 0.0]),
                               ("other", "v", [1.0, 0.0]), ("long", "v", [1.0, 2.0, 3.0])], Q)
    path = str(tmp_path / "i")
    I.build_index(m.unionByName(zero), path)
    asked = q.unionByName(spark.createDataFrame([("nowhere", "u", [0.0, 0.0])], Q))
    for k in (1, 2, 9):
        assert _rows(I.search_index(asked, path, k)) == _rows(S.knn_exact(q, m, k))


def test_empty_index(spark, tmp_path):
    q, m = _tables(spark, True, 10)
    path = str(tmp_path / "i")
    I.build_index(m.limit(0), path)
    assert I.search_index(q, path, 3).count() == 0
    I.append_index(m, path)
    assert _rows(I.search_index(q, path, 3)) == _rows(S.knn_exact(q, m, 3))
    assert I.search_index(q.limit(0), path, 3).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_recall_on_the_registered_table(spark, sf):
    from engram.plans import q_search
    path = f"/root/testdata/{sf}"
    exact = {(r["request_id"], r["memory_id"]) for r in q_search.q_knn_exact(spark, path).collect()}
    got = {(r["request_id"], r["memory_id"]) for r in q_search.q_ann_index(spark, path).collect()}
    assert len(exact & got) >= 0.999 * len(exact)
