"""Nearest neighbours by Hilbert curves."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.llm import hilbert

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=5, every=50):
    seen = {(i, tuple(v)) for i, v in rows if i is not None and v and None not in v
            and all(np.isfinite(v)) and any(v)}
    out = {}
    for i, v in sorted(seen):
        if i % every:
            continue
        near = []
        for j, u in seen:
            if j != i and len(u) == len(v):
                a, b = np.array(v, dtype=np.float32).astype(float), np.array(u, dtype=np.float32).astype(float)
                near.append((-a @ b / np.sqrt(a @ a) / np.sqrt(b @ b), j))
        out[i] = sorted(near)[:k]
    return out


@pytest.mark.parametrize("bits,dims", [(1, 1), (3, 2), (2, 3), (2, 4)])
def test_curve_visits_every_cell_in_single_steps(bits, dims):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    key = hilbert.hilbert_index(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_recall_on_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {}
    for r in hilbert.nearest(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = df.toPandas()
    v = np.stack(x["embedding"]).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = x["vec_id"].to_numpy()
    hits = n = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = v @ v[q]
        s[q] = -2
        want = set(ids[np.argsort(-s)[:5]])
        own = sorted(got[ids[q]])
        assert [r[0] for r in own] == [1, 2, 3, 4, 5]
        for _, i, score in own:
            assert score == pytest.approx(s[np.flatnonzero(ids == i)[0]], abs=1e-9)
        hits += len(want & {r[1] for r in own})
        n += 5
    assert hits / n >= 0.9


def test_small_table_is_exact_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 4)).astype(np.float32).tolist()
    rows = [(i, base[i % 3] if i < 40 else base[3 + i % 3]) for i in range(60)]
    rows += [(100, [2 * x for x in base[0]]), (101, None), (102, []), (103, [0.0] * 4), (104, [1.0, None, 0.0, 0.0]),
             (105, [float("nan")] * 4), (106, [float("inf"), 1.0, 1.0, 1.0]), (None, base[1]), (3, base[0]), (3, base[0]),
             (150, [1.0, 2.0]), (151, [2.0, 1.0]), (200, [1e-30] * 4), (250, [3e38, 3e38, 1.0, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("class_id", F.lit("mine")).withColumn("rank", F.lit(0))
    got = {}
    for r in hilbert.nearest(df, window=1.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = {i: w for i, w in brute(rows).items() if w}
    assert set(got) == set(want)
    for i, w in want.items():
        own = sorted(got[i])
        assert [r[2] for r in own] == pytest.approx([-s for s, _ in w], abs=1e-7), i
        if i not in (200, 250):                                   # float sums there tie but for rounding
            assert [r[1] for r in own] == [j for _, j in w], i


@pytest.mark.parametrize("n_vectors", [2, 3, 4, 5, 6, 10, 40])
def test_few_distinct_vectors_are_exact_with_the_default_window(spark, n_vectors):
    rng = np.random.default_rng(n_vectors)
    base = rng.normal(size=(n_vectors, 8)).astype(np.float32).tolist()
    rows = [(50 * i, v) for i, v in enumerate(base)] + [(10001 + 50 * i, base[1]) for i in range(20)]
    rows += [(20000, [1.0, 2.0]), (20001, [2.0, -1.0]), (20002, [-1.0, 0.5])]
    got = {}
    for r in hilbert.nearest(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    want = {i: [j for _, j in w] for i, w in brute(rows).items()}
    assert {i: [j for _, j in sorted(g)] for i, g in got.items()} == want


def test_common_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(400)] + [(1000 + i, [1.0, 2.0, 3.0 + i]) for i in range(1, 30)]
    got = {}
    for r in hilbert.nearest(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert [i for _, i in sorted(got[0])] == [1, 2, 3, 4, 5]
    assert [i for _, i in sorted(got[50])] == [0, 1, 2, 3, 4]
    assert set(got) == set(range(0, 400, 50))


def test_empty(spark):
    assert hilbert.nearest(spark.createDataFrame([], SCHEMA)).collect() == []
    assert hilbert.nearest(spark.createDataFrame([(0, [1.0])], SCHEMA)).collect() == []
