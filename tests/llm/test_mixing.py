"""Source mixing against brute force, and odd rows."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from engram.llm import mixing


def frame(spark, rows, schema="doc_id long, source string, text string"):
    return spark.createDataFrame(rows, schema)


def documents(seed=3, n=400):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["a", "a", "a", "b", "c", "D", None]), " ".join(["w"] * rnd.choice([0, 3, 40, 500])))
            for i in range(n)]
    return rows + [(n, "b", None), (None, "c", "x y z"), (7, rows[7][1], rows[7][2])]


def filled(sizes):
    """Targets by sharing out again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    rest, full = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in full]
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if weight[s] * level > 2 * sizes[s]]
        if not over:
            return {s: full.get(s, weight[s] * level) for s in order}
        for s in over:
            full[s] = 2.0 * sizes[s]
            rest -= full[s]


def test_targets_and_taken(spark):
    rows = documents()
    out = mixing.mix(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = filled(sizes), dict.fromkeys(sizes, 0)
    for r in out:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 3 * mixing.BLOCK_WORDS, s
    again = mixing.mix(frame(spark, rows).repartition(7)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["taken"])
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str), key


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_highest_quotients(spark, seed):
    rnd = random.Random(seed)
    rows = [(g, p, float(rnd.choice([0, 1, 5, rnd.randint(1, 10 ** 6)]))) for g in range(4) for p in range(rnd.randint(1, 30))]
    seats = {g: rnd.choice([0, 1, 7, 500]) for g in range(4)}
    df = spark.createDataFrame([(*r, seats[r[0]]) for r in rows], "g long, p long, w double, s long")
    got = {(r["g"], r["p"]): r["quota"] for r in mixing.sainte_lague(df, ["g"], ["p"], "w", "s").collect()}
    for g in range(4):
        own = {p: w for gg, p, w in rows if gg == g}
        won = dict.fromkeys(own, 0)
        heap = [(-w, p, 1) for p, w in own.items() if w > 0]
        heapq.heapify(heap)
        for _ in range(seats[g] if heap else 0):
            _, p, k = heapq.heappop(heap)
            won[p] += 1
            heapq.heappush(heap, (-own[p] / (2 * k + 1), p, k + 1))
        assert {p: got[g, p] for p in own} == won


def test_small_shards_and_columns_of_the_same_name(spark):
    rows = documents(5, 300)
    df = frame(spark, rows).withColumn("size", F.lit("x")).withColumn("block", F.lit(1)).withColumn("shard", F.lit(2))
    out = mixing.mix(df, shard_words=1000).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        t = by.setdefault(r["source"], [0, r["target"]])
        t[0] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    for taken, target in by.values():
        assert abs(taken - target) < 0.1 * target + 200


def test_empty_and_without_words(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
    out = mixing.mix(frame(spark, [(1, "a", None), (2, None, "")])).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in out] == [(0, 0, 0.0)] * 2


def test_mixed_documents_are_the_taken_words(spark):
    rows = [(i, "abc"[i % 3], " ".join(f"w{i}_{j}" for j in range(i * 7 % 300))) for i in range(60)]
    df = frame(spark, rows).withColumn("pass", F.lit("mine"))
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    got = {}
    for r in mixed.collect():
        words = r["text"].split()
        assert set(words) <= set(rows[r["doc_id"]][2].split())
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(words)
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(df).collect() if r["taken"]}
    assert got == want
