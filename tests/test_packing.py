"""Packing under a budget, held to a plain loop over every row."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from engram.operators import context as cx
from engram.operators import working as wk
from engram.plans.packing import first_by_cost, greedy_pack

ROWS = "k string, item_id string, score double, tok int, extra map<string,int>, _key string, _c int, position string"


def loop(rows, budgets):
    """rows: (key, order tuple, id, tokens); budgets: (key, budget)."""
    by = defaultdict(list)
    for k, o, i, t in rows:
        by[k].append((tuple((x is not None, x) for x in o), i, max(t or 0, 0)))
    out = Counter()
    for k, b in {(k, b or 0) for k, b in budgets if k is not None}:
        used, picked = 0, []
        for _, i, t in sorted(by[k], key=lambda r: (r[0], r[2])):
            if used + t <= b:
                used += t
                picked.append(i)
        out.update((k, b, i, n, used) for n, i in enumerate(picked))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_equal_to_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        k = rng.choice(["hot", "hot", "a", "b", None])
        rows.append((k, f"i{i // 2 if seed == 1 else i}", rng.choice([None, 0.25, 0.5, 0.75]),
                     rng.choice([None, 0, -3, 1, 2, 3, 7, 20, 90, 400]), {"x": 1}, "mine", i, "p"))
    if seed == 1:                                        # repeated rows, in one group over the budget
        rows += [("hot", "rep", 0.9, 30, None, None, None, None)] * 40
    budgets = [("hot", 500), ("hot", 37), ("hot", 500), ("a", 0), ("b", None), ("b", -1), (None, 9), ("nobody", 10)]
    df = spark.createDataFrame(rows, ROWS)
    b = spark.createDataFrame(budgets, "k string, b int")
    got = greedy_pack(df, b, "k", [-F.col("score"), F.col("item_id")], "tok", "b",
                      keep=["item_id", "extra", "_key", "_c"])
    assert got.columns == ["k", "b", "item_id", "extra", "_key", "_c", "position", "used"]
    want = loop([(r[0], (None if r[2] is None else -r[2], r[1]), r[1], r[3]) for r in rows], budgets)
    assert Counter((r["k"], r["b"], r["item_id"], r["position"], r["used"]) for r in got.collect()) == want
    assert greedy_pack(df.limit(0), b, "k", [F.col("item_id")], "tok", "b", keep=["item_id"]).count() == 0
    assert greedy_pack(df, b.limit(0), "k", [F.col("item_id")], "tok", "b", keep=["item_id"]).count() == 0


def test_one_session_of_a_million_items(spark):
    n, budget = 10 ** 6, 4000
    items = spark.range(n).select(
        F.lit("s").alias("session_id"), F.concat(F.lit("i"), F.col("id").cast("string")).alias("item_id"),
        (F.col("id") % 997 == 0).alias("pinned"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("relevance_score"),
        F.col("id").cast("int").alias("sequence_num"), F.lit("message").alias("content_type"),
        (F.lit(5) + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(60))).cast("int").alias("token_count"))
    sessions = spark.createDataFrame([("s", 10 ** 7, budget)], "session_id string, total_tokens long, max_tokens int")
    got = {r["item_id"]: r["position"] for r in wk.read_working_memory(items, sessions).collect()}
    left = first_by_cost(items, ["session_id"], F.struct(~F.col("pinned"), -F.col("relevance_score"), -F.col("sequence_num")),
                         F.col("token_count").cast("long"), F.lit(budget))
    assert left.count() <= sum(budget // c for c in range(5, 65))
    p = items.select("item_id", "pinned", "relevance_score", "sequence_num", "token_count").toPandas()
    p = p.sort_values(["pinned", "relevance_score", "sequence_num"], ascending=False)
    used, want = 0, {}
    for i, t in zip(p["item_id"], p["token_count"]):
        if used + t <= budget:
            used += t
            want[i] = len(want)
    assert got == want


def test_working_context_shares_packings(spark):
    items = spark.createDataFrame(
        [("s", f"i{i}", i % 5 == 0, i, 10 + i % 3, "message", 0.5) for i in range(50)],
        "session_id string, item_id string, pinned boolean, sequence_num int, token_count int, content_type string, "
        "relevance_score double")
    req = spark.createDataFrame([("r1", "s", 100), ("r2", "s", 100), ("r3", "s", 35), ("r4", "none", 10), ("r5", None, 10)],
                                "request_id string, session_id string, working_budget int")
    got = Counter((r["request_id"], r["item_id"], r["position"], r["working_used"])
                  for r in cx.working_context(items, req).collect())
    rows = [("s", (i % 5 != 0, -i, f"i{i}"), f"i{i}", 10 + i % 3) for i in range(50)]
    want = Counter()
    for name, b in (("r1", 100), ("r2", 100), ("r3", 35)):
        want.update((name, i, n, used) for _, _, i, n, used in loop(rows, [("s", b)]))
    assert got == want
