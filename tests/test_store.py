"""Storing a batch of texts in one step, and recall under filters."""

import pandas as pd
from pyspark.sql import functions as F

from engram.operators import lifecycle as lc
from engram.operators import recall as rc
from engram.sources import testdata as td
from engram.sources.testdata import ts

SF = "/root/testdata/sf0.001"
NOW = "2024-02-01 00:00:00"
REQ = "request_id string, user_id string, content string, memory_category string, memory_subtype string, " \
      "importance double, summary string, questions array<string>, extra string"


def _store(spark, rows, **kw):
    after, rep = lc.store_memories(td.memories(spark, SF), spark.createDataFrame(rows, REQ), ts(NOW), 64, **kw)
    return after, {r["request_id"]: r for r in rep.collect()}


def test_each_request_has_one_fate(spark):
    long = "We decided on the column store because scans are wide. " * 12
    key = "the key is AKIA" + "ABCDEFGHIJKLMNOP"
    rows = [("a", "u1", long, "semantic", "domain", 0.7, "A summary of it all.", ["What store was chosen?"], "x"),
            ("b", "u1", key, "semantic", "domain", 0.7, None, None, "x"),
            ("c", "u1", None, "semantic", "domain", 0.7, None, None, "x"),
            ("d", "u1", "", None, None, None, None, None, None),
            ("e", "u1", "some text of no kind", "semantic", "no such", 0.7, None, None, "x"),
            ("f", "u1", long, "semantic", "domain", 0.9, "short", ["What store was chosen?"], "x"),
            ("g", "u2", "database:atlas moves to the new cluster", None, "", 0.5, None, None, "x"),
            ("h", None, "text of nobody", "semantic", "domain", None, None, None, "x")]
    after, rep = _store(spark, rows)
    assert {k: r["action"] for k, r in rep.items()} == {
        "a": "inserted", "b": "refused", "c": "invalid", "d": "invalid", "e": "invalid", "f": "merged",
        "g": "inserted", "h": "inserted"}
    assert rep["f"]["memory_id"] == rep["a"]["memory_id"] == "n-a" and rep["a"]["summary"] == "A summary of it all."
    assert rep["f"]["summary"] == long[:200].strip() + "..." and rep["g"]["summary"] is None
    assert rep["g"]["entities"] == ["database:atlas"] and rep["g"]["memory_subtype"]
    assert rep["h"]["importance"] == 0.5 and rep["b"]["message"] and "no such" in rep["e"]["message"]
    new = {r["memory_id"]: r for r in after.where(F.col("memory_id").startswith("n-")).collect()}
    assert set(new) == {"n-a", "n-g", "n-h"} and new["n-a"]["importance"] == 0.9 and len(new["n-g"]["embedding"]) == 64
    assert after.columns == td.memories(spark, SF).columns
    assert after.where(F.col("content").contains("AKIA")).count() == 0


def test_a_model_classifies_and_embeds(spark):
    def model(b: pd.DataFrame) -> pd.DataFrame:
        return b.assign(memory_category="procedural", memory_subtype="workflow", importance=0.8,
                        entities=[["database:x"]] * len(b), is_temporal=False)

    rows = [("a", "u1", "one", None, None, 0.5, None, None, None), ("b", "u1", "two", "semantic", "domain", 0.5, None, None, None)]
    _, rep = _store(spark, rows, classifier=model, embedder=lambda t: [[float(len(x)), 1.0] + [0.0] * 62 for x in t], t=1.1)
    assert (rep["a"]["memory_category"], rep["a"]["importance"], rep["a"]["entities"]) == ("procedural", 0.8, ["database:x"])
    assert (rep["b"]["memory_category"], rep["b"]["importance"], rep["b"]["entities"]) == ("semantic", 0.5, [])


def test_nothing_to_store(spark):
    after, rep = _store(spark, [])
    assert rep == {} and after.count() == td.memories(spark, SF).count()


def test_filters_of_recall_come_before_the_search(spark):
    req, mem = td.requests(spark, SF), td.memories(spark, SF)
    kw = {"after": "2024-04-10 00:00:00", "before": "2024-05-20 00:00:00", "tags": ["en"], "min_confidence": 0.8}
    got = rc.recall(req, mem, limit=3, min_similarity=-1.0, **kw)
    fit = mem.where((F.col("created_at") >= F.lit(kw["after"]).cast("timestamp_ntz"))
                    & (F.col("created_at") < F.lit(kw["before"]).cast("timestamp_ntz"))
                    & F.col("metadata").contains('"en"') & (F.col("confidence") >= 0.8))
    want = rc.recall(req, fit, limit=3, min_similarity=-1.0)
    key = lambda d: sorted((r["request_id"], r["rank"], r["memory_id"]) for r in d.collect())
    assert key(got) == key(want) and got.count() > 0
    assert rc.recall(req, mem, after="2999-01-01 00:00:00").count() == 0
