"""Toxic passages: segments by brute force, weights by hand, held-out accuracy, odd rows."""

import math
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engram.llm import toxicity

SF = "/root/testdata/sf0.01"


def brute_segments(x):
    """The best segment (shortest, then leftmost), then the same to its left and right."""
    def inside(lo, hi):
        best = None
        for i in range(lo, hi):
            for j in range(i + 1, hi + 1):
                s = sum(x[i:j])
                if s > 0 and (best is None or s > best[2] or (s == best[2] and j - i < best[1] - best[0])):
                    best = (i, j, s)
        return [] if best is None else inside(lo, best[0]) + [best] + inside(best[1], hi)
    return inside(0, len(x))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-4, 5), max_size=14))
def test_all_maximal_segments(scores):
    found = toxicity.maximal_segments(np.array(scores, dtype=float))
    assert [round(s, 6) for *_, s in found] == [s for *_, s in brute_segments(scores)]
    assert all(sum(scores[a:b]) == round(s, 6) for a, b, s in found)
    assert all(b <= c for (_, b, _), (c, _, _) in zip(found, found[1:]))


def test_lambda_and_chance():
    lam = toxicity.karlin_lambda(np.array([-1.0, 1.0]), np.array([0.75, 0.25]))
    assert abs(lam - math.log(3)) < 1e-9                     # (1 - p) / p for steps of one
    assert toxicity.karlin_lambda(np.array([-1.0]), np.array([1.0])) == 1.0
    c = toxicity.Calibration(1.0, 1.0, 1.0, 0.0)
    assert c.chance(100, 10) < 1e-30 and 0.6 < c.chance(0, 1) <= 1
    assert c.chance(9, 10) < c.chance(9, 1000)


def test_weights_by_hand(spark):
    df = spark.createDataFrame([(30.0, 10.0), (5.0, 5.0), (0.0, 0.0)], "t double, o double")
    w, z = toxicity.log_odds(F.col("t"), F.col("o"), 100, 100)
    got = df.select(w.alias("w"), z.alias("z")).collect()
    a, b, c, d = 30 + 4, 70 + 16, 10 + 4, 90 + 16                 # 20 more documents, a fifth of which have it
    assert abs(got[0]["w"] - math.log(a * d / (b * c))) < 1e-9
    assert abs(got[0]["z"] - got[0]["w"] / math.sqrt(1 / a + 1 / b + 1 / c + 1 / d)) < 1e-9
    assert abs(got[1]["w"]) < 1e-9 and abs(got[2]["w"]) < 1e-9


def test_words_are_never_cut():
    text = "Ein Wort,zwei  drei-vier5fünf\n" * 20
    whole = [w for some in toxicity.words(text) for w in some]
    assert whole == [w for some in toxicity.words(text, 7) for w in some]
    assert whole[:5] == ["ein", "wort", "zwei", "drei", "vier"]


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model, spans=True).toPandas()
    assert len(out) == docs.count() and out["score"].between(0, 1).all()
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out["doc_id"]]).all()
    assert (out["predicted"] == (out["score"] >= 0.5)).all()
    both = out.merge(labels.toPandas(), on="doc_id")
    own = both[both["held_out"]]
    assert (own["toxic"] == own["predicted"]).mean() > 0.9
    assert own[own["toxic"] == 0]["predicted"].mean() < 0.06
    texts = docs.toPandas().set_index("doc_id")["text"]
    hit = out[out["n_passages"] > 0]
    assert len(hit) and all(texts[r.doc_id][p["start"]:p["end"]].strip() for r in hit.itertuples() for p in r.passages)


def test_odd_rows(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    held = next(i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0)
    pad = lambda i: " ".join("".join(random.Random(100 * i + k).choices("bdfgk", k=3)) for k in range(20))
    rows = [(i, pad(i) + (" vile scum " if i % 3 == 0 else " fine ") + pad(i + 1)) for i in ids]
    odd = [(held, pad(2) + " vile scum"), (1001, None), (1002, ""), (1003, "12 !\n"), (None, "vile scum"),
           (1004, (pad(5) + "\n") * 20000 + "vile scum, vile " * 9), (1005, "vile scum"), (1005, "vile scum")]
    labels = [(i, int(i % 3 == 0)) for i in ids] + [(held, 0), (None, 1), (ids[0], None), (ids[1], 7)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumns(
        {c: F.lit(3) for c in ("toxic", "score", "id", "key", "held_out")})
    out = toxicity.detect(docs, spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("z"))).collect()
    assert len(out) == len(rows) + len(odd)
    by = {r["doc_id"]: r for r in out}
    assert by[held]["predicted"] == 1 and by[held]["held_out"]            # its label says 0, and is not looked at
    assert by[None]["predicted"] == 1 and by[None]["held_out"] and by[1005]["predicted"] == 1
    assert by[1004]["n_passages"] == 1 and by[1004]["predicted"] == 1
    assert all(by[i]["predicted"] == 0 and by[i]["n_passages"] == 0 for i in (1001, 1002, 1003))
    assert np.mean([by[i]["predicted"] == int(i % 3 == 0) for i in ids]) > 0.98


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in toxicity.detect(docs, none).collect()] == [0, 0]
    assert toxicity.detect(docs.limit(0), none).collect() == []
