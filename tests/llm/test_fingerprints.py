"""Document fingerprints: edits by brute force, sums and likeness."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from engram.llm import fingerprints as fp

SCHEMA = "doc_id long, text string"


def text(rnd, n):
    return " ".join(f"Word{rnd.randint(0, 10 ** 6)} is here é𝒳." + rnd.choice(["", "\n"]) for _ in range(n))


def edited(rows):
    order = sorted({(i is None, i or 0, hashlib.sha256((t or "").encode()).hexdigest(), t or "") for i, t in rows})
    out = {}
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        t, n = a[3], len(a[3]) // 4
        out[None if a[0] else a[1], t] = t[:len(t) - n] + b[3][:n]
    return out


def test_edits_and_order(spark):
    rnd = random.Random(1)
    rows = [(i * 7 % 101, text(rnd, rnd.randint(1, 40))) for i in range(60)]
    rows += [(500, None), (501, ""), (502, "x"), (None, "no id. " * 5), rows[0], rows[0], (rows[1][0], "another text. " * 9)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("k", F.lit(1)).withColumn("h", F.lit("h"))
    out = fp.edited_fingerprints(df).collect()
    assert len(out) == len(rows)
    want = sorted((str(i), len(t or ""), hashlib.sha256(edited(rows)[i, t or ""].encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in out) == want
    after = edited(rows)
    texts = {(i, len(t or "")): t or "" for i, t in rows}
    for r in out:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if r["n_chars"] > 400:
            t = texts[r["doc_id"], r["n_chars"]]
            x, y = (Counter(re.findall(fp.PARAGRAPH, s)) for s in (t, after[r["doc_id"], t]))
            both = sum(x[p] * y[p] for p in x)
            norm = lambda c: sum(v * v for v in c.values())
            assert r["near_edited"] == pytest.approx(both / (norm(x) + norm(y) - both), abs=0.25)
    other = [r["near_next"] for r in out if r["n_chars"] > 400]
    assert sum(other) / len(other) < 0.1


def test_alone_and_empty(spark):
    assert fp.edited_fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []
    one = fp.edited_fingerprints(spark.createDataFrame([(3, "abcdefgh")], SCHEMA)).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one["near_next"] == 1.0
    none = fp.edited_fingerprints(spark.createDataFrame([(3, None), (4, "")], SCHEMA)).collect()
    assert {r["near_edited"] for r in none} == {1.0} and len({r["fingerprint"] for r in none}) == 1


def test_sum_of_paragraphs(spark):
    a, b = "One line.\nTwo lines.\nThree lines.\n", "Four lines.\nTwo lines.\n"
    rows = spark.createDataFrame([(1, a), (2, b), (3, b + a), (4, "Three lines.\nOne line.\nTwo lines.\n")], SCHEMA)
    v = fp.vectors(rows, ["doc_id"])
    x = {r["doc_id"]: r["vector"] for r in v.collect()}
    assert x[1] == x[4] and x[1] != x[3]
    s = spark.createDataFrame([(x[1], x[2], x[3])], "a array<long>, b array<long>, c array<long>").select(
        fp.insert(F.col("a"), F.col("b")).alias("sum"), fp.delete(F.col("c"), F.col("b")).alias("rest")).first()
    assert s["sum"] == x[3] and s["rest"] == x[1]


def test_likeness_follows_shared_paragraphs(spark):
    p = [f"paragraph number {i}\n" for i in range(300)]
    for share in (0, 30, 100, 180, 199):
        rows = [(1, "".join(p[:200])), (2, "".join(p[200 - share:200] + p[200:]) if share < 100 else "".join(p[:share]))]
        shared = share if share < 100 else share
        size = len(rows[1][1].splitlines())
        x = {r["doc_id"]: r["vector"] for r in fp.vectors(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()}
        got = spark.createDataFrame([(x[1], x[2])], "a array<long>, b array<long>").select(
            fp.likeness(F.col("a"), F.col("b")).alias("s")).first()["s"]
        assert got == pytest.approx(shared / (200 + size - shared), abs=0.17)


def test_likeness_of_texts_with_repeated_lines(spark):
    line = "again and again\n"
    rows = [(1, line * 50 + "one\n"), (2, line * 38 + "two\n"), (3, "other\n" * 40)]
    x = {r["doc_id"]: r["vector"] for r in fp.vectors(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()}
    got = spark.createDataFrame([(x[1], x[2], x[3])], "a array<long>, b array<long>, c array<long>").select(
        fp.likeness(F.col("a"), F.col("b")).alias("near"), fp.likeness(F.col("a"), F.col("c")).alias("far")).first()
    assert got["near"] > 0.85 and got["far"] < 0.25


def test_paragraphs_cover_every_character(spark):
    texts = ["", "...", "\n\n a.b!? c", "x" * 1000, "y" * 130 + ".", "é\n" * 3, " . . "]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], SCHEMA).select(
        "doc_id", F.array_join(fp.paragraphs(F.col("text")), "").alias("t")).collect()
    assert {r["doc_id"]: r["t"] for r in got} == dict(enumerate(texts))
