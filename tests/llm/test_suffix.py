"""Removal of repeated passages against brute force."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.llm import common, suffix
from engram.llm.bpe import SpanHasher

SCHEMA = "doc_id long, text string"


def brute(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (doc_id, _), b in zip(rows, raw, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    new = lambda k: "".join(rnd.choice("abcdefgh é,") for _ in range(k))
    passages = [new(rnd.randint(20, 300)) for _ in range(5)] + ["ab" * 100, "x" * 150]
    rows = []
    for i in range(40):
        text = ""
        for _ in range(rnd.randint(0, 5)):
            if rnd.random() < 0.5:
                p = rnd.choice(passages)
                k = rnd.randrange(len(p))
                text += p if rnd.random() < 0.6 else p[:k] + "#" + p[k + 1:]
            else:
                text += new(rnd.randint(0, 200))
        rows.append((i, text))
    long = new(500)
    rows += [(100 + i, new(30) + long[:rnd.randint(50, 500)] + new(30)) for i in range(30)]
    return rows + [(200, long), (201, long), (202, None), (203, ""), (None, long[:90]), rows[3], (204, "short"), (205, "short")]


@pytest.mark.parametrize("seed,length,group", [(1, 60, 1 << 15), (2, 48, 1 << 15), (3, 100, 3)])
def test_removed_bytes(spark, seed, length, group):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("h", F.lit(1)).withColumn("pos", F.lit("x"))
    got = suffix.remove_repeats(df, length=length, group=group).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, length)


def test_documents_of_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = suffix.remove_repeats(df).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 400)


def test_long_text_over_several_buffers(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BUFFER", 1 << 12)
    rnd = random.Random(9)
    new = lambda k: "".join(rnd.choice("abcdefghijklmnop") for _ in range(k))
    p = new(700)
    rows = [(1, new(9000) + p + new(5000)), (2, new(3000) + p[100:] + new(3000)), (3, new(20000))]
    got = suffix.remove_repeats(spark.createDataFrame(rows, SCHEMA), length=400).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 400)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix.remove_repeats(empty).collect() == []
    assert suffix.without_repeats(empty).collect() == []


def test_intervals_of_a_prefix_array():
    got = list(suffix.prefix_intervals([1, 3, 3, 0, 2, 1]))
    assert sorted(got) == [(1, 0, 3), (1, 4, 6), (2, 4, 5), (3, 1, 3)]
    assert list(suffix.prefix_intervals([])) == []


def test_texts_without_repeats_keep_whole_characters(spark):
    p = "é" * 30 + "".join(chr(97 + i * 7 % 26) for i in range(400))
    rows = [(1, "one " + p + " é end"), (2, "two " + p[5:] + " end"), (3, "clean"), (4, None), (5, p), (6, p), (7, " ")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit(1))
    out = suffix.without_repeats(df)
    assert out.columns == df.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[3] == "clean" and got[4] is None and got[7] == " " and not {5, 6} & set(got)
    assert got[1].startswith("one") and got[1].endswith("end") and len(got[1]) < 20
    assert got[2].startswith("two") and got[2].endswith("end") and len(got[2]) < 20


def test_places_are_packed_without_loss():
    pos, back, ahead = np.array([0, 5, 2 ** 31]), np.array([0, 5, 399]), np.array([0, 399, 16000])
    got = suffix.unpacked(suffix.packed(pos, pos - back, pos - back + ahead))
    assert [x.tolist() for x in got] == [x.tolist() for x in (pos, pos - back, pos - back + ahead)]


def test_texts_are_cut_in_small_batches(spark, monkeypatch):
    seen, before = {}, common.written

    def written(df, name, texts=False):
        seen[name] = texts
        return before(df, name, texts)

    monkeypatch.setattr(common, "written", written)
    p = "".join(chr(97 + i * 7 % 26) for i in range(450))
    rows = [(1, "one " + p), (2, "two " + p), (3, "clean")]
    got = {r["doc_id"]: r["text"] for r in suffix.without_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[3] == "clean" and len(got[1]) < 20 and len(got[2]) < 20
    assert seen["cuts"]


def test_batches_of_a_settled_table(spark):
    def sizes(batches):
        for pdf in batches:
            yield pdf.iloc[:1].assign(id=len(pdf))

    ids = spark.range(0, 3 * common.TEXT_ROWS, 1, 1)
    got = common.settled(spark, lambda: ids.mapInPandas(sizes, "id long"), "sizes", texts=True)
    assert [r["id"] for r in got.collect()] == [common.TEXT_ROWS] * 3


def test_memory_of_the_anchors():
    rnd = np.random.default_rng(4)
    raw = [bytes(rnd.integers(97, 123, 20_000, dtype=np.uint8)) for _ in range(100)]
    tracemalloc.start()
    try:
        for _ in suffix.anchors(raw, SpanHasher()):
            pass
        assert tracemalloc.get_traced_memory()[1] < 32 << 20
    finally:
        tracemalloc.stop()
