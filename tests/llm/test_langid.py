"""Language identification: held-out accuracy and odd rows."""

import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(out) == docs.count()
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out["doc_id"]]).all()
    own = out[out["held_out"]]
    assert (own["lang"] == own["lang_pred"]).mean() > 0.96
    assert out["score"].between(0, 1).all()


def test_odd_rows_and_labels_of_held_out_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0)
    rest = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, "the cat and the dog " * 9 if i % 2 else "le chat et le chien " * 9, "en" if i % 2 else "fr") for i in rest]
    rows += [(held, "der Hund und die Katze", "de"), (500, None, "en"), (501, "", "en"), (502, "123 !? \n", "en"),
             (None, "the cat", "xx"), (503, "the dog and the cat " * 3000, None), (503, "the dog and the cat " * 3000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")) \
              .withColumn("_text", F.lit("y"))
    out = langid.identify(df).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert {r["lang_pred"] for r in out} == {"en", "fr", "und"}      # neither the held-out label nor that of no id
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (500, 501, 502))
    assert by[503]["lang_pred"] == "en" and by[held]["held_out"] and by[None]["held_out"]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(df).collect() == []
    one = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.identify(one).first()["lang_pred"] == "und"


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = langid.ByteCNN(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, 256, (langid.LENGTH, 6)), rng.integers(0, 3, 6)
    loss = lambda: -np.log(net.predict(x)[np.arange(6), y]).mean()
    g = net._gradients(x, y)
    for name in ("out", "bias", "w3", "b2", "emb"):
        flat = net.p[name].reshape(-1)
        for i in np.argsort(-np.abs(g[name].ravel()))[:4]:
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert g[name].ravel()[i] == pytest.approx((up - down) / 2e-5, rel=2e-2, abs=1e-5), name


def test_windows_cover_the_text():
    raw = [b"", b"a" * 64, b"b" * 65, b"c"]
    w, text, real = langid.windows_of(raw)
    assert w.shape == (64, 4) and text.tolist() == [1, 2, 2, 3] and real.tolist() == [64, 64, 1, 1]


def test_sample_is_bounded(spark, monkeypatch):
    """20,000 rows of one id and text are one text of the sample; many texts of one id are ranked like others."""
    seen = []
    monkeypatch.setattr(langid.ByteCNN, "fit", lambda self, w, t: seen.append(w.shape[1]) or self)
    monkeypatch.setattr(langid, "TEXTS_PER_LANGUAGE", 50)
    one = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5)
    same = spark.range(20000).select(F.lit(one).cast("long").alias("doc_id"), F.lit("some words " * 30).alias("text"),
                                     F.lit("en").alias("lang"))
    langid.train(same)
    assert seen.pop() <= langid.WINDOWS_PER_TEXT
    langid.train(same.withColumn("text", F.concat("text", F.col("doc_id").cast("string"), F.rand(3).cast("string"))))
    assert seen.pop() <= 50 * 2 * langid.WINDOWS_PER_TEXT


def test_memory_of_the_network():
    windows = np.zeros((langid.LENGTH, langid.WINDOWS_AT_ONCE), dtype=np.uint8)
    net = langid.ByteCNN(["a", "b"])
    tracemalloc.start()
    try:
        net.predict(windows)
        assert tracemalloc.get_traced_memory()[1] < 16 << 20
    finally:
        tracemalloc.stop()
