from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException

from engram.operators import ivf, search
from engram.plans import q_search, q_stream
from engram.streaming import jobs as sj

KEY = "ghp_" + "Zx9" * 14


def _documents(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_ingest_whose_blocked_rows_cannot_be_read_fails(spark, tmp_path, monkeypatch):
    folder = _documents(spark, tmp_path, ["plain", f"token = {KEY}", "more"])
    got = sorted(map(tuple, q_stream.q_stream_ingest(spark, folder).collect()))
    assert got == [(0, True), (1, False), (2, True)]
    whole = sj.stream_ingest

    def lost(events, id_col, text_col, time_col, accepted, rejected):
        return whole(events, id_col, text_col, time_col, accepted, f"{rejected}-elsewhere")
    monkeypatch.setattr(sj, "stream_ingest", lost)
    with pytest.raises(AnalysisException):
        q_stream.q_stream_ingest(spark, folder).collect()


@pytest.mark.parametrize("texts", [[], ["plain", "more"], [f"token = {KEY}"]])
def test_ingest_without_blocked_or_without_safe_rows(spark, tmp_path, texts):
    got = sorted(map(tuple, q_stream.q_stream_ingest(spark, _documents(spark, tmp_path, texts)).collect()))
    assert got == [(i, KEY not in t) for i, t in enumerate(texts)]


def _checkpointed(spark):
    path = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return sum(f.stat().st_size for f in Path(path).rglob("*") if f.is_file())


def test_index_search_writes_no_pairs(spark, tmp_path):
    # without margin the codes leave nearly all of 300 x 3,000 pairs of vectors without structure
    rng = np.random.default_rng(3)
    m = spark.createDataFrame([(f"m{i:04d}", "u", rng.normal(size=64).tolist(), float(i % 3), None) for i in range(3000)],
                              "memory_id string, user_id string, embedding array<float>, importance double, deleted_at timestamp_ntz")
    q = spark.createDataFrame([(f"q{i}", "u", rng.normal(size=64).tolist()) for i in range(300)],
                              "request_id string, user_id string, embedding array<float>")
    ivf.build_index(m, str(tmp_path / "i"))
    before = _checkpointed(spark)
    got = ivf.search_index(q, str(tmp_path / "i"), 5, margin=None, block_rows=500)
    assert _checkpointed(spark) - before < 300 * 3000
    want = search.knn_exact(q, m, 5)
    cols = ["request_id", "memory_id", "rank"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_all_pairs_send_vectors_as_arrays_and_no_more_often_than_blocks_need(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    vec = lambda i: None if i % 29 == 0 else rng.normal(size=3 + (i % 7 == 0)).round(3).tolist()
    spark.createDataFrame([(i, vec(i), i % 10) for i in range(400)], "vec_id long, embedding array<float>, label int").write.parquet(
        f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, "text", "en", "s") for i in range(300)], "doc_id long, text string, lang string, source string"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    one = q_search.q_vector_functions(spark, str(tmp_path))
    lines = one._jdf.queryExecution().optimizedPlan().toString().splitlines()
    sent = [i for i, x in enumerate(lines) if "RepartitionByExpression" in x]
    assert len(sent) == 2 and "_a0" in "".join(lines[:sent[0]])
    depth = [len(lines[i]) - len(lines[i].lstrip(" :+-")) for i in range(len(lines))]
    for i in sent:      # below the exchange there are no columns of components yet
        below = lines[i + 1:next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))]
        assert below and not any("_a0" in x or "_b0" in x for x in below)
    monkeypatch.setattr(q_search, "PAIR_BLOCK_ROWS", 8)
    small = q_search.q_vector_functions(spark, str(tmp_path))
    assert sorted(map(str, one.collect())) == sorted(map(str, small.collect())) and one.count() > 10_000


def test_a_file_holds_few_batches_however_many_a_task_has(spark, monkeypatch):
    import public_tokenizers
    from engram.llm import alignment, common
    paths = []
    name = common.scratch
    monkeypatch.setattr(common, "scratch", lambda spark, what: paths.append((what, name(spark, what))) or paths[-1][1])
    docs = spark.createDataFrame([(i, f"word {i} and some more words") for i in range(30)], "doc_id long, text string").coalesce(1)
    tokenizers = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    got = alignment.align(docs, *tokenizers, batch=50)
    path = dict(paths)["aligned"].removeprefix("file:")
    rows = [pq.ParquetFile(f).metadata.num_rows for f in Path(path).glob("part-*.parquet")]
    assert sum(rows) >= 15 and max(rows) <= 4
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, alignment.align(docs, *tokenizers).collect()))
