"""Each stage of the pipeline on the rows that the one before kept."""

import uuid

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from engram.llm import bpe, mixing
from engram.llm.common import table
from engram.session import shared_path

from .test_jaccard import brute as similar
from .test_suffix import brute as removed

SF = "/root/testdata/sf0.001"


def kept(df, name):
    """As the pipeline does it: written, and read again."""
    path = shared_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(10 ** 6, None, "en", "src0", 0), (10 ** 6 + 1, "12 34 !", "en", "src0", 7),
                                 (None, "the document without an id and with words of its own here", "en", None, 9)], docs.schema)
    out = [docs.unionByName(odd)]
    for name, stage in cp.STAGES:
        out.append(kept(stage(spark, out[-1], SF), name))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_names_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "repeated_passages", "mix_sources", "encode"]
    assert all(s.columns == stages[0].columns for s in stages[1:5])


def test_language_keeps_clean_documents(stages):
    before, after = rows(stages[0]), rows(stages[1])
    gone = set(before) - set(after)
    assert {10 ** 6, 10 ** 6 + 1} <= gone and len(gone) <= 0.03 * len(before)
    assert all(after[i] == before[i] for i in after)


def test_one_document_of_each_group_stays(stages):
    before = [(r["doc_id"], r["text"]) for r in stages[1].collect() if r["doc_id"] is not None]
    want = {d for d, _, c in similar(before, 5, 4, 5) if d == c}
    assert set(rows(stages[2])) == want | {None}


def test_repeats_are_cut(stages):
    before = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    left = {d: (n - k) for d, n, k, _, _ in removed(before, 400)}
    after = rows(stages[3])
    assert set(after) <= set(left) and all(left[i] <= 4 for i in set(left) - set(after))
    for i, r in after.items():
        assert left[i] - 6 <= len(r["text"].encode()) <= left[i] and r["n_chars"] == len(r["text"])


def test_mix_takes_what_the_operator_says(stages):
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(stages[3]).collect() if r["taken"]}
    got = {}
    for r in stages[4].collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].split())
    assert {k: v for k, v in got.items() if k is not None} == {k: v for k, v in taken.items() if k is not None}


def test_ids_are_those_of_the_mix(stages):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    want = sorted((str(r["doc_id"]), enc.encode_ordinary(r["text"])) for r in stages[4].collect())
    assert sorted((str(r["doc_id"]), r["ids"]) for r in stages[5].collect()) == want


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").where(F.lit(False))
    for _, stage in cp.STAGES:
        docs = kept(stage(spark, docs, SF), "empty")
    assert docs.collect() == []


def test_near_duplicates_goes_by_rows(spark):
    text = lambda n: " ".join(f"w{n}x{i}" for i in range(60))
    rows = [(1, text(1)), (1, text(2)), (1, text(1)), (None, text(3) + " a"), (None, text(3) + " b"), (5, text(4)),
            (None, text(4) + " c"), (12, text(5)), (7, text(5) + " d"), (-3, text(6)), (2, text(6) + " e"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in cp.near_duplicates(spark, docs, "").collect()]
    ids = sorted((r[0] is None, r[0] or 0) for r in got)
    assert ids == [(False, -3), (False, 1), (False, 1), (False, 5), (False, 7), (False, 9), (True, 0)]
    assert {r[1] for r in got if r[0] == 1} == {text(1), text(2)}


def test_extra_and_clashing_columns(spark):
    """Columns that the operators use themselves come through every stage untouched."""
    names = ["_row", "_a", "_b", "_kept", "_text", "row", "name", "found", "ha", "hb", "kept", "size", "words", "extra.x"]
    text = lambda n: " ".join(f"word{n}letter{i}" for i in range(40))
    docs = spark.createDataFrame([(i, text(i % 6), "en", "s", 1) for i in range(12)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) for n in names])
    out = docs
    for name, stage in cp.STAGES[:-1]:
        out = kept(stage(spark, out, ""), "extra")
        assert out.columns == docs.columns, name
        rows_ = out.collect()
        assert rows_ and all(r[n] == f"{n}-{r['doc_id']}" for r in rows_ for n in names), name
    assert kept(cp.encode(spark, out, ""), "extra").count() == out.count()


def test_a_stage_leaves_other_results_alone(spark):
    from engram.llm import fingerprints
    docs = table(spark, SF, "documents").limit(40)
    other = fingerprints.edited_fingerprints(docs)
    for _, stage in cp.STAGES[1:4]:
        stage(spark, docs, SF).count()
    assert other.count() == 40


def test_large_ids_beside_nulls_stay_exact(spark):
    docs = spark.createDataFrame([(2 ** 60 + 1, "the words of this text are english words", "en", "s", None),
                                  (None, "some more words of an english text", "en", "s", 2 ** 60 + 3)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.language(spark, docs, "").collect()
    assert sorted(got, key=str) == sorted(docs.collect(), key=str)
