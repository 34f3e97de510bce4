"""Byte-level BPE against tiktoken."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engram.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
OWN = bpe.Encoder(RANKS)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def encoded(texts):
    ids, counts = OWN.encode(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


PIECES = st.sampled_from(["'", "'s", "'t", "'re", "'ve", "'m", "'ll", "'d", " ", "  ", "\n", "\t", "\r\n", "a", "The",
                          "é", "中文", "1", "٣", "!", "?!", "\x1c", "\x85", " ", "𝒳", "😀", "ing", "'S", "​", "Ⅷ"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join) | st.text(max_size=20), min_size=1, max_size=4))
def test_ids_are_those_of_tiktoken(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert encoded(texts) == [REFERENCE.encode_ordinary(t) for t in texts]


def test_long_pieces():
    for t in ("x" * 5000, "ab" * 3000, " " * 4000, "é" * 999, "0" * 1000 + " " * 30 + "!" * 500):
        assert encoded([t]) == [REFERENCE.encode_ordinary(t)]


def test_perfect_hash_is_minimal_and_exact():
    t = OWN.tables
    assert t.n == len(RANKS) and sorted(t.values.tolist()) == sorted(RANKS.values())
    rnd = np.random.default_rng(1)
    assert (t.find(rnd.integers(0, 1 << 63, 1000, dtype=np.uint64), np.ones(1000, dtype=np.int64)) == -1).all()


def test_documents(spark):
    rows = [(1, "It's  a test,\n\nthat's all. "), (2, None), (None, ""), (3, "zzqx " * 4000), (3, "zzqx " * 4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("mine"))
    out = bpe.encode_documents(df, PATH, with_ids=True).collect()
    assert len(out) == len(rows)
    for r, (i, t) in zip(sorted(out, key=lambda r: (r["doc_id"] or 9, r["n_tokens"])),
                         sorted(rows, key=lambda r: (r[0] or 9, len(r[1] or ""))), strict=True):
        ids = REFERENCE.encode_ordinary(t or "")
        assert (r["doc_id"], r["n_tokens"], r["ids"]) == (i, len(ids), ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(df.limit(0), PATH).collect() == []


@pytest.mark.parametrize("big", [2 ** 60 + 7])
def test_large_ids_stay_exact(spark, big):
    df = spark.createDataFrame([(big, "a"), (None, "b")], "doc_id long, text string")
    assert {r["doc_id"] for r in bpe.encode_documents(df, PATH).collect()} == {big, None}


def test_parts_of_a_long_text():
    """Texts in parts of a few characters give the ids of whole texts."""
    encoder = bpe.Encoder(bpe.load_ranks(PATH))
    for text in ("it's  a \n b  'll\t12 x  \n\n é日本 word ", "nospaceatall" * 9, " " * 40, "a  " * 30, "", "x " * 50):
        whole = encoder.encode([text, "next"])[0].tolist()
        got = [i for which, some in bpe.chunks([text, "next"], 5) for i in encoder.encode(some)[0].tolist()]
        assert got == whole
        assert "".join(bpe.parts(text, 5)) == text
