"""Separator scan of flat token files."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from engram.llm import bpe, tokencount
from engram.llm.common import scratch

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def files(spark, contents, width=2):
    folder = scratch(spark, "test")
    store, path = tokencount.filesystem(folder)
    store.create_dir(path, recursive=True)
    for name, ids in contents.items():
        with store.open_output_stream(f"{path}/{name}") as f:
            f.write(np.array(ids, dtype=f"<u{width}").tobytes() if isinstance(ids, list) else ids)
    return folder


def expected(ids, end):
    out, n, k = [], 0, 0
    for x in ids:
        if x == end:
            out.append((k, n, True))
            n, k = 0, k + 1
        else:
            n += 1
    return out + ([(k, n, False)] if n else [])


@pytest.mark.parametrize("width,block", [(2, 2), (2, 14), (4, 8), (2, 1 << 20)])
def test_blocks_are_stitched(spark, width, block):
    rnd = random.Random(block)
    contents = {f"f{i}.bin": [rnd.choice([9, 9, 9, 1, 2]) if i % 2 else rnd.choice([9, 3, 4, 5, 6, 7])
                              for _ in range(rnd.randint(0, 60))] for i in range(6)}
    contents |= {"none.bin": [], "all.bin": [9] * 20, "long.bin": [1] * 50, "once.bin": [1] * 30 + [9]}
    got = tokencount.separator_scan(spark, files(spark, contents, width), 9, width, block).collect()
    for name, ids in contents.items():
        own = sorted((r["ordinal"], r["n_tokens"], r["terminated"]) for r in got if r["file"] == name)
        assert own == expected(ids, 9), name


def test_bytes_that_look_like_a_separator_across_ids(spark):
    ids = [0x0901, 0x0109, 0x0909, 9, 0x0900]
    got = tokencount.separator_scan(spark, files(spark, {"a.bin": ids}), 9, 2, 4).collect()
    assert sorted((r["ordinal"], r["n_tokens"]) for r in got) == [(0, 3), (1, 1)]


def test_half_an_id_is_an_error(spark):
    folder = files(spark, {"a.bin": b"abc"})
    with pytest.raises(Exception, match="whole number"):
        tokencount.separator_scan(spark, folder, 9).collect()


def test_documents(spark):
    ranks = bpe.load_ranks(PATH)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(i, f"Some words, {i}. " * (i % 9)) for i in range(50)] + [(None, "x"), (3, None), (2, "a b"), (2, "a b"),
                                                                    (99, "<|endoftext|> " * 3), (2 ** 60 + 1, "long " * 9999)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ordinal", F.lit("mine"))
    got = sorted(map(tuple, tokencount.document_token_counts(df.repartition(3), PATH).collect()), key=str)
    assert got == sorted([(i, len(enc.encode_ordinary(t or ""))) for i, t in rows], key=str)
    assert tokencount.document_token_counts(df.limit(0), PATH).collect() == []
