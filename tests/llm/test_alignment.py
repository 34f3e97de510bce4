"""Tokenizer alignment against whole-text encodings, aligned token by token."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engram.llm import alignment

PATH_A, PATH_B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(PATH_A, PATH_B)


def brute(aligner, texts):
    """Rows by the definition: whole texts encoded, byte offsets, sets of documents."""
    rows, holders = [], defaultdict(set)
    for k, t in enumerate(texts):
        links, groups = [], []
        if t:
            whole = (" " + t).encode()
            a, b = aligner.a.encode([t])[0], aligner.b.encode([t])[0]
            if b"".join(aligner.a.bytes[i] for i in a) == whole == b"".join(aligner.b.bytes[i] for i in b):
                spans = []
                for ids, tokens in ((a, aligner.a.bytes), (b, aligner.b.bytes)):
                    at, own = 0, []
                    for i in ids:
                        own.append((at, at + len(tokens[i]), i))
                        at += len(tokens[i])
                    spans.append(own)
                sa, sb = spans
                j = 0
                for x, y, i in sa:
                    while sb[j][1] <= x:
                        j += 1
                    q = j
                    while q < len(sb) and sb[q][0] < y:
                        links.append((i, sb[q][2]))
                        q += 1
                cuts = sorted({y for _, y, _ in sa} & {y for _, y, _ in sb})
                before = 0
                for c in cuts:
                    groups.append(([i for _, y, i in sa if before < y <= c], [i for _, y, i in sb if before < y <= c]))
                    before = c
            else:
                a = b = []
        else:
            a = b = []
        for p in links:
            holders[p].add(k)
        rows.append((a, b, groups, links))
    best = Counter()
    for (i, _), d in holders.items():
        best[i] = max(best[i], len(d))
    out = []
    for a, b, groups, links in rows:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(len(holders[p]) == best[p[0]] for p in links),
                    sum(len(holders[p]) for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


ODD = ["a", " ", "  ", "   x", "x ", "x  ", "a  b", "a\n b \n\n c ", "\n", "tab\t x", "it's 12'll", "ä́ é", "日本語 の", "  nb",
       "<|endoftext|> <s> </s> <0x41> <unk>", "▁ mark", "😀😀 z", "\x00 nul", "x　 y", "a" * 300, "word " * 50]


def got(spark, texts, **options):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = sorted(alignment.align(df, PATH_A, PATH_B, **options).collect())
    assert [r[0] for r in rows] == list(range(len(texts)))
    return [tuple(r[1:]) for r in rows]


def test_units_give_the_text_back():
    for t in ODD:
        assert "".join(" " + u for u in alignment.units(t)) == " " + t


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab c.\n\t'é日1 ", max_size=24), max_size=6))
def test_batch_against_whole_texts(texts):
    aligner = test_batch_against_whole_texts.aligner = getattr(
        test_batch_against_whole_texts, "aligner", None) or alignment.Aligner(PATH_A, PATH_B)
    b = aligner.batch(texts)
    expected = brute(aligner, texts)
    assert list(zip(*[f.tolist() for f in b.figures], b.sha)) == [(*e[:4], e[6]) for e in expected]
    counts = Counter(p for k, t in enumerate(texts) for p in set(_links(aligner, t)))
    assert dict(zip(b.pairs.tolist(), b.docs.tolist())) == {x * aligner.n_b + y: n for (x, y), n in counts.items()}


def _links(aligner, t):
    """The links of one text: two offsets lists, all pairs that overlap."""
    if not t:
        return []
    ends = []
    for side in (aligner.a, aligner.b):
        ids = side.encode([t])[0]
        stops = np.cumsum([len(side.bytes[i]) for i in ids]).tolist()
        ends.append(list(zip(ids, [0, *stops[:-1]], stops)))
    whole = (" " + t).encode()
    if any(b"".join(s.bytes[i] for i, _, _ in e) != whole for s, e in zip((aligner.a, aligner.b), ends)):
        return []
    return [(i, j) for i, x, y in ends[0] for j, u, v in ends[1] if x < v and u < y]


def test_components_of_long_chains():
    """Tokens that never end together until the last: doubling walks the whole chain."""
    a, b = np.append(np.arange(2, 2001, 2), 2001), np.append(np.arange(1, 2001, 2), 2001)
    ga, gb = alignment.components(a, b)
    assert set(ga.tolist()) == set(gb.tolist()) == {0}
    ga, gb = alignment.components(np.array([3, 5, 9]), np.array([1, 3, 4, 9]))
    assert ga.tolist() == [0, 1, 1] and gb.tolist() == [0, 0, 1, 1]
    assert [x.tolist() for x in alignment.overlaps(np.array([3, 5, 9]), np.array([1, 3, 4, 9]))] == [[0, 0, 1, 1, 2], [0, 1, 2, 3, 3]]


def test_odd_texts_in_small_batches(spark, aligner):
    texts = [*ODD, None, "", *ODD[:5], "the cat sat", "the cat sat on the mat " * 40]
    expected = brute(aligner, texts)
    assert got(spark, texts) == expected
    assert got(spark, texts, batch=50) == expected


def test_table(spark, aligner):
    """All documents of the small table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id")
    rows = docs.collect()
    out = sorted(alignment.align(docs, PATH_A, PATH_B, batch=1 << 16).collect())
    assert [tuple(r[1:]) for r in out] == brute(aligner, [r["text"] for r in rows])


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a c"), (2, None)], "doc_id long, text string").withColumns(
        {c: F.lit(1) for c in ("batch", "pairs", "n_a", "ids")})
    out = sorted(alignment.align(df, PATH_A, PATH_B).collect(), key=str)
    assert len(out) == 4 and out[0]["count_sum"] == 5 and out[0]["n_a"] == 2      # " a" is linked in three rows, " b" in two
    assert {r["doc_id"]: r["n_links"] for r in out} == {1: 2, None: 2, 2: 0}
    assert alignment.align(df.limit(0), PATH_A, PATH_B).collect() == []


def test_very_long_text(aligner):
    words = " ".join(f"w{i % 977} und\n" for i in range(200000))
    b = aligner.batch(["x", words])
    assert b.figures[0][1] > 400000 and b.sha[0] != b.sha[1]
