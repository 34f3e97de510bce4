"""N-gram Jaccard join against brute force."""

import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.llm import common, graph, jaccard
from engram.llm.bpe import SpanHasher
from engram.llm.graph import components

SCHEMA = "doc_id long, text string"


def grams(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, num, den):
    sets = [grams(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in
                   enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(seed, copies=40):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "of", "and"]) if rnd.random() < 0.4 else f"w{rnd.randint(0, 400)}"
    rows = []
    for _ in range(25):
        rows.append(" ".join(word() for _ in range(rnd.choice([0, 1, 2, 3, 5, 12, 30, 60, 120]))))
    base = [word() for _ in range(80)]
    for _ in range(copies):                                  # near copies about the threshold
        t = list(base)
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(len(t))] = word()
        rows.append(" ".join(t))
    chain = [f"c{i}" for i in range(60)]
    for k in range(20):                                      # each like the next, the ends unlike
        rows.append(" ".join(chain[k:] + [f"d{i}" for i in range(k)]))
    line = " ".join(word() for _ in range(10))               # a common line in different texts
    rows += [" ".join(word() for _ in range(40)) + "\n" + line for _ in range(20)]
    rows += [rows[3].upper(), rows[3].replace(" ", " \t\n "), "É é", "é é", "a" * 3000]
    ids = rnd.sample(range(10000), len(rows))
    return [(i, t) for i, t in zip(ids, rows, strict=True)]


@pytest.mark.parametrize("seed,n,num,den", [(1, 3, 9, 10), (2, 5, 4, 5), (3, 1, 1, 2), (4, 2, 7, 10)])
def test_components(spark, monkeypatch, seed, n, num, den):
    monkeypatch.setattr(jaccard, "BLOCK", 7)                 # long lists in several blocks
    rows = corpus(seed) + [(None, "no id here at all"), (20001, None), (20002, ""), (20003, " \n")]
    rows += [rows[30], rows[30], (None, rows[31][1])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("x")).withColumn("token", F.lit(1))
    got = jaccard.similar_components(df, n, (num, den)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, n, num, den)


def test_documents_of_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = jaccard.similar_components(df, 3, (9, 10)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 3, 9, 10)


def test_empty(spark):
    assert jaccard.similar_components(spark.createDataFrame([], SCHEMA)).collect() == []
    got = jaccard.similar_components(spark.createDataFrame([(1, None)], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(1, 0, 1)]


def test_similar_sets_share_prefixes_under_every_order():
    rnd = np.random.default_rng(3)
    for _ in range(300):
        a = rnd.choice(500, rnd.integers(1, 60), replace=False).astype(np.uint64)
        b = np.unique(np.concatenate([a[rnd.random(len(a)) < 0.95], rnd.choice(500, 3).astype(np.uint64)]))
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        if 10 * both < 8 * (len(a) + len(b) - both):
            continue
        last = np.unique(rnd.choice(500, 100).astype(np.uint64))
        orders = jaccard.Orders(last, rnd.permutation(len(last)).astype(np.uint64))
        for k in range(3):
            p = [orders.prefix(s, orders.level(s), k, jaccard.prefix_size(len(s), (4, 5))) for s in (a, b)]
            assert len(np.intersect1d(*p))


def test_shingles_follow_words():
    hasher = SpanHasher()
    texts = ["a b c d", "A\tb  C\nd", "b c d", "a b", "a  b ", "a", "", " ", "ab", "a b c d a b c"]
    s = [set(x.tolist()) for x in jaccard.shingle_sets(texts, 3, hasher)]
    assert [len(x) for x in s] == [len(grams(t, 3)) for t in texts]
    assert s[0] == s[1] and s[2] < s[0] and s[3] == s[4] != s[8] and not s[6] and s[0] < s[9]


def test_long_chain_is_one_component(spark):
    n = 300
    df = spark.range(n - 1).select((F.col("id") * 7 % n).alias("a"), ((F.col("id") + 1) * 7 % n).alias("b"))
    got = components(df.union(spark.createDataFrame([(1000, 1001), (1002, 1001)], "a long, b long"))).collect()
    assert {r["root"] for r in got if r["node"] < n} == {0} and sum(r["node"] < n for r in got) == n
    assert {r["root"] for r in got if r["node"] >= n} == {1000}


def test_parities_never_exceed_the_difference():
    rnd = np.random.default_rng(5)
    for _ in range(200):
        a = np.unique(rnd.integers(0, 1 << 62, rnd.integers(1, 900)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rnd.random(len(a)) < rnd.random()], rnd.integers(0, 1 << 62, rnd.integers(1, 900)).astype(np.uint64)]))
        apart = len(np.setxor1d(a, b))
        assert jaccard.parity_distance(jaccard.parity_row(a), jaccard.parity_row(b)) <= apart
        assert jaccard.parity_distance(jaccard.parity_row(a), jaccard.parity_row(a)) == 0


def test_values_of_a_portion_that_are_frequent():
    rnd = np.random.default_rng(6)
    for n in (0, 1, 2, 3, 7, 5000):
        held = np.sort(rnd.integers(0, max(1, n // 3), n).astype(np.uint64))
        value, count = np.unique(held, return_counts=True)
        got = jaccard._runs(held, 3)
        assert got[0].tolist() == value[count >= 3].tolist() and got[1].tolist() == count[count >= 3].tolist()
    held = np.sort(rnd.integers(0, 1 << 62, 1 << 20).astype(np.uint64))
    tracemalloc.start()
    try:
        jaccard._runs(held, 3)
        assert tracemalloc.get_traced_memory()[1] < held.nbytes // 2
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("portion", [5, 64, 1 << 22])
def test_portions_of_tokens(spark, monkeypatch, portion):
    monkeypatch.setattr(jaccard, "PORTION", portion)
    monkeypatch.setattr(jaccard, "REPORTED", 1)
    texts = [" ".join(f"w{(i * j) % 7}" for j in range(i)) for i in range(20)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    orders = jaccard._frequent(docs, 2)
    sets = list(jaccard.shingle_sets(texts, 2, SpanHasher()))
    token, count = np.unique(np.concatenate(sets), return_counts=True)
    assert orders.last.tolist() == token.tolist()
    by_rank = count[np.argsort(orders.ranks)]
    assert (np.diff(by_rank) >= 0).all()


def test_steps_without_anything_to_find_are_not_planned(spark, monkeypatch):
    """Each planned exchange costs the driver memory."""
    rounds = []
    monkeypatch.setattr(jaccard, "components", lambda edges: rounds.append(1) or components(edges))
    line = " ".join(f"common{i}" for i in range(8))          # a long list whose rows are not similar
    far = [(i, " ".join(f"w{i}x{j}" for j in range(30)) + " " + line) for i in range(20)]
    near = [(100, " ".join(f"n{j}" for j in range(60))), (101, " ".join(f"n{j}" for j in range(59)))]
    got = jaccard.similar_components(spark.createDataFrame(far + near, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == brute(far + near, 5, 4, 5)
    assert len(rounds) == 1


def test_stars_take_one_round(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(graph, "written", lambda df, name: tables.append(name) or common.written(df, name))
    edges = spark.createDataFrame([(1, 2), (1, 3), (4, 9), (9, 4)], "a long, b long")
    assert sorted(map(tuple, components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (9, 4)]
    assert len(tables) == 2
