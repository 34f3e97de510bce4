"""The Merkle manifest against a tree built by hand."""

import hashlib
import zlib

import pytest

from engram.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def tree(digests):
    """Top, and for every leaf its siblings (before, after) from below."""
    paths, under = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        up, ups = [], []
        for a in range(0, len(digests), 3):
            run = digests[a:a + 3]
            for k, leaves in enumerate(under[a:a + 3]):
                for i in leaves:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(h("".join(run)))
            ups.append(sum(under[a:a + 3], []))
        digests, under = up, ups
    return digests[0], paths


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    tops, parts = [], []
    for s in sources:
        mine = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(leaf(r, r[4]))))
        top, paths = tree([leaf(r, r[4]) for r in mine])
        tops.append(top)
        parts.append((mine, paths))
    root, over = tree(tops)
    out = []
    for k, (mine, paths) in enumerate(parts):
        for r, own in zip(mine, paths):
            path, text = own + over[k], r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            now = leaf(r, text)
            for a, b in path:
                now = h(a + now + b)
            out.append((r[0], leaf(r, r[4]), tops[k], root, h("".join(a + b for a, b in path)), now, now == root))
    return sorted(out, key=str)


def got(spark, rows):
    df = merkle.verified_manifest(spark.createDataFrame(rows, SCHEMA))
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_many_sizes(spark):
    """Sources of 1, 2, 3, 4, 27, 28 and 100 rows, a null source, null fields."""
    rows, i = [], 0
    for source, n in (("a", 1), ("b", 2), ("é", 3), ("z", 4), (None, 27), ("c", 28), ("", 100)):
        for _ in range(n):
            rows.append((i, source, None if i % 5 == 0 else "en", i % 7, None if i % 11 == 0 else f"line {i}\nänd\n" * (i % 3)))
            i += 1
    expected = brute(rows)
    assert got(spark, rows) == expected
    assert 0 < sum(e[-1] for e in expected) < len(expected)


@pytest.mark.parametrize("n", [1, 3])
def test_one_source(spark, n):
    rows = [(i, "s", "en", 1, "a\nb") for i in range(n)]
    assert got(spark, rows) == brute(rows)


def test_lone_leaves(spark):
    rows = [(i, f"s{i:03d}", "en", 1, "x") for i in range(31)]
    assert got(spark, rows) == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "s", "en", 1, "a\nb")] * 5 + [(None, "s", "en", 1, "a\nb")] * 2 + [(1, "s", "en", 1, "other")]
    assert got(spark, rows) == brute(rows)


def test_empty_table_and_other_columns(spark):
    assert got(spark, []) == []
    rows = [(i, "s", "en", 1, f"t{i}\n") for i in range(9)]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA + ", tree int, place int, up int, digest int")
    assert sorted((tuple(r) for r in merkle.verified_manifest(df).collect()), key=str) == brute(rows)


def test_heights():
    assert [merkle.height(n) for n in (0, 1, 2, 3, 4, 9, 10, 27, 28)] == [0, 0, 1, 1, 2, 2, 3, 3, 4]
