"""Nothing is lost or doubled: chains of merges, partial updates, repeated
requests, missing time stamps, missing and short vectors."""


import pytest
from pyspark.sql import functions as F

from engram.operators import lifecycle as lc
from engram.operators import search as S
from engram.operators import working as wk
from engram.plans import quantiles
from engram.sources import io
from engram.sources import testdata as td


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def memories(spark):
    return td.memories(spark, SF)


def test_every_document_and_vector_is_a_memory(spark, memories):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("i"))
    vecs = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("i"))
    assert memories.count() == docs.union(vecs).distinct().count()


def test_a_chain_of_similar_rows_ends_in_one_row(spark, memories):
    import math
    rows = [(f"r{k}", "u1", "episodic", "event", f"text {k}", f"text {k}",
             [math.cos(math.radians(15 * k)), math.sin(math.radians(15 * k))], 0.5, [], f"s{k}", '{"a":1}') for k in range(7)]
    rows.append(("r9", "u1", "episodic", "event", "far", "far", [-1.0, 0.0], 0.5, [], "s9", None))
    inc = spark.createDataFrame(rows, "request_id string, user_id string, memory_category string, memory_subtype string, "
                                      "content string, summary string, embedding array<float>, importance double, "
                                      "entities array<string>, source_session string, metadata string")
    out, rep = lc.dedup_upsert(memories.limit(0), inc, td.as_of(), t=0.95)
    table = {r["memory_id"]: r for r in out.collect()}
    report = {r["request_id"]: r for r in rep.collect()}
    assert set(report) == {r[0] for r in rows}
    assert {r["memory_id"] for r in report.values()} == set(table) == {"n-r0", "n-r9"}
    assert table["n-r0"]["access_count"] == 6 and table["n-r0"]["content"] == "text 6"
    assert table["n-r0"]["source_session"] == "s0" and table["n-r9"]["source_session"] == "s9"


def test_two_changes_to_one_row_both_apply(spark, memories):
    m = memories.where("deleted_at IS NULL AND embedding IS NOT NULL").orderBy("memory_id").limit(3)
    ids = [(r["memory_id"], r["user_id"]) for r in m.collect()]
    (a, ua), (b, ub), (c, uc) = ids
    secret = "pass" + "word = " + "'hunter2hunter2'"
    ch = [("1", a, ua, "new text", None), ("2", a, ua, None, 0.25), ("3", a, ua, "newer text", None), ("4", b, ub, None, 0.75),
          ("5", c, uc, secret + " AKIA" + "IOSFODNN7EXAMPLE", None), ("6", "none", ua, "x", None), ("7", b, ub, None, None)]
    df = spark.createDataFrame(ch, "request_id string, memory_id string, user_id string, content string, importance double") \
              .withColumn("entities", F.lit(None).cast("array<string>")).withColumn("metadata", F.lit(None).cast("string"))
    out, rep = lc.update_memories(m, df, td.as_of(), 64)
    status = {r["request_id"]: r["status"] for r in rep.collect()}
    assert status == {"1": "ok", "2": "ok", "3": "ok", "4": "ok", "5": "blocked", "6": "not_found", "7": "empty"}
    before, after = ({r["memory_id"]: r for r in x.collect()} for x in (m, out))
    assert after[a]["content"] == "newer text" and after[a]["importance"] == 0.25
    assert after[a]["embedding"] != before[a]["embedding"] and len(after[a]["embedding"]) == 64
    assert after[b]["importance"] == 0.75 and after[b]["embedding"] == before[b]["embedding"]
    assert after[c]["content"] == before[c]["content"] and out.count() == 3


def test_repeated_requests_do_not_repeat_rows(spark, memories):
    one = memories.where("embedding IS NOT NULL").orderBy("memory_id").limit(2)
    ids = [r["memory_id"] for r in one.collect()]
    vec = spark.createDataFrame([(ids[0], [1.0], 1), (ids[0], [2.0], 2)], "memory_id string, embedding array<float>, o int")
    got = {r["memory_id"]: r["embedding"] for r in lc.set_embeddings(one, vec, td.as_of(), order="o").collect()}
    assert len(got) == 2 and got[ids[0]] == [2.0]
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    d = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z")], "k int, v string")
    assert sorted(map(tuple, io.insert_or_replace(t, d, "k").collect())) == [(1, "y"), (2, "b"), (3, "z")]
    items = td.items(spark, SF)
    first = items.orderBy("item_id").first()
    ch = spark.createDataFrame([(first["item_id"], first["session_id"], True, None),
                                (first["item_id"], first["session_id"], None, 0.125)],
                               "item_id string, session_id string, pinned boolean, relevance_score double")
    out, _ = wk.update_item_flags(items, ch, td.as_of())
    row = out.where(F.col("item_id") == first["item_id"]).collect()
    assert len(row) == 1 and row[0]["pinned"] and row[0]["relevance_score"] == 0.125
    s = td.sessions(spark, SF)
    req = spark.createDataFrame([(first["session_id"], True), (first["session_id"], False)],
                                "session_id string, preserve_pinned boolean")
    kept, ses, rep = wk.clear_sessions(items, s, req)
    assert rep.count() == 1 and ses.count() == s.count() and rep.first()["remaining_tokens"] == 0
    assert kept.count() == items.where(F.col("session_id") != first["session_id"]).count()
    seeds = spark.createDataFrame([("q2", "uX", "new"), ("q1", "uX", "new"), ("q3", "uX", "other")],
                                  "request_id string, user_id string, summary string")
    got = io.seed_if_absent(memories, seeds)
    assert got.columns == seeds.columns and sorted(r["request_id"] for r in got.collect()) == ["q1", "q3"]
    new = wk.init_sessions(s, spark.createDataFrame([("sN", "ub"), ("sN", "ua"), (None, "uc"), (None, "uc")],
                                                    "session_id string, user_id string"), td.as_of()).collect()
    assert len({r["session_id"] for r in new}) == 3 and {r["user_id"] for r in new if r["session_id"] == "sN"} == {"ua"}


def test_backup_of_rows_without_a_time_stamp(spark, memories):
    m = memories.orderBy("memory_id").limit(4)
    none = m.withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    out, rep = io.incremental_backup(m, none)
    assert out.count() == 4 and {r["kind"]: r["n"] for r in rep.collect()} == {"added": 0, "refreshed": 4}
    out, rep = io.incremental_backup(none, none)
    assert out.count() == 4 and {r["kind"]: r["n"] for r in rep.collect()} == {"added": 0, "refreshed": 0}


@pytest.mark.parametrize("method", ["block", "sql"])
def test_missing_and_short_vectors_take_no_part(spark, method):
    m = spark.createDataFrame([("a", "u", [1.0, 0.0], 0.5, None), ("b", "u", None, 0.5, None), ("c", "u", [1.0], 0.5, None),
                               ("d", "u", [0.0, 1.0], None, None), ("e", "u", [], 0.5, None), ("f", "u", [1.0, None], 0.5, None)],
                              "memory_id string, user_id string, embedding array<float>, importance double, deleted_at timestamp_ntz")
    q = spark.createDataFrame([("q1", "u", [1.0, 0.0]), ("q2", "u", None), ("q3", "u", [2.0])],
                              "request_id string, user_id string, embedding array<float>")
    got = sorted((r["request_id"], r["memory_id"], r["rank"]) for r in S.knn_exact(q, m, 5, method=method).collect())
    assert got == [("q1", "a", 1), ("q1", "d", 2), ("q3", "c", 1)]


def test_newest_pointer_wins_and_older_ones_stay(spark):
    from engram.session import shared_path
    import uuid
    root = shared_path(spark, f"t-{uuid.uuid4().hex}")
    for k in range(3):
        io.write_snapshot(spark.range(k + 1), root)
    assert io.read_current(spark, root).count() == 3


def test_quantile_of_a_constant_group(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 2 == 0, 1.0)
                                    .otherwise(F.col("id").cast("double")).alias("v"))
    t = spark.createDataFrame([(0, 2000), (1, 2400)], "g long, target long")
    got = {r["g"]: r["order_stat"] for r in quantiles.order_stat(rows, ["g"], "v", t).collect()}
    assert got == {0: 1.0, 1: 4801.0}


def test_whole_texts_decide_which_seed_is_there(spark, memories):
    head = "x" * 80
    one = memories.where(F.col("deleted_at").isNull()).limit(1).withColumn("user_id", F.lit("uX")) \
                  .withColumn("content", F.lit(head + " stored")).withColumn("summary", F.lit(head))
    seeds = spark.createDataFrame([("q1", "uX", head + " stored"), ("q2", "uX", head + " a"), ("q3", "uX", head + " b"),
                                   ("q4", "uX", head + " b"), ("q5", "uX", None), ("q6", "uX", None)],
                                  "request_id string, user_id string, content string")
    got = io.seed_if_absent(one, seeds, text="content").collect()
    assert sorted(r["request_id"] for r in got) == ["q2", "q3", "q5", "q6"]


def test_seed_query_and_copies_use_whole_rows(spark, monkeypatch):
    from engram.plans import q_io
    seen = {}
    monkeypatch.setattr(q_io.io, "parity_check", lambda p, s, key, f=io.parity_check: (
        seen.setdefault("parity", []).extend([p.columns, s.columns]), f(p, s, key))[1])
    monkeypatch.setattr(q_io.io, "export_user_memories", lambda m, u, path, f=io.export_user_memories: (
        seen.setdefault("export", m.columns), f(m, u, path))[1])
    whole = td.memories(spark, SF).columns
    q_io.q_parity_check(spark, SF)
    q_io.q_mirror_write(spark, SF)
    q_io.q_export(spark, SF)
    assert all(set(c) == set(whole) for c in seen["parity"]) and len(seen["parity"]) == 4
    assert set(seen["export"]) == set(whole)
    requests = td.requests(spark, SF)
    monkeypatch.setattr(q_io.td, "requests", lambda *a: requests.withColumn("query", F.concat(
        F.lit("y" * 80), F.col("request_id"))))
    assert q_io.q_seed_if_absent(spark, SF).count() == requests.count()


def test_superseded_rows_are_all_named_or_reported(spark, memories):
    m = memories.where("deleted_at IS NULL").select("*").orderBy("memory_id").limit(5)
    ids = sorted(r["memory_id"] for r in m.collect())
    user = "u-one"
    m = m.withColumn("user_id", F.lit(user)).withColumn("supersedes", F.lit(None).cast("string"))
    a, b, c, d, e = ids
    pairs = spark.createDataFrame([(a, c, user), (b, c, user), (d, e, user), (d, a, user), (e, e, user), (None, c, user),
                                   ("x", c, user), (b, "y", user)], "old_id string, new_id string, user_id string")
    out, rep = lc.supersede(m, pairs, td.as_of())
    after = {r["memory_id"]: r for r in out.collect()}
    errors = {(r["old_id"], r["new_id"]): r["error"] for r in rep.collect()}
    dead = {i for i, r in after.items() if r["deleted_at"] is not None}
    named = {r["supersedes"] for r in after.values()} - {None}
    assert dead == named == {a, d} and after[c]["supersedes"] == a and after[a]["supersedes"] == d
    assert errors[a, c] is None and errors[d, a] is None and errors[b, c] == f"New memory {c} already supersedes {a}"
    assert all(errors[k] for k in ((d, e), (e, e), (None, c), ("x", c), (b, "y"))) and len(errors) == 8


def test_a_vector_of_another_length_is_refused(spark, memories):
    m = memories.where("deleted_at IS NULL AND embedding IS NOT NULL").orderBy("memory_id").limit(2).withColumn(
        "embedding", F.array_repeat(F.lit(0.5).cast("float"), 128))
    changes = m.select(F.concat(F.lit("c"), "memory_id").alias("request_id"), "memory_id", "user_id",
                       F.lit("another text").alias("content"), F.lit(None).cast("double").alias("importance"),
                       F.lit(None).cast("array<string>").alias("entities"), F.lit(None).cast("string").alias("metadata"))
    out, rep = lc.update_memories(m, changes, td.as_of(), 64)
    assert {r["status"] for r in rep.collect()} == {"dimension"}
    assert sorted(map(str, out.collect())) == sorted(map(str, m.collect()))
    out, rep = lc.update_memories(m, changes, td.as_of(), 128)
    assert {r["status"] for r in rep.collect()} == {"ok"} and {len(r["embedding"]) for r in out.collect()} == {128}


def test_parity_sees_nulls_repeats_and_columns(spark):
    def differ(left, right, schema="k string, a string, b string", ranges=4):
        p, s = (spark.createDataFrame(x, schema) for x in (left, right))
        return sorted((r["k"], r["status"]) for r in io.parity_check(p, s, "k", ranges).collect())

    assert differ([("1", "x", None)], [("1", None, "x")]) == [("1", "different")]
    same = [("1", "x", "y"), ("1", "x", "y"), ("1", "z", None), (None, "n", None)]
    assert differ(same, same[::-1]) == []
    assert differ(same, same[1:]) == [("1", "different")]
    assert sorted(map(str, differ(same, same[:3]))) == ["(None, 'missing_in_secondary')"]
    assert differ([("1", "x", "y")], [("1", "x", "y"), ("2", None, None)]) == [("2", "missing_in_primary")]
    p = spark.createDataFrame([("1", [1, None])], "k string, a array<int>")
    s = spark.createDataFrame([("1", [None, 1])], "k string, a array<int>")
    assert io.parity_check(p, s, "k").collect()[0]["status"] == "different"
    assert io.parity_check(p, p, "k").collect() == []
    assert [r["status"] for r in io.parity_check(p, p.withColumn("more", F.lit(1)), "k").collect()] == ["different"]
    assert io.parity_check(p.limit(0), s.limit(0), "k").collect() == []


def test_only_differing_ranges_are_moved(spark):
    """One changed row of 20,000: the rows that are grouped by key are those of its range."""
    p = spark.range(20000).select(F.col("id").cast("string").alias("k"), (F.col("id") * 7).alias("v"))
    s = p.withColumn("v", F.when(F.col("k") == "123", F.lit(0)).otherwise(F.col("v")))
    assert [tuple(r) for r in io.parity_check(p, s, "k").collect()] == [("123", "different")]
    plan = io.parity_check(p, s, "k")._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "CartesianProduct" not in plan
