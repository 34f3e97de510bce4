import datetime as dt

from pyspark.sql import functions as F

from engram.operators import context as cx
from engram.operators import lifecycle as lc
from engram.operators import links as lk
from engram.sources import io
from engram.sources.testdata import ts

T0 = dt.datetime(2024, 5, 1)
MEM = ("memory_id string, user_id string, org_id string, memory_category string, memory_subtype string, content string, "
       "summary string, embedding array<float>, entities array<string>, metadata string, event_time timestamp_ntz, "
       "is_temporal boolean, importance double, access_count int, decay_factor double, supersedes string, "
       "source_session string, source_type string, confidence double, created_at timestamp_ntz, "
       "last_accessed timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz")


def mem_row(mid, user, cat, sub, content, vec, imp=0.5, ents=None, deleted=None):
    return (mid, user, None, cat, sub, content, content[:20], vec, ents, None, None, False, imp, 0, 1.0, None,
            None, "conversation", 1.0, T0, None, T0, deleted)


def test_planned_flow(spark):
    """2 memories, 1 working item, 1 request (budget 2000, focus table:users)."""
    mems = spark.createDataFrame([
        mem_row("m1", "u", "procedural", "workflow", "To add a column to table users run a migration.",
                [1.0, 0.1, 0.0], 0.9, ["table:users"]),
        mem_row("m2", "u", "semantic", "project", "The users table stores accounts.", [0.9, 0.2, 0.1], 0.6),
    ], MEM)
    items = spark.createDataFrame([("i1", "s", "u", "task_state", "Adding email column", 5, 1.0, False, 1, T0, T0)],
                                  "item_id string, session_id string, user_id string, content_type string, content string, token_count int, relevance_score double, pinned boolean, sequence_num int, created_at timestamp_ntz, last_accessed timestamp_ntz")
    intent = spark.createDataFrame([("How do I add a column?",)], "t string").select(
        cx.normalize_intent("t").alias("i")).first()["i"]
    assert intent == "how_to"
    req = spark.createDataFrame([("q1", "s", "u", [1.0, 0.1, 0.0], intent, 2000, ["table:users"])],
                                "request_id string, session_id string, user_id string, embedding array<float>, intent string, token_budget int, focus_entities array<string>")
    out = cx.assemble_context(req, items, mems).orderBy("position").collect()
    assert out and out[0]["total_tokens"] > 0
    assert out[0]["source"] == "working_memory"
    lt = [r for r in out if r["source"] == "long_term"]
    assert lt and lt[0]["memory_id"] == "m1" and "entity match" in lt[0]["why_included"]


def test_pack_skips_then_dedups(spark):
    # the fold first checks the budget, then the 200-char prefix
    cands = spark.createDataFrame([
        ("r", "a", 0.9, 50, "same text"), ("r", "b", 0.8, 5000, "other"), ("r", "c", 0.7, 50, "same text"),
        ("r", "d", 0.6, 60, "third")], "request_id string, memory_id string, score double, token_count int, content string")
    per, fold = cx.pack_context(cands)
    base = spark.createDataFrame([("r", 1000, 0)], "request_id string, token_budget int, working_used long")
    r = base.join(per, "request_id").select(fold.alias("r")).first()["r"]
    assert r["picked"] == ["a", "d"] and r["used"] == 110


def test_dedup_upsert_batch_rules(spark):
    mems = spark.createDataFrame([mem_row("m1", "u", "semantic", "domain", "old", [1.0, 0.0])], MEM)
    inc = spark.createDataFrame([
        ("r1", "u", "semantic", "domain", "new a", "s", [1.0, 0.01], 0.7, None),   # hits m1
        ("r2", "u", "semantic", "domain", "new b", "s", [0.99, 0.02], 0.8, None),  # hits m1 too (latest wins)
        ("r3", "u", "semantic", "domain", "fresh", "s", [0.0, 1.0], 0.4, None),   # new
        ("r4", "u", "semantic", "domain", "fresh2", "s", [0.01, 1.0], 0.3, None),  # merges into r3
    ], "request_id string, user_id string, memory_category string, memory_subtype string, content string, summary string, embedding array<float>, importance double, entities array<string>")
    out, rep = lc.dedup_upsert(mems, inc, ts("2024-07-01 00:00:00"), t=0.95)
    rep = {r["request_id"]: (r["action"], r["memory_id"]) for r in rep.collect()}
    assert rep == {"r1": ("updated", "m1"), "r2": ("updated", "m1"), "r3": ("inserted", "n-r3"),
                   "r4": ("merged", "n-r3")}
    rows = {r["memory_id"]: r for r in out.collect()}
    assert rows["m1"]["content"] == "new b" and rows["m1"]["access_count"] == 2
    assert rows["n-r3"]["content"] == "fresh2" and rows["n-r3"]["access_count"] == 1
    assert len(rows) == 2


def test_supersede_and_errors(spark):
    mems = spark.createDataFrame([mem_row("a", "u", "s", "d", "x", [1.0]), mem_row("b", "u", "s", "d", "y", [1.0]),
                                  mem_row("c", "v", "s", "d", "z", [1.0])], MEM)
    pairs = spark.createDataFrame([("a", "b", "u"), ("c", "b", "u")], "old_id string, new_id string, user_id string")
    out, rep = lc.supersede(mems, pairs, ts("2024-07-01 00:00:00"))
    rows = {r["memory_id"]: r for r in out.collect()}
    assert rows["b"]["supersedes"] == "a" and rows["a"]["deleted_at"] is not None
    errs = {r["old_id"]: r["error"] for r in rep.collect()}
    assert errs["a"] is None and "not found" in errs["c"]


def test_forget_users_leaves_nothing(spark):
    mems = spark.createDataFrame([mem_row("a", "u", "s", "d", "x", [1.0]), mem_row("b", "v", "s", "d", "y", [1.0])], MEM)
    ses = spark.createDataFrame([("s1", "u"), ("s2", "v")], "session_id string, user_id string")
    users = spark.createDataFrame([("u", "DELETE ALL MY DATA"), ("v", "no")], "user_id string, confirmation string")
    tables, rep = lc.forget_users({"memories": mems, "sessions": ses}, users)
    assert tables["memories"].where("user_id = 'u'").count() == 0
    assert tables["sessions"].where("user_id = 'u'").count() == 0
    assert tables["memories"].count() == 1
    assert [(r["user_id"], r["memories_deleted"], r["sessions_deleted"]) for r in rep.collect()] == [("u", 1, 1)]


def test_backup_idempotent_and_parity(spark, tmp_path):
    mems = spark.createDataFrame([mem_row("a", "u", "s", "d", "x", [1.0]), mem_row("b", "v", "s", "d", "y", [1.0])], MEM)
    empty = mems.limit(0)
    b1, _ = io.incremental_backup(mems, empty)
    b2, rep = io.incremental_backup(mems, b1)
    assert sorted(b2.select("memory_id").collect()) == sorted(b1.select("memory_id").collect())
    assert {r["kind"]: r["n"] for r in rep.collect()} == {"added": 0, "refreshed": 0}
    io.mirror_write(mems.drop("embedding"), str(tmp_path / "a"), str(tmp_path / "b"))
    pa = spark.read.parquet(str(tmp_path / "a"))
    pb = spark.read.parquet(str(tmp_path / "b"))
    assert io.parity_check(pa, pb, "memory_id").count() == 0


def test_symmetrize_only_missing_reverse(spark):
    e = spark.createDataFrame([("r1", "a", "b", "u", "related_to", 0.5), ("r2", "b", "a", "u", "related_to", 0.4),
                               ("r3", "a", "c", "u", "contradicts", 0.3), ("r4", "a", "d", "u", "part_of", 0.3)],
                              "relationship_id string, source_id string, target_id string, user_id string, relationship string, strength double")
    e = e.select("*", F.lit(None).cast("string").alias("context"), F.lit(None).cast("timestamp_ntz").alias("created_at"),
                 F.lit(None).cast("string").alias("created_by"))
    out = {(r["source_id"], r["target_id"]) for r in lk.symmetrize(e).collect()}
    assert out == {("a", "b"), ("b", "a"), ("a", "c"), ("c", "a"), ("a", "d")}


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
