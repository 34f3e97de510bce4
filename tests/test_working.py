from pyspark.sql import functions as F

from engram.operators import working as wk
from engram.sources.testdata import ts

ITEMS = "item_id string, session_id string, user_id string, content_type string, content string, token_count int, relevance_score double, pinned boolean, sequence_num int, created_at timestamp_ntz, last_accessed timestamp_ntz"


def _items(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], ITEMS)


def test_eviction_exclusive_running_sum(spark):
    items = _items(spark, [
        ("a", "s", "u", "message", "x", 100, 0.1, False, 1),
        ("b", "s", "u", "message", "x", 50, 0.2, False, 2),
        ("c", "s", "u", "message", "x", 70, 0.3, False, 3),
        ("p", "s", "u", "system", "x", 500, 0.0, True, 4)])
    sessions = spark.createDataFrame([("s", 720, 800)], "session_id string, total_tokens int, max_tokens int")
    needs = spark.createDataFrame([("s", 200)], "session_id string, new_tokens int")
    out = [r["item_id"] for r in wk.eviction_plan(items, sessions, needs).orderBy("evict_order").collect()]
    # needed = 200 - (800 - 720) = 120: a frees 100 (< 120, continue), b frees 50 -> stop
    assert out == ["a", "b"]


def test_no_eviction_when_it_fits(spark):
    items = _items(spark, [("a", "s", "u", "message", "x", 10, 0.1, False, 1)])
    sessions = spark.createDataFrame([("s", 10, 800)], "session_id string, total_tokens int, max_tokens int")
    needs = spark.createDataFrame([("s", 100)], "session_id string, new_tokens int")
    assert wk.eviction_plan(items, sessions, needs).count() == 0


def test_greedy_skip_and_continue(spark):
    items = _items(spark, [
        ("big", "s", "u", "message", "x", 900, 0.9, False, 1),
        ("fit", "s", "u", "message", "x", 300, 0.5, False, 2),
        ("fit2", "s", "u", "message", "x", 200, 0.4, False, 3)])
    sessions = spark.createDataFrame([("s", 1400, 600)], "session_id string, total_tokens int, max_tokens int")
    out = wk.read_working_memory(items, sessions).orderBy("position").collect()
    assert [r["item_id"] for r in out] == ["fit", "fit2"]
    assert out[0]["used_tokens"] == 500 and out[0]["truncated"]


def test_pinned_first(spark):
    items = _items(spark, [("a", "s", "u", "message", "x", 10, 0.9, False, 1),
                           ("p", "s", "u", "system", "x", 10, 0.1, True, 2)])
    sessions = spark.createDataFrame([("s", 20, 600)], "session_id string, total_tokens int, max_tokens int")
    assert [r["item_id"] for r in wk.read_working_memory(items, sessions).orderBy("position").collect()] == ["p", "a"]


def test_replay_adds_even_if_unpinned_do_not_suffice(spark):
    items = _items(spark, [("p1", "s", "u", "system", "x", 80, 0.5, True, 1),
                           ("a", "s", "u", "message", "x", 10, 0.1, False, 2),
                           ("huge", "s", "u", "message", "x", 200, 0.5, False, 3)])
    sessions = spark.createDataFrame([("s", 0, 100)], "session_id string, total_tokens int, max_tokens int")
    out = {r["item_id"]: (r["status"], r["evicted_by"], r["total_after"]) for r in wk.replay_sessions(items, sessions).collect()}
    assert out["a"][0] == "evicted" and out["a"][1] == "huge"
    assert out["huge"][0] == "kept" and out["p1"][0] == "kept"
    assert out["huge"][2] == 280  # over the maximum, as the reference allows


def test_stream_equals_replay(spark, tmp_path):
    from engram.sources import testdata as td
    from engram.streaming import jobs as sj
    sf = "/root/testdata/sf0.001"
    batch = {(r["item_id"], r["status"]) for r in wk.replay_sessions(td.items(spark, sf), td.sessions(spark, sf)).collect()}
    adds = td.items_from(sj.file_stream(spark, sf, "conversations"))
    ev = sj.run_available(sj.stream_working_memory(adds, td.sessions(spark, sf)), "wmtest")
    stream = {(r["item_id"], r["status"]) for r in sj.final_item_status(ev).collect()}
    assert batch == stream


def test_clear_and_totals(spark):
    items = _items(spark, [("a", "s", "u", "message", "x", 10, 0.1, False, 1),
                           ("p", "s", "u", "system", "x", 5, 0.1, True, 2),
                           ("b", "t", "u", "message", "x", 7, 0.1, False, 1)])
    sessions = spark.createDataFrame([("s", "u", 15, 600), ("t", "u", 7, 600)],
                                     "session_id string, user_id string, total_tokens int, max_tokens int")
    reqs = spark.createDataFrame([("s", True), ("t", False)], "session_id string, preserve_pinned boolean")
    kept, new_s, rep = wk.clear_sessions(items, sessions, reqs)
    assert sorted(r["item_id"] for r in kept.collect()) == ["p"]
    rep = {r["session_id"]: (r["items_cleared"], r["remaining_tokens"]) for r in rep.collect()}
    assert rep == {"s": (1, 5), "t": (1, 0)}
    tot = {r["session_id"]: r["total_tokens"] for r in wk.session_totals(items).collect()}
    assert tot[None] == 22 and tot["s"] == 15


def test_legacy_state_api_equals_replay(spark):
    from engram.sources import testdata as td
    from engram.streaming import jobs as sj
    sf = "/root/testdata/sf0.001"
    batch = {(r["item_id"], r["status"]) for r in wk.replay_sessions(td.items(spark, sf), td.sessions(spark, sf)).collect()}
    adds = td.items_from(sj.file_stream(spark, sf, "conversations"))
    ev = sj.run_available(sj.stream_working_memory(adds, td.sessions(spark, sf), api="legacy"), "wmlegacy")
    assert {(r["item_id"], r["status"]) for r in sj.final_item_status(ev).collect()} == batch
