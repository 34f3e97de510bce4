"""Working memory: sessions, sequence numbers, eviction, budgeted reads.

Per-session work is a window (eviction plan: an exclusive running sum), a
packing under a budget (``plans.packing``: cut to the rows that can be taken, then
a native fold over their order and cost) or a replay in order.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import DEFAULT_MAX_TOKENS


def init_sessions(sessions: DataFrame, reqs: DataFrame, as_of: Column) -> DataFrame:
    """Requests (session_id, user_id) -> the requested sessions after the call:
    existing ones get last_activity = as_of (created = false); missing ones
    are created with 0 tokens and the default maximum (created = true).  A
    session that several requests ask for belongs to the smallest user_id of
    them.  A request without a session_id gets one of its own, named by a hash
    of its user and place, so that a task that runs again gives the same name."""
    named = reqs.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(F.min("user_id").alias("_req_user"))
    nameless = reqs.where(F.col("session_id").isNull()).groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    nameless = nameless.select(F.col("user_id").alias("_req_user"), F.explode(F.sequence(
        F.lit(1).cast("long"), F.col("_n"))).alias("_k"))
    fresh = F.sha2(F.concat_ws(":", F.lit("session"), "_req_user", F.col("_k").cast("string"), as_of.cast("string")), 256)
    r = named.unionByName(nameless.select(F.left(fresh, F.lit(32)).alias("session_id"), "_req_user"))
    j = r.join(sessions, "session_id", "left")
    exists = F.col("max_tokens").isNotNull()
    return j.select(
        "session_id",
        F.when(exists, F.col("user_id")).otherwise(F.col("_req_user")).alias("user_id"),
        F.when(exists, F.col("total_tokens")).otherwise(F.lit(0)).alias("total_tokens"),
        F.when(exists, F.col("max_tokens")).otherwise(F.lit(DEFAULT_MAX_TOKENS)).alias("max_tokens"),
        F.when(exists, F.col("created_at")).otherwise(as_of).alias("created_at"),
        as_of.alias("last_activity"),
        (~exists).alias("created"))


def assign_sequence(items: DataFrame, incoming: DataFrame, order_col: str = "arrival") -> DataFrame:
    """sequence_num = max(existing in session, 0) + position of the new item
    within its session (by ``order_col``)."""
    mx = items.groupBy("session_id").agg(F.max("sequence_num").alias("_max"))
    w = Window.partitionBy("session_id").orderBy(order_col)
    return (incoming.join(mx, "session_id", "left")
            .withColumn("sequence_num", (F.coalesce("_max", F.lit(0)) + F.row_number().over(w)).cast("int"))
            .drop("_max"))


def hybrid_eviction_priority(items: DataFrame, as_of: Column) -> Column:
    """relevance * 100 + 10 / (1 + idle_hours) + 10 for task_state (lowest
    evicted first)."""
    idle_s = F.timestamp_diff("SECOND", F.col("last_accessed"), as_of).cast("double")
    return (F.col("relevance_score") * 100 + F.lit(10.0) / (F.lit(1.0) + idle_s / 3600)
            + F.when(F.col("content_type") == "task_state", F.lit(10.0)).otherwise(F.lit(0.0)))


def eviction_plan(items: DataFrame, sessions: DataFrame, needs: DataFrame, policy: str = "relevance",
                  as_of: Column | None = None) -> DataFrame:
    """Which items each session evicts to admit ``needs`` (session_id,
    new_tokens).  Only when total + new > max; needed = new - (max - total).
    Unpinned items in eviction order are taken while the tokens freed *before*
    them are still below ``needed`` (an exclusive running sum).

    policy: relevance (relevance asc, sequence asc), lru (last_accessed asc,
    sequence asc) or hybrid (``hybrid_eviction_priority`` asc)."""
    need = (needs.join(sessions.select("session_id", "total_tokens", "max_tokens"), "session_id")
            .withColumn("needed", F.col("new_tokens") - (F.col("max_tokens") - F.col("total_tokens")))
            .where(F.col("total_tokens") + F.col("new_tokens") > F.col("max_tokens"))
            .select("session_id", "needed"))
    cand = items.where(~F.col("pinned")).join(need, "session_id")
    if policy == "relevance":
        order = [F.col("relevance_score").asc(), F.col("sequence_num").asc()]
    elif policy == "lru":
        order = [F.col("last_accessed").asc(), F.col("sequence_num").asc()]
    elif policy == "hybrid":
        cand = cand.withColumn("_prio", hybrid_eviction_priority(cand, as_of))
        order = [F.col("_prio").asc(), F.col("sequence_num").asc()]
    else:
        raise ValueError(policy)
    w = Window.partitionBy("session_id").orderBy(*order, F.col("item_id").asc())
    before = F.coalesce(F.sum("token_count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (cand.withColumn("freed_before", before).where(F.col("freed_before") < F.col("needed"))
            .withColumn("evict_order", F.row_number().over(w))
            .select("session_id", "item_id", "token_count", "needed", "freed_before", "evict_order"))


def read_working_memory(items: DataFrame, sessions: DataFrame, budgets: DataFrame | None = None,
                        types: list[str] | None = None) -> DataFrame:
    """Per session: items in order pinned desc, relevance desc, sequence desc,
    packed greedily under the budget (budgets: session_id, token_budget;
    default the session's max_tokens).  Returns the picked items with
    ``position``, ``used_tokens`` and ``truncated`` (= used < session total).

    Rows that no packing can take are cut before anything is folded
    (``plans.packing``), so a session of any size is never gathered."""
    from ..plans.packing import greedy_pack
    it = items if not types else items.where(F.col("content_type").isin(types))
    s = sessions.select("session_id", "total_tokens", "max_tokens")
    if budgets is not None:
        s = s.join(budgets, "session_id", "left")
        budget = F.coalesce(F.col("token_budget"), F.col("max_tokens"))
    else:
        budget = F.col("max_tokens")
    order = [(~F.col("pinned")), (-F.col("relevance_score")), (-F.col("sequence_num")), F.col("item_id")]
    s = s.withColumn("_budget", F.coalesce(budget.cast("long"), F.lit(0)))
    picked = greedy_pack(it, s, "session_id", order, "token_count", "_budget",
                         keep=[c for c in it.columns if c != "session_id"])
    return (picked.join(s.select("session_id", "_budget", "total_tokens"), ["session_id", "_budget"])
            .withColumn("used_tokens", F.col("used"))
            .withColumn("truncated", F.col("used") < F.col("total_tokens"))
            .drop("used", "total_tokens", "_budget"))


def update_item_flags(items: DataFrame, changes: DataFrame, as_of: Column, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """changes (item_id, session_id, pinned?, relevance_score?) -> (items
    after the update, error rows for changes with neither field).  Of several
    changes to an item each field takes the greatest value asked for (there is
    no order among them unless ``order`` names one: then the last not null)."""
    bad = changes.where(F.col("pinned").isNull() & F.col("relevance_score").isNull()) \
                 .select("item_id", "session_id", F.lit("No updates provided").alias("error"))

    def last(c: str) -> Column:
        return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))) if order else F.max(c)

    ok = changes.where(F.col("pinned").isNotNull() | F.col("relevance_score").isNotNull()) \
                .groupBy("item_id", "session_id").agg(last("pinned").alias("_p"), last("relevance_score").alias("_r"),
                                                      F.lit(True).alias("_hit"))
    j = items.join(ok, ["item_id", "session_id"], "left")
    out = (j.withColumn("pinned", F.coalesce("_p", "pinned"))
           .withColumn("relevance_score", F.coalesce("_r", "relevance_score"))
           .withColumn("last_accessed", F.when(F.col("_hit"), as_of).otherwise(F.col("last_accessed")))
           .drop("_p", "_r", "_hit"))
    return out.select(*items.columns), bad


def clear_sessions(items: DataFrame, sessions: DataFrame, reqs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """reqs (session_id, preserve_pinned) -> (items left, sessions with new
    totals, per-session report: items_cleared, remaining_tokens).  A session
    asked for more than once keeps its pinned items only if every request does."""
    r = reqs.groupBy("session_id").agg(F.min("preserve_pinned").alias("_keep_pinned"))
    j = items.join(r, "session_id", "left")
    gone = F.col("_keep_pinned").isNotNull() & (~F.col("_keep_pinned") | ~F.col("pinned"))
    marked = j.withColumn("_gone", gone)
    kept = marked.where(~F.col("_gone")).select(*items.columns)
    rep = (marked.where(F.col("_keep_pinned").isNotNull()).groupBy("session_id")
           .agg(F.count_if("_gone").alias("items_cleared"),
                F.coalesce(F.sum(F.when(~F.col("_gone"), F.col("token_count"))), F.lit(0)).cast("int")
                .alias("remaining_tokens")))
    rep = r.select("session_id").join(rep, "session_id", "left").select(
        "session_id", F.coalesce("items_cleared", F.lit(0)).alias("items_cleared"),
        F.coalesce("remaining_tokens", F.lit(0)).alias("remaining_tokens"))
    new_s = (sessions.join(rep, "session_id", "left")
             .withColumn("total_tokens", F.coalesce("remaining_tokens", "total_tokens"))
             .select(*sessions.columns))
    return kept, new_s, rep


def session_totals(items: DataFrame) -> DataFrame:
    """Tokens, items and pinned items per session, plus a grand-total row
    (session_id NULL) from one rollup."""
    return items.rollup("session_id").agg(
        F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("total_tokens"),
        F.count(F.lit(1)).alias("item_count"),
        F.count_if("pinned").alias("pinned_count"))


REPLAY_OUT = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("item_id", T.StringType()),
    T.StructField("sequence_num", T.IntegerType()),
    T.StructField("token_count", T.IntegerType()),
    T.StructField("status", T.StringType()),       # kept | evicted
    T.StructField("evicted_by", T.StringType()),   # item whose add evicted it
    T.StructField("total_after", T.LongType()),    # session total after the add that settled the row
])


def _heap(live: dict) -> list:
    heap = [(v[2], v[1], v[0]) for v in live.values() if not v[3]]
    heapq.heapify(heap)
    return heap


def _next_out(live: dict, heap: list):
    """The live unpinned item that goes first, taken off the heap; entries of items
    that left or changed are passed over."""
    while heap:
        entry = heapq.heappop(heap)
        v = live.get(entry[2])
        if v is not None and not v[3] and (v[2], v[1], v[0]) == entry:
            return v
    return None


def fold_adds(live: dict, total: int, max_tokens: int, rows, heap: list | None = None) -> tuple[dict, int, list]:
    """Apply adds (iterable of objects with item_id, sequence_num,
    relevance_score, pinned, token_count) in the given order.  Each add first
    evicts unpinned items (relevance asc, sequence asc) until the shortfall
    is covered, then is added even if the total still exceeds the maximum.
    ``live`` maps item_id -> (item_id, seq, relevance, pinned, tokens).
    Returns (live, total, events) with events
    (item_id, status, evicted_by, sequence_num, token_count).

    ``heap`` orders the unpinned items by (relevance, sequence, item) and may hold
    entries that are out of date; a caller that folds one session in several calls
    hands the same list to each, so that an add costs log n.  None builds it."""
    events = []
    if heap is None:
        heap = _heap(live)
    for r in rows:
        tok = 0 if r.token_count is None or r.token_count != r.token_count else int(r.token_count)
        if total + tok > max_tokens:
            needed = tok - (max_tokens - total)
            freed = 0
            while freed < needed and (v := _next_out(live, heap)) is not None:
                del live[v[0]]
                events.append((v[0], "evicted", r.item_id, v[1], v[4]))
                freed += v[4]
                total -= v[4]
        v = live[r.item_id] = (r.item_id, int(r.sequence_num), float(r.relevance_score), bool(r.pinned), tok)
        if not v[3]:
            heapq.heappush(heap, (v[2], v[1], v[0]))
        if len(heap) > 2 * len(live) + 64:
            heap[:] = _heap(live)
        events.append((r.item_id, "kept", None, int(r.sequence_num), tok))
        total += tok
    return live, total, events


def _replay_partitions(batches):
    """Fold sessions that arrive sorted by (session, sequence, item) through
    Arrow batches.  Only the current session's live items are held; an
    evicted item is emitted when it is evicted, live ones when the session
    ends, so memory is bounded by live state, not by history or partition."""
    cur, mx, live, total, heap = None, 0, {}, 0, []
    out = {k: [] for k in REPLAY_OUT.fieldNames()}

    def emit(sid, item, seq, tok, status, by, tot):
        for k, v in zip(REPLAY_OUT.fieldNames(), (sid, item, seq, tok, status, by, tot)):
            out[k].append(v)

    def flush_session():
        for v in live.values():
            emit(cur, v[0], v[1], v[4], "kept", None, total)

    for pdf in batches:
        for r in pdf.itertuples(index=False):
            if r.session_id != cur:
                if cur is not None:
                    flush_session()
                cur, mx, live, total, heap = r.session_id, int(r.max_tokens), {}, 0, []
            live, total, events = fold_adds(live, total, mx, [r], heap)
            for item, status, by, seq, tok in events:
                if status == "evicted":
                    emit(cur, item, seq, tok, "evicted", by, total)
        if out["item_id"]:
            yield pd.DataFrame(out)
            out = {k: [] for k in REPLAY_OUT.fieldNames()}
    if cur is not None:
        flush_session()
    if out["item_id"]:
        yield pd.DataFrame(out)


def replay_sessions(adds: DataFrame, sessions: DataFrame, partitions: int | None = None) -> DataFrame:
    """Replay every session's full add history (items with sequence numbers)
    with eviction.  Order-dependent, so it is a fold, not a window: rows are
    hash-partitioned by session and sorted by (session, sequence) inside each
    partition (spillable sort), then folded batch by batch in
    ``mapInPandas``.  Sessions are independent, so they spread over tasks;
    one session's history is necessarily folded in order by one task."""
    mx = sessions.select("session_id", "max_tokens")
    data = adds.select("session_id", "item_id", "sequence_num", "token_count", "relevance_score", "pinned") \
               .join(mx, "session_id")
    n = partitions or int(adds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    data = data.repartition(n, "session_id").sortWithinPartitions("session_id", "sequence_num", "item_id")
    return data.mapInPandas(_replay_partitions, REPLAY_OUT)
