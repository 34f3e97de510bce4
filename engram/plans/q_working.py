"""Registered queries: working memory (2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import working as wk
from ..sources import testdata as td
from .oracle import AS_OF_SQL
from .registry import register


@register("init_sessions", f"""
SELECT r.session_id, CASE WHEN s.max_tokens IS NOT NULL THEN s.user_id ELSE r.user_id END AS user_id,
       CASE WHEN s.max_tokens IS NOT NULL THEN s.total_tokens ELSE 0 END AS total_tokens,
       CASE WHEN s.max_tokens IS NOT NULL THEN s.max_tokens ELSE 8000 END AS max_tokens,
       CASE WHEN s.max_tokens IS NOT NULL THEN s.created_at ELSE {AS_OF_SQL} END AS created_at,
       {AS_OF_SQL} AS last_activity, s.max_tokens IS NULL AS created
FROM requests r LEFT JOIN sessions s USING (session_id)
""")
def q_init_sessions(spark, sf):
    return wk.init_sessions(td.sessions(spark, sf), td.requests(spark, sf).select("session_id", "user_id"),
                            td.as_of())


@register("assign_sequence", """
_mx AS (SELECT session_id, max(sequence_num) AS mx FROM items GROUP BY 1)
SELECT i.item_id || '+' AS item_id, i.session_id,
       CAST(coalesce(m.mx, 0) + row_number() OVER (PARTITION BY i.session_id ORDER BY i.sequence_num, i.item_id) AS INTEGER)
         AS sequence_num
FROM items i LEFT JOIN _mx m USING (session_id)
""")
def q_assign_sequence(spark, sf):
    it = td.items(spark, sf)
    inc = it.select(F.concat("item_id", F.lit("+")).alias("item_id"), "session_id",
                    F.struct("sequence_num", "item_id").alias("arrival"))
    return wk.assign_sequence(it, inc, "arrival").select("item_id", "session_id", "sequence_num")


EVICT_SQL = """
_need AS (
  SELECT n.session_id, n.new_tokens - (s.max_tokens - s.total_tokens) AS needed
  FROM (SELECT session_id, max(token_count) AS new_tokens FROM items GROUP BY 1) n JOIN sessions s USING (session_id)
  WHERE s.total_tokens + n.new_tokens > s.max_tokens
),
_c AS (
  SELECT i.session_id, i.item_id, i.token_count, n.needed,
         coalesce(sum(i.token_count) OVER (PARTITION BY i.session_id ORDER BY {order}, i.item_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed_before,
         row_number() OVER (PARTITION BY i.session_id ORDER BY {order}, i.item_id) AS rn
  FROM items i JOIN _need n USING (session_id) WHERE NOT i.pinned
)
SELECT session_id, item_id, token_count, needed, freed_before,
       CAST(row_number() OVER (PARTITION BY session_id ORDER BY rn) AS INTEGER) AS evict_order
FROM _c WHERE freed_before < needed
"""


def _needs(it):
    return it.groupBy("session_id").agg(F.max("token_count").alias("new_tokens"))


@register("eviction_plan", EVICT_SQL.replace("{order}", "i.relevance_score, i.sequence_num"))
def q_eviction_plan(spark, sf):
    it = td.items(spark, sf)
    out = wk.eviction_plan(it, td.sessions(spark, sf), _needs(it))
    return out.withColumn("freed_before", F.col("freed_before").cast("long")) \
              .withColumn("needed", F.col("needed").cast("int"))


HYBRID = (f"(i.relevance_score * 100 + 10.0 / (1.0 + CAST(date_diff('second', i.last_accessed, {AS_OF_SQL}) AS DOUBLE) / 3600)"
          f" + CASE WHEN i.content_type = 'task_state' THEN 10.0 ELSE 0.0 END)")


@register("hybrid_eviction_priority", f"""
SELECT item_id, round({HYBRID}, 6) AS priority FROM items i
""")
def q_hybrid_priority(spark, sf):
    it = td.items(spark, sf)
    return it.select("item_id", F.round(wk.hybrid_eviction_priority(it, td.as_of()), 6).alias("priority"))


@register("eviction_plan_hybrid", EVICT_SQL.replace("{order}", HYBRID + ", i.sequence_num"))
def q_eviction_plan_hybrid(spark, sf):
    it = td.items(spark, sf)
    out = wk.eviction_plan(it, td.sessions(spark, sf), _needs(it), policy="hybrid", as_of=td.as_of())
    return out.withColumn("freed_before", F.col("freed_before").cast("long")) \
              .withColumn("needed", F.col("needed").cast("int"))


@register("replay_sessions")
def q_replay(spark, sf):
    return wk.replay_sessions(td.items(spark, sf), td.sessions(spark, sf))


@register("read_working_memory", """
_l AS (
  SELECT session_id, list_sort(list({'k0': NOT pinned, 'k1': -relevance_score, 'k2': -sequence_num,
                                     'id': item_id, 'tok': CAST(token_count AS BIGINT)})) AS xs
  FROM items GROUP BY 1
),
_f AS (
  SELECT s.session_id, s.total_tokens,
         list_reduce(l.xs, lambda acc, x: CASE WHEN acc.used + x.tok <= s.max_tokens
                     THEN {'used': acc.used + x.tok, 'picked': list_append(acc.picked, x.id)} ELSE acc END,
                     {'used': CAST(0 AS BIGINT), 'picked': CAST([] AS VARCHAR[])}) AS r
  FROM sessions s JOIN _l l USING (session_id)
),
_x AS (
  SELECT session_id, r.used AS used_tokens, r.used < total_tokens AS truncated,
         unnest(r.picked) AS item_id, generate_subscripts(r.picked, 1) - 1 AS position
  FROM _f
)
SELECT session_id, item_id, CAST(position AS INTEGER) AS position, used_tokens, truncated FROM _x
""")
def q_read_working(spark, sf):
    out = wk.read_working_memory(td.items(spark, sf), td.sessions(spark, sf))
    return out.select("session_id", "item_id", "position", "used_tokens", "truncated")


CHANGES_SQL = """
_ch AS (
  SELECT item_id, session_id,
         CASE WHEN sequence_num % 3 = 0 THEN true END AS pinned,
         CASE WHEN sequence_num % 3 = 1 THEN 0.9 END AS relevance_score
  FROM items
)
"""


def _changes(it):
    return it.select("item_id", "session_id",
                     F.when(F.col("sequence_num") % 3 == 0, F.lit(True)).alias("pinned"),
                     F.when(F.col("sequence_num") % 3 == 1, F.lit(0.9)).alias("relevance_score"))


@register("update_item_flags", CHANGES_SQL + f"""
SELECT i.item_id, coalesce(c.pinned, i.pinned) AS pinned, coalesce(c.relevance_score, i.relevance_score) AS relevance_score,
       CASE WHEN c.pinned IS NOT NULL OR c.relevance_score IS NOT NULL THEN {AS_OF_SQL} ELSE i.last_accessed END AS last_accessed
FROM items i LEFT JOIN _ch c USING (item_id, session_id)
""")
def q_update_flags(spark, sf):
    it = td.items(spark, sf)
    out, _ = wk.update_item_flags(it, _changes(it), td.as_of())
    return out.select("item_id", "pinned", "relevance_score", "last_accessed")


@register("update_item_flags_errors", CHANGES_SQL + """
SELECT item_id, session_id, 'No updates provided' AS error FROM _ch WHERE pinned IS NULL AND relevance_score IS NULL
""")
def q_update_flag_errors(spark, sf):
    it = td.items(spark, sf)
    _, bad = wk.update_item_flags(it, _changes(it), td.as_of())
    return bad


@register("clear_sessions", """
_r AS (SELECT session_id, total_tokens % 2 = 0 AS keep_pinned FROM sessions),
_m AS (
  SELECT i.session_id, i.token_count, (NOT r.keep_pinned OR NOT i.pinned) AS gone
  FROM items i JOIN _r r USING (session_id)
)
SELECT r.session_id, coalesce(count(*) FILTER (WHERE gone), 0) AS items_cleared,
       CAST(coalesce(sum(token_count) FILTER (WHERE NOT gone), 0) AS INTEGER) AS remaining_tokens
FROM _r r LEFT JOIN _m USING (session_id) GROUP BY r.session_id
""")
def q_clear_sessions(spark, sf):
    s = td.sessions(spark, sf)
    reqs = s.select("session_id", (F.col("total_tokens") % 2 == 0).alias("preserve_pinned"))
    _, _, rep = wk.clear_sessions(td.items(spark, sf), s, reqs)
    return rep


@register("session_totals", """
SELECT session_id, CAST(coalesce(sum(token_count), 0) AS BIGINT) AS total_tokens, count(*) AS item_count,
       count(*) FILTER (WHERE pinned) AS pinned_count
FROM items GROUP BY ROLLUP (session_id)
""")
def q_session_totals(spark, sf):
    return wk.session_totals(td.items(spark, sf))


@register("sessions_due", """
SELECT session_id, CAST(sum(token_count) AS BIGINT) AS total_tokens FROM items GROUP BY 1 HAVING sum(token_count) >= 900
""")
def q_sessions_due(spark, sf):
    from ..operators.lifecycle import sessions_due
    return sessions_due(td.items(spark, sf), threshold=900)


# ---------------------------------------------------------------- replay oracle
_EVICT = """list_reduce(
      list_sort(list_transform(list_filter(st.live, lambda v: NOT v.pinned),
                               lambda v: {'rel': v.rel, 'seq': v.seq, 'id': v.id, 'tok': v.tok})),
      lambda a, v: CASE WHEN a.freed >= x.tok - (max_tokens - st.total) THEN a
                        ELSE {'freed': a.freed + v.tok, 'ids': list_append(a.ids, v.id)} END,
      {'freed': CAST(0 AS BIGINT), 'ids': CAST([] AS VARCHAR[])})"""

REPLAY_SQL = f"""
_seqs AS (
  SELECT i.session_id, s.max_tokens,
         list({{'id': i.item_id, 'seq': i.sequence_num, 'rel': i.relevance_score, 'pinned': i.pinned,
                'tok': CAST(i.token_count AS BIGINT)}} ORDER BY i.sequence_num, i.item_id) AS xs
  FROM items i JOIN sessions s USING (session_id) GROUP BY i.session_id, s.max_tokens
),
_fold AS (
  SELECT session_id, list_reduce(xs, lambda st, x:
      CASE WHEN st.total + x.tok > max_tokens THEN
        {{'live': list_append(list_filter(st.live, lambda v: NOT list_contains(({_EVICT}).ids, v.id)), x),
         'total': st.total - ({_EVICT}).freed + x.tok,
         'evicted': list_concat(st.evicted, list_transform(({_EVICT}).ids,
                      lambda i: {{'id': i, 'evby': x.id, 'tot': st.total - ({_EVICT}).freed + x.tok}}))}}
      ELSE {{'live': list_append(st.live, x), 'total': st.total + x.tok, 'evicted': st.evicted}} END,
      {{'live': CAST([] AS STRUCT(id VARCHAR, seq INTEGER, rel DOUBLE, pinned BOOLEAN, tok BIGINT)[]),
        'total': CAST(0 AS BIGINT),
        'evicted': CAST([] AS STRUCT(id VARCHAR, evby VARCHAR, tot BIGINT)[])}}) AS st
  FROM _seqs
),
_kept AS (SELECT session_id, unnest(st.live) AS v, st.total AS total FROM _fold),
_ev AS (SELECT session_id, unnest(st.evicted) AS e FROM _fold),
replayed AS (
  SELECT session_id, v.id AS item_id, v.seq AS sequence_num, CAST(v.tok AS INTEGER) AS token_count,
         'kept' AS status, CAST(NULL AS VARCHAR) AS evicted_by, total AS total_after FROM _kept
  UNION ALL
  SELECT e.session_id, e.e.id, i.sequence_num, i.token_count, 'evicted', e.e.evby, e.e.tot
  FROM _ev e JOIN items i ON i.item_id = e.e.id
)
"""


def _attach():
    from .registry import attach_sql
    attach_sql("replay_sessions", REPLAY_SQL + "SELECT * FROM replayed")


_attach()
