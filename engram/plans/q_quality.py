"""Registered queries: quality audit and maintenance (2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as qa
from ..sources import testdata as td
from .oracle import AS_OF_SQL, cosine
from .registry import register

T_CONTRA = 0.3  # the fixture's largest cosine is ~0.5, so defaults (.7/.75) find nothing

WORDS = "list_distinct(list_filter(string_split_regex(lower({c}), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> ''))"


def _words(c: str) -> str:
    return WORDS.format(c=c)


def _overlap(a: str, b: str, either: bool) -> str:
    wa, wb = _words(a), _words(b)
    empty = (f"(len({wa}) = 0 OR len({wb}) = 0)" if either
             else f"(len(list_distinct(list_concat({wa}, {wb}))) = 0)")
    return (f"(CASE WHEN {empty} THEN 0.0 ELSE len(list_intersect({wa}, {wb})) / "
            f"len(list_distinct(list_concat({wa}, {wb}))) END)")


def _preview(c: str, n: int) -> str:
    return f"(CASE WHEN length({c}) > {n} THEN left({c}, {n}) || '...' ELSE {c} END)"


STATS_SQL = """
_qs AS (
  SELECT user_id, count(*) AS total_memories, CAST(round(avg(CAST(importance AS DECIMAL(20,6))), 2) AS DOUBLE) AS avg_importance,
         CAST(round(avg(CAST(access_count AS DECIMAL(20,6))), 1) AS DOUBLE) AS avg_access_count,
         count(*) FILTER (WHERE access_count = 0) AS never_accessed,
         count(*) FILTER (WHERE importance < 0.3) AS low_importance
  FROM live GROUP BY user_id
)
"""


@register("quality_stats", STATS_SQL + "SELECT * FROM _qs")
def q_quality_stats(spark, sf):
    return qa.quality_stats(td.memories(spark, sf))


@register("quality_by_category", """
SELECT user_id, memory_category, count(*) AS count, CAST(round(avg(CAST(importance AS DECIMAL(20,6))), 2) AS DOUBLE) AS avg_importance,
       CAST(round(avg(CAST(access_count AS DECIMAL(20,6))), 1) AS DOUBLE) AS avg_access
FROM live GROUP BY 1, 2
""")
def q_quality_by_category(spark, sf):
    return qa.quality_by_category(td.memories(spark, sf))


@register("stale_memories", f"""
_s AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY importance, access_count, memory_id) AS INTEGER) AS rank
  FROM live WHERE (last_accessed IS NULL OR last_accessed < {AS_OF_SQL} - INTERVAL 30 DAY) AND access_count < 2
)
SELECT user_id, rank, memory_id, {_preview('content', 100)} AS content_preview, memory_category, importance,
       access_count, created_at, last_accessed
FROM _s WHERE rank <= 20
""")
def q_stale(spark, sf):
    return qa.stale_memories(td.memories(spark, sf), td.as_of(), 30, 20)


@register("word_overlap", f"""
SELECT e.relationship_id, round({_overlap('a.content', 'b.content', False)}, 6) AS overlap
FROM edges e JOIN memories a ON a.memory_id = e.source_id JOIN memories b ON b.memory_id = e.target_id
""")
def q_word_overlap(spark, sf):
    e = td.edges(spark, sf)
    m = td.memories(spark, sf)
    a = m.select(F.col("memory_id").alias("source_id"), F.col("content").alias("ca"))
    b = m.select(F.col("memory_id").alias("target_id"), F.col("content").alias("cb"))
    j = e.join(a, "source_id").join(b, "target_id")
    return j.select("relationship_id", F.round(qa.word_overlap("ca", "cb"), 6).alias("overlap"))


def _nb_sql(scan_cte: str, k: int) -> str:
    return f"""
_nb AS (
  SELECT q.user_id, q.memory_id AS _qid, q._scan, q.created_at AS _qt, q.content AS _qc,
         q.access_count AS _qa, m.memory_id, m.created_at AS _nt, m.content AS _nc, m.access_count AS _na,
         {cosine('q.embedding', 'm.embedding')} AS similarity
  FROM {scan_cte} q JOIN live m ON m.user_id = q.user_id AND m.memory_category = q.memory_category
                              AND m.memory_id <> q.memory_id
),
_nbr AS (
  SELECT *, row_number() OVER (PARTITION BY _qid ORDER BY similarity DESC NULLS LAST, memory_id) AS n_rank FROM _nb
),
_nbk AS (SELECT * FROM _nbr WHERE n_rank <= {k})
"""


@register("contradictions_recent", f"""
_u AS (SELECT user_id FROM live GROUP BY 1 HAVING count(*) >= 2),
_sc AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, memory_id) AS _scan
  FROM live WHERE user_id IN (SELECT user_id FROM _u)
),
_new AS (SELECT * FROM _sc WHERE _scan <= 10),
{_nb_sql('_new', 3).strip()},
_p AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, least(_qid, memory_id), greatest(_qid, memory_id)
                               ORDER BY _scan, n_rank) AS _first
  FROM _nbk WHERE similarity >= {T_CONTRA}
),
_o AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY _scan, n_rank) AS rank
  FROM _p WHERE _first = 1 AND {_overlap('_qc', '_nc', False)} < 0.5
)
SELECT user_id, CAST(rank AS INTEGER) AS rank,
       CASE WHEN _qt > _nt THEN _qid ELSE memory_id END AS newer_id,
       CASE WHEN _qt > _nt THEN memory_id ELSE _qid END AS older_id,
       {_preview('CASE WHEN _qt > _nt THEN _qc ELSE _nc END', 150)} AS newer_preview,
       {_preview('CASE WHEN _qt > _nt THEN _nc ELSE _qc END', 150)} AS older_preview,
       round(similarity, 4) AS similarity,
       'Review if ' || (CASE WHEN _qt > _nt THEN _qid ELSE memory_id END) || ' supersedes '
         || (CASE WHEN _qt > _nt THEN memory_id ELSE _qid END) AS recommendation
FROM _o WHERE rank <= 5
""")
def q_contradictions_recent(spark, sf):
    return qa.contradictions_recent(td.memories(spark, sf), t=T_CONTRA, limit=5)


def _full_sql(k: int) -> str:
    return f"""
_sc AS (SELECT *, 0 AS _scan FROM live),
{_nb_sql('_sc', k).strip()},
_f AS (
  SELECT *, {_overlap('_qc', '_nc', True)} AS content_overlap FROM _nbk WHERE similarity >= {T_CONTRA}
),
_g AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, least(_qid, memory_id), greatest(_qid, memory_id)
                               ORDER BY _qt DESC, _qid, n_rank) AS _first
  FROM _f WHERE content_overlap < 0.5
),
contradictions AS (
  SELECT user_id, _qid AS memory_1, memory_id AS memory_2, round(similarity, 4) AS similarity,
         round(content_overlap, 4) AS content_overlap,
         CASE _case WHEN 1 THEN 'merge' WHEN 2 THEN 'supersede' WHEN 3 THEN 'supersede' ELSE 'review' END AS action,
         CASE _case WHEN 2 THEN memory_id WHEN 3 THEN _qid WHEN 4 THEN _qid END AS keep_id,
         CASE _case WHEN 2 THEN _qid WHEN 3 THEN memory_id WHEN 4 THEN memory_id END AS other_id,
         CASE _case WHEN 1 THEN 'same_content' WHEN 2 THEN 'never_read' WHEN 3 THEN 'never_read'
                    WHEN 4 THEN 'newer' ELSE 'undecided' END AS reason
  FROM (SELECT *, CASE WHEN similarity > 0.9 THEN 1 WHEN _qa = 0 AND _na > 2 THEN 2 WHEN _na = 0 AND _qa > 2 THEN 3
                       WHEN _qt > _nt THEN 4 ELSE 5 END AS _case FROM _g WHERE _first = 1)
)
"""


@register("contradictions_full", _full_sql(5) + "SELECT * FROM contradictions")
def q_contradictions_full(spark, sf):
    return qa.contradictions_full(td.memories(spark, sf), t=T_CONTRA, k=5)


HEALTH_SQL = """
_users AS (SELECT DISTINCT user_id FROM memories),
_c AS (SELECT user_id, count(*) AS contradictions FROM contradictions GROUP BY 1),
_h AS (
  SELECT u.user_id, s.total_memories, s.avg_importance, s.avg_access_count, s.never_accessed, s.low_importance,
         coalesce(c.contradictions, 0) AS contradictions,
         coalesce(s.total_memories, 1) AS _t, coalesce(s.avg_importance, 0.0) AS _ai
  FROM _users u LEFT JOIN _qs s USING (user_id) LEFT JOIN _c c USING (user_id)
),
_hs AS (
  SELECT *, CAST(greatest(0, least(100, 100
     - CASE WHEN _ai < 0.5 THEN 20 WHEN _ai < 0.7 THEN 10 ELSE 0 END
     - CASE WHEN coalesce(never_accessed, 0) / _t > 0.3 THEN 20 WHEN coalesce(never_accessed, 0) / _t > 0.1 THEN 10 ELSE 0 END
     - CASE WHEN coalesce(low_importance, 0) / _t > 0.2 THEN 15 ELSE 0 END
     - CASE WHEN contradictions > 10 THEN 15 WHEN contradictions > 5 THEN 5 ELSE 0 END)) AS INTEGER) AS health_score
  FROM _h
)
"""


@register("health_score", STATS_SQL + "," + _full_sql(5) + "," + HEALTH_SQL + """
SELECT user_id, total_memories, avg_importance, avg_access_count, never_accessed, low_importance,
       contradictions, health_score,
       CASE WHEN health_score >= 90 THEN 'Excellent' WHEN health_score >= 70 THEN 'Good'
            WHEN health_score >= 50 THEN 'Fair' ELSE 'Needs Attention' END AS health_status
FROM _hs
""")
def q_health(spark, sf):
    m = td.memories(spark, sf)
    return qa.health_score(qa.quality_stats(m), qa.contradictions_full(m, t=T_CONTRA, k=5),
                           m.select("user_id"))


@register("quality_report", STATS_SQL + "," + _full_sql(3) + "," + HEALTH_SQL + f"""
, _st AS (
  SELECT user_id, count(*) AS stale FROM live
  WHERE (last_accessed IS NULL OR last_accessed < {AS_OF_SQL} - INTERVAL 30 DAY) AND access_count < 2 GROUP BY 1
)
SELECT h.user_id, total_memories, avg_importance, avg_access_count, never_accessed, low_importance,
       contradictions, health_score,
       CASE WHEN health_score >= 90 THEN 'Excellent' WHEN health_score >= 70 THEN 'Good'
            WHEN health_score >= 50 THEN 'Fair' ELSE 'Needs Attention' END AS health_status,
       coalesce(s.stale, 0) AS stale
FROM _hs h LEFT JOIN _st s USING (user_id)
""")
def q_quality_report(spark, sf):
    return qa.quality_report(td.memories(spark, sf), td.as_of(), t=T_CONTRA)


DECAY_SQL = f"""
_d AS (
  SELECT *, coalesce(deleted_at IS NULL AND (last_accessed IS NULL OR last_accessed < {AS_OF_SQL} - INTERVAL 40 DAY)
                     AND importance > 0.1, false) AS decayed
  FROM memories
)
"""


@register("decay", DECAY_SQL + """
SELECT memory_id, decayed, round(CASE WHEN decayed THEN importance * 0.95 ELSE importance END, 6) AS importance,
       round(CASE WHEN decayed THEN decay_factor * 0.95 ELSE decay_factor END, 6) AS decay_factor
FROM _d
""")
def q_decay(spark, sf):
    d = qa.decay(td.memories(spark, sf), td.as_of(), 0.95, 40)
    return d.select("memory_id", "decayed", F.round("importance", 6).alias("importance"),
                    F.round("decay_factor", 6).alias("decay_factor"))


@register("decay_counts", DECAY_SQL + """
SELECT user_id, count(*) FILTER (WHERE decayed) AS memories_decayed FROM _d GROUP BY 1
""")
def q_decay_counts(spark, sf):
    return qa.decay_counts(qa.decay(td.memories(spark, sf), td.as_of(), 0.95, 40))


@register("daily_maintenance")
def q_daily_maintenance(spark, sf):
    import uuid
    from ..session import shared_path
    m = td.memories(spark, sf)
    backup = m.where(F.col("created_at") < td.ts("2024-05-01 00:00:00"))
    return qa.daily_maintenance(m, backup, td.as_of(), shared_path(spark, f"maint-{uuid.uuid4().hex}"))


def _attach():
    from .registry import attach_sql
    vid = "CAST(substr(memory_id, 2) AS INTEGER)"
    attach_sql("daily_maintenance", f"""
_d AS (
  SELECT *, coalesce(deleted_at IS NULL AND (last_accessed IS NULL OR last_accessed < {AS_OF_SQL} - INTERVAL 7 DAY)
                     AND importance > 0.1, false) AS decayed
  FROM memories
)
SELECT 'backup_added' AS task, CAST(NULL AS VARCHAR) AS user_id, CAST(count(*) AS DOUBLE) AS value
FROM memories WHERE created_at >= TIMESTAMP '2024-05-01 00:00:00'
UNION ALL SELECT 'backup_refreshed', CAST(NULL AS VARCHAR), CAST(0 AS DOUBLE)
UNION ALL SELECT 'decayed', user_id, CAST(count(*) FILTER (WHERE decayed) AS DOUBLE) FROM _d GROUP BY user_id
UNION ALL SELECT 'avg_importance', user_id,
       CAST(round(avg(CAST(CASE WHEN decayed THEN importance * 0.98 ELSE importance END AS DECIMAL(20,6))), 2) AS DOUBLE)
FROM _d WHERE deleted_at IS NULL GROUP BY user_id
""")


_attach()


@register("recommend_action", _full_sql(5) + "SELECT memory_1, memory_2, action, keep_id, other_id, reason FROM contradictions")
def q_recommend_action(spark, sf):
    return qa.contradictions_full(td.memories(spark, sf), t=T_CONTRA, k=5).select(
        "memory_1", "memory_2", "action", "keep_id", "other_id", "reason")
