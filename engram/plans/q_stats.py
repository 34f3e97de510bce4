"""Registered queries: usage analytics (2.11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as st
from ..sources import testdata as td
from .oracle import AS_OF_SQL, METRICS_AS_OF_SQL
from .registry import register


def _m_as_of():
    return td.ts(td.METRICS_AS_OF)


@register("memory_counts", """
SELECT 'live_memories' AS metric, count(*) FILTER (WHERE deleted_at IS NULL) AS value FROM memories
UNION ALL SELECT 'all_memories', count(*) FROM memories
UNION ALL SELECT 'sessions', count(*) FROM sessions
UNION ALL SELECT 'working_items', count(*) FROM items
UNION ALL SELECT 'working_tokens', CAST(coalesce(sum(token_count), 0) AS BIGINT) FROM items
UNION ALL SELECT 'access_log_entries', count(*) FROM access_log
""")
def q_memory_counts(spark, sf):
    return st.memory_counts(td.memories(spark, sf), td.sessions(spark, sf), td.items(spark, sf),
                            td.access_log(spark, sf))


@register("memory_counts_by_user", """
SELECT user_id, count(*) FILTER (WHERE deleted_at IS NULL) AS live_memories, count(*) AS all_memories
FROM memories GROUP BY user_id
""")
def q_memory_counts_by_user(spark, sf):
    return st.memory_counts_by_user(td.memories(spark, sf))


@register("by_category", """
_c AS (SELECT memory_category, count(*) AS n FROM live GROUP BY 1),
_d AS (SELECT * FROM (VALUES ('episodic'), ('semantic'), ('procedural'), ('preference')) t(memory_category))
SELECT d.memory_category, coalesce(c.n, 0) AS n FROM _d d LEFT JOIN _c c USING (memory_category)
UNION ALL
SELECT memory_category, n FROM _c WHERE memory_category NOT IN (SELECT memory_category FROM _d)
""")
def q_by_category(spark, sf):
    return st.by_category(td.memories(spark, sf))


@register("by_subtype", """
SELECT memory_category, memory_subtype, count(*) AS n FROM live GROUP BY 1, 2
""")
def q_by_subtype(spark, sf):
    return st.by_subtype(td.memories(spark, sf))


@register("by_importance", """
SELECT CASE WHEN importance >= 0.8 THEN 'critical' WHEN importance >= 0.6 THEN 'high'
            WHEN importance >= 0.4 THEN 'medium' ELSE 'low' END AS priority, count(*) AS n
FROM live GROUP BY 1
""")
def q_by_importance(spark, sf):
    return st.by_importance(td.memories(spark, sf))


@register("with_entities", """
SELECT user_id, count(*) FILTER (WHERE entities IS NOT NULL) AS memories_with_entities FROM live GROUP BY 1
""")
def q_with_entities(spark, sf):
    return st.with_entities(td.memories(spark, sf))


@register("entity_frequency", """
SELECT entity, count(*) AS n FROM (SELECT unnest(list_distinct(entities)) AS entity FROM live) GROUP BY 1
""")
def q_entity_frequency(spark, sf):
    return st.entity_frequency(td.memories(spark, sf))


@register("recent_created", f"""
SELECT memory_id, user_id, created_at FROM live WHERE created_at >= TIMESTAMP '{td.BASE_TS}' - INTERVAL 7 DAY
""")
def q_recent_created(spark, sf):
    # 7 days before the newest creation date of the fixture
    return st.recent_created(td.memories(spark, sf), td.ts(td.BASE_TS), 7).select(
        "memory_id", "user_id", "created_at")


@register("recent_created_45d", f"""
SELECT memory_id, user_id, created_at FROM live WHERE created_at >= {AS_OF_SQL} - INTERVAL 45 DAY
""")
def q_recent_created_45(spark, sf):
    return st.recent_created(td.memories(spark, sf), td.as_of(), 45).select("memory_id", "user_id", "created_at")


@register("top_accessed", """
SELECT left(memory_id, 8) || '...' AS memory_id_short, memory_id, memory_category, access_count, importance,
       CASE WHEN length(content) > 100 THEN left(content, 100) || '...' ELSE content END AS content_preview
FROM live ORDER BY access_count DESC, importance DESC, memory_id LIMIT 5
""")
def q_top_accessed(spark, sf):
    return st.top_accessed(td.memories(spark, sf), 5)


@register("recent_errors", """
SELECT CASE WHEN error_id IS NOT NULL THEN left(error_id, 8) || '...' END AS error_id,
       tool_name, user_id, error_type,
       CASE WHEN length(error_message) > 200 THEN left(error_message, 200) || '...' ELSE error_message END AS error_message,
       CASE WHEN length(input_preview) > 100 THEN left(input_preview, 100) || '...' ELSE input_preview END AS input_preview,
       created_at
FROM errors ORDER BY created_at DESC, error_id LIMIT 20
""")
def q_recent_errors(spark, sf):
    return st.recent_errors(td.errors(spark, sf), 20)


@register("recent_errors_tool", """
SELECT CASE WHEN error_id IS NOT NULL THEN left(error_id, 8) || '...' END AS error_id,
       tool_name, user_id, error_type,
       CASE WHEN length(error_message) > 200 THEN left(error_message, 200) || '...' ELSE error_message END AS error_message,
       CASE WHEN length(input_preview) > 100 THEN left(input_preview, 100) || '...' ELSE input_preview END AS input_preview,
       created_at
FROM errors WHERE tool_name = 'store_memory' ORDER BY created_at DESC, error_id LIMIT 20
""")
def q_recent_errors_tool(spark, sf):
    return st.recent_errors(td.errors(spark, sf), 20, tool="store_memory")


@register("errors_by_tool", "SELECT tool_name, count(*) AS n FROM errors GROUP BY 1")
def q_errors_by_tool(spark, sf):
    return st.errors_by_tool(td.errors(spark, sf))


def _service_window_sql(minutes: int) -> str:
    return f"""
_m AS (SELECT *, recorded_at > {METRICS_AS_OF_SQL} - INTERVAL {minutes} MINUTE AS _in FROM metrics),
_a AS (
  SELECT service,
         count(*) FILTER (WHERE _in) AS calls_in_window,
         count(*) FILTER (WHERE _in AND NOT success) AS errors_in_window,
         CAST(round(avg(CAST(latency_ms AS DECIMAL(20,6))) FILTER (WHERE _in), 2) AS DOUBLE) AS avg_latency_ms,
         CAST(coalesce(sum(tokens_in) FILTER (WHERE _in), 0) AS BIGINT) AS tokens_in_window,
         CAST(coalesce(sum(tokens_out) FILTER (WHERE _in), 0) AS BIGINT) AS tokens_out_window,
         count(*) AS total_calls,
         count(*) FILTER (WHERE NOT success) AS total_errors,
         list_sort(list(latency_ms) FILTER (WHERE _in)) AS _lat
  FROM _m GROUP BY service
)
SELECT service, calls_in_window, errors_in_window, avg_latency_ms, tokens_in_window, tokens_out_window,
       total_calls, total_errors,
       round(CASE WHEN calls_in_window = 0 THEN NULL
                  WHEN calls_in_window >= 20 THEN _lat[CAST(floor(calls_in_window * CAST(0.95 AS DOUBLE)) AS BIGINT) + 1]
                  ELSE _lat[calls_in_window] END, 2) AS p95_latency_ms
FROM _a
"""


@register("service_window", _service_window_sql(1440))
def q_service_window(spark, sf):
    return st.service_window(td.metrics(spark, sf), _m_as_of(), 1440)


@register("service_window_60m", _service_window_sql(60))
def q_service_window_60(spark, sf):
    return st.service_window(td.metrics(spark, sf), _m_as_of(), 60)


@register("service_by_operation", f"""
SELECT service, operation, count(*) AS count, count(*) FILTER (WHERE NOT success) AS errors,
       round(avg(latency_ms), 6) AS avg_latency_ms
FROM metrics WHERE recorded_at > {METRICS_AS_OF_SQL} - INTERVAL 1440 MINUTE GROUP BY 1, 2
""")
def q_service_by_operation(spark, sf):
    out = st.service_by_operation(td.metrics(spark, sf), _m_as_of(), 1440)
    return out.withColumn("avg_latency_ms", F.round("avg_latency_ms", 6))


RECENT_CALLS_SQL = """
_rc AS (
  SELECT service, CAST(row_number() OVER (PARTITION BY service ORDER BY recorded_at DESC, metric_id) AS INTEGER) AS rank,
         recorded_at, operation, round(latency_ms, 2) AS latency_ms, coalesce(tokens_in, 0) AS tokens_in,
         coalesce(tokens_out, 0) AS tokens_out, success, error_msg AS error, metric_id
  FROM metrics
)
"""


@register("recent_calls", RECENT_CALLS_SQL + "SELECT * FROM _rc WHERE rank <= 50")
def q_recent_calls(spark, sf):
    return st.recent_calls(td.metrics(spark, sf), 50)


@register("recent_calls_feed", RECENT_CALLS_SQL + """
SELECT service, recorded_at, operation, latency_ms, tokens_in, tokens_out, success, error, metric_id
FROM _rc WHERE rank <= 50 ORDER BY recorded_at DESC, metric_id LIMIT 50
""")
def q_recent_calls_feed(spark, sf):
    return st.recent_calls_feed(td.metrics(spark, sf), 50)
