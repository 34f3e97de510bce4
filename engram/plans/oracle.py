"""DuckDB SQL twins of the registered queries (the correctness oracle).

``ADAPTERS`` restates the rules of ``sources.testdata`` as CTEs over the raw
test tables; every oracle query is ``WITH <adapters> <query>``.
"""

from __future__ import annotations

from ..schemas import INTENTS, INTENT_WEIGHTS, RELATIONSHIPS, TAXONOMY_PAIRS
from ..sources.testdata import (AS_OF, BASE_TS, ERROR_TYPES, LABEL_TYPES, METRICS_AS_OF, N_USERS,
                                SERVICES, SESSION_MAX_TOKENS, TOOLS)


def _case(expr: str, values: list) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} {whens} END"


def _id(prefix: str, expr: str, width: int = 6) -> str:
    return f"('{prefix}' || lpad(CAST({expr} AS VARCHAR), {width}, '0'))"


def _user(expr: str) -> str:
    return f"('u' || CAST({expr} AS VARCHAR))"


WEIGHT_ROWS = ", ".join(
    f"('{intent}', '{key}', CAST({w!r} AS DOUBLE))"
    for intent, prof in INTENT_WEIGHTS.items() for key, w in prof.items())
TAXONOMY_ROWS = ", ".join(f"('{c}', '{s}')" for c, s in TAXONOMY_PAIRS)

ADAPTERS = f"""
_ed AS (
  SELECT coalesce(e.vec_id, d.doc_id) AS vec_id, e.embedding,
         coalesce(e.label, d.doc_id % {len(LABEL_TYPES)}) AS label, d.text, d.lang, d.source,
         TIMESTAMP '{BASE_TS}' - to_days(CAST(coalesce(e.vec_id, d.doc_id) % 60 AS INTEGER)) AS created
  FROM embeddings e FULL JOIN documents d ON e.vec_id = d.doc_id
),
memories AS (
  SELECT {_id('m', 'vec_id')} AS memory_id,
         {_user(f'vec_id % {N_USERS}')} AS user_id,
         CAST(NULL AS VARCHAR) AS org_id,
         {_case('label', [c for c, _ in LABEL_TYPES])} AS memory_category,
         {_case('label', [s for _, s in LABEL_TYPES])} AS memory_subtype,
         text AS content,
         left(text, 80) AS summary,
         embedding,
         CASE WHEN vec_id % 13 = 0 THEN CAST(NULL AS VARCHAR[])
              WHEN vec_id % 13 = 1 THEN CAST([] AS VARCHAR[])
              ELSE ['lang:' || lang, 'source:' || source] END AS entities,
         '{{"tags":["' || lang || '"]}}' AS metadata,
         CASE WHEN vec_id % 5 = 0 THEN created END AS event_time,
         (vec_id % 5 = 0) AS is_temporal,
         CAST((vec_id * 37) % 100 AS DOUBLE) / 100 AS importance,
         CAST(vec_id % 7 AS INTEGER) AS access_count,
         CAST(1.0 AS DOUBLE) AS decay_factor,
         CAST(NULL AS VARCHAR) AS supersedes,
         CAST(NULL AS VARCHAR) AS source_session,
         'conversation' AS source_type,
         CAST(10 - vec_id % 4 AS DOUBLE) / 10 AS confidence,
         created AS created_at,
         CASE WHEN vec_id % 11 = 0 THEN NULL
              ELSE created + to_days(CAST(vec_id % 5 AS INTEGER)) END AS last_accessed,
         created + to_days(CAST(vec_id % 3 AS INTEGER)) AS updated_at,
         CASE WHEN vec_id % 23 = 0 THEN created + to_days(1) END AS deleted_at
  FROM _ed
),
requests AS (
  SELECT {_id('q', 'vec_id')} AS request_id,
         {_id('s', 'vec_id')} AS session_id,
         {_user(f'(vec_id + 1) % {N_USERS}')} AS user_id,
         text AS query,
         embedding,
         {_case('vec_id % 5', INTENTS)} AS intent,
         CAST(1000 + (vec_id % 4) * 1000 AS INTEGER) AS token_budget,
         CASE WHEN vec_id % 3 = 0 THEN ['lang:en']
              WHEN vec_id % 3 = 1 THEN ['lang:en', 'source:src1']
              ELSE CAST([] AS VARCHAR[]) END AS focus_entities
  FROM _ed WHERE embedding IS NOT NULL
),
items AS (
  SELECT {_id('i', 'conv_id')} || '_' || lpad(CAST(turn AS VARCHAR), 3, '0') AS item_id,
         {_id('s', 'conv_id')} AS session_id,
         {_user(f'(conv_id + 1) % {N_USERS}')} AS user_id,
         CASE WHEN role = 'system' THEN 'system' WHEN role = 'user' THEN 'message'
              WHEN turn % 4 = 3 THEN 'task_state' ELSE 'scratchpad' END AS content_type,
         text AS content,
         CAST(length(text) // 4 AS INTEGER) AS token_count,
         CAST((conv_id + turn) % 10 AS DOUBLE) / 10 AS relevance_score,
         (role = 'system') AS pinned,
         CAST(turn AS INTEGER) AS sequence_num,
         TIMESTAMP '{BASE_TS}' + to_minutes(CAST(turn AS INTEGER)) AS created_at,
         TIMESTAMP '{BASE_TS}' + to_minutes(CAST(turn AS INTEGER)) AS last_accessed
  FROM conversations
),
sessions AS (
  SELECT session_id, user_id, CAST(NULL AS VARCHAR) AS org_id,
         CAST(sum(token_count) AS INTEGER) AS total_tokens,
         {SESSION_MAX_TOKENS} AS max_tokens,
         TIMESTAMP '{BASE_TS}' AS created_at, max(created_at) AS last_activity,
         CAST(NULL AS TIMESTAMP) AS expires_at, CAST(NULL AS VARCHAR) AS config
  FROM items GROUP BY session_id, user_id
),
edges AS (
  SELECT {_id('r', 'vec_id')} AS relationship_id, {_id('m', 'vec_id')} AS source_id,
         {_id('m', f'vec_id + {N_USERS}')} AS target_id, {_user(f'vec_id % {N_USERS}')} AS user_id,
         {_case('vec_id % 5', RELATIONSHIPS)} AS relationship,
         CAST((vec_id * 17) % 100 AS DOUBLE) / 100 AS strength,
         CAST(NULL AS VARCHAR) AS context, TIMESTAMP '{BASE_TS}' AS created_at,
         CAST(NULL AS VARCHAR) AS created_by
  FROM embeddings
  UNION ALL
  SELECT {_id('r', 'vec_id')} || 'b', {_id('m', f'vec_id + {N_USERS}')}, {_id('m', 'vec_id')},
         {_user(f'vec_id % {N_USERS}')}, {_case('vec_id % 5', RELATIONSHIPS)},
         CAST((vec_id * 17) % 100 AS DOUBLE) / 100,
         CAST(NULL AS VARCHAR), TIMESTAMP '{BASE_TS}', CAST(NULL AS VARCHAR)
  FROM embeddings WHERE vec_id % 4 = 0
),
metrics AS (
  SELECT 'x' || CAST(event_id AS VARCHAR) AS metric_id,
         {_case('user_id % 3', SERVICES)} AS service,
         event_type AS operation, value AS latency_ms,
         (event_type <> 'error') AS success,
         CASE WHEN event_type = 'error' THEN props END AS error_msg,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS tokens_in,
         CAST(json_extract_string(props, '$.k') AS INTEGER) * 2 AS tokens_out,
         ts AS recorded_at
  FROM events
),
errors AS (
  SELECT 'e' || CAST(event_id AS VARCHAR) AS error_id,
         {_case('user_id % 4', TOOLS)} AS tool_name,
         {_user(f'user_id % {N_USERS}')} AS user_id,
         {_case('event_id % 3', ERROR_TYPES)} AS error_type,
         'call failed after ' || CAST(value AS VARCHAR) || ' ms with ' || props AS error_message,
         props AS input_preview, CAST(NULL AS VARCHAR) AS stack_trace, ts AS created_at
  FROM events WHERE event_type = 'error'
),
access_log AS (
  SELECT 'a' || CAST(event_id AS VARCHAR) AS access_id,
         {_id('m', 'event_id % 2000')} AS memory_id,
         {_id('s', 'user_id')} AS session_id,
         {_user(f'event_id % {N_USERS}')} AS user_id,
         props AS query_text, value / 100 AS similarity_score,
         CAST(NULL AS BOOLEAN) AS was_useful, CAST(NULL AS BOOLEAN) AS was_used,
         ts AS accessed_at
  FROM events WHERE event_type = 'view'
),
intent_weights AS (
  SELECT * FROM (VALUES {WEIGHT_ROWS}) t(intent, weight_key, weight)
),
taxonomy AS (
  SELECT * FROM (VALUES {TAXONOMY_ROWS}) t(memory_category, memory_subtype)
),
live AS (SELECT * FROM memories WHERE deleted_at IS NULL)
"""

AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"
METRICS_AS_OF_SQL = f"TIMESTAMP '{METRICS_AS_OF}'"


def cosine(a: str, b: str) -> str:
    """Cosine in double precision, NULL for a zero vector."""
    return (f"(CASE WHEN sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[])))"
            f" * sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))) > 0"
            f" THEN list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
            f" / (sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[])))"
            f" * sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[])))) END)")


def with_adapters(body: str) -> str:
    """Prefix the adapter CTEs.  ``body`` is a SELECT, or further CTEs
    ("name AS (...), ... SELECT ...")."""
    body = body.strip()
    sep = "\n" if body[:6].upper() == "SELECT" else ",\n"
    return "WITH " + ADAPTERS.strip() + sep + body
