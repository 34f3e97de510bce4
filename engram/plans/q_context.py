"""Registered queries: context assembly (2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as cx
from ..schemas import INTENTS
from ..sources import testdata as td
from .oracle import cosine
from .registry import register

T_TYPED = 0.2  # the fixture's largest cosine is ~0.5; the 0.5 default would select nothing

_KNOWN = ", ".join(f"'{i}'" for i in INTENTS)

CONTEXT_SQL = f"""
_rw AS (
  SELECT r.request_id, w.weight_key, w.weight FROM requests r
  JOIN intent_weights w ON w.intent = CASE WHEN r.intent IN ({_KNOWN}) THEN r.intent ELSE 'general' END
),
_req AS (
  SELECT r.request_id, r.session_id, r.user_id, r.embedding, r.token_budget, r.focus_entities,
         CAST(floor(r.token_budget * coalesce(w.weight, 0.35)) AS INTEGER) AS working_budget
  FROM requests r LEFT JOIN _rw w ON w.request_id = r.request_id AND w.weight_key = 'working_memory'
),
_wl AS (
  SELECT session_id, list_sort(list({{'k0': NOT pinned, 'k1': -sequence_num, 'id': item_id,
                                      'tok': CAST(token_count AS BIGINT)}})) AS xs
  FROM items GROUP BY 1
),
_wf AS (
  SELECT q.request_id, q.session_id,
         CASE WHEN l.xs IS NULL THEN {{'used': CAST(0 AS BIGINT), 'picked': CAST([] AS VARCHAR[])}}
              ELSE list_reduce(l.xs, lambda acc, x: CASE WHEN acc.used + x.tok <= q.working_budget
                        THEN {{'used': acc.used + x.tok, 'picked': list_append(acc.picked, x.id)}} ELSE acc END,
                        {{'used': CAST(0 AS BIGINT), 'picked': CAST([] AS VARCHAR[])}}) END AS r
  FROM _req q LEFT JOIN _wl l USING (session_id)
),
_used AS (SELECT request_id, r.used AS working_used FROM _wf),
_wrows AS (
  SELECT request_id, unnest(r.picked) AS item_id, generate_subscripts(r.picked, 1) - 1 AS position FROM _wf
),
_types AS (
  SELECT w.request_id, split_part(w.weight_key, '.', 1) AS memory_category, split_part(w.weight_key, '.', 2) AS memory_subtype,
         w.weight
  FROM _rw w JOIN _req q USING (request_id) JOIN _used u USING (request_id)
  WHERE w.weight_key <> 'working_memory' AND floor((q.token_budget - u.working_used) * w.weight) >= 50
),
_hits AS (
  SELECT t.request_id, t.memory_category, t.memory_subtype, t.weight, m.memory_id, m.content, m.entities, m.importance,
         q.focus_entities, {cosine('q.embedding', 'm.embedding')} AS similarity
  FROM _types t JOIN _req q USING (request_id)
  JOIN live m ON m.user_id = q.user_id AND m.memory_category = t.memory_category AND m.memory_subtype = t.memory_subtype
),
_top AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY request_id, memory_category, memory_subtype
                                 ORDER BY similarity DESC NULLS LAST, memory_id) AS rk FROM _hits)
  WHERE rk <= 5 AND similarity >= {T_TYPED}
),
_sc AS (
  SELECT *, CAST(length(content) // 4 AS INTEGER) AS token_count,
         CAST(coalesce(len(list_intersect(focus_entities, entities)), 0) AS INTEGER) AS entity_matches,
         CASE WHEN coalesce(len(list_intersect(focus_entities, entities)), 0) > 0
              THEN similarity * weight * (1.0 + importance) * (1.0 + 0.3 * len(list_intersect(focus_entities, entities)))
              ELSE similarity * weight * (1.0 + importance) END AS score
  FROM _top
),
_cl AS (
  SELECT request_id, list_sort(list({{'k0': -score, 'id': memory_id, 'tok': CAST(token_count AS BIGINT),
                                      'pfx': content}})) AS xs
  FROM _sc GROUP BY 1
),
_pk AS (
  SELECT q.request_id, q.token_budget,
         CASE WHEN c.xs IS NULL THEN {{'used': u.working_used, 'seen': CAST([] AS VARCHAR[]), 'picked': CAST([] AS VARCHAR[])}}
              ELSE list_reduce(c.xs, lambda acc, x: CASE WHEN acc.used + x.tok <= q.token_budget
                                                          AND NOT list_contains(acc.seen, x.pfx)
                   THEN {{'used': acc.used + x.tok, 'seen': list_append(acc.seen, x.pfx), 'picked': list_append(acc.picked, x.id)}}
                   ELSE acc END,
                   {{'used': u.working_used, 'seen': CAST([] AS VARCHAR[]), 'picked': CAST([] AS VARCHAR[])}}) END AS r
  FROM _req q JOIN _used u USING (request_id) LEFT JOIN _cl c USING (request_id)
),
_lrows AS (
  SELECT request_id, token_budget, unnest(r.picked) AS memory_id, generate_subscripts(r.picked, 1) - 1 AS lt_position
  FROM _pk
),
_nw AS (SELECT request_id, count(*) AS nw FROM _wrows GROUP BY 1),
_tot AS (SELECT request_id, r.used AS total_tokens, token_budget FROM _pk),
assembled AS (
  SELECT w.request_id, 'working_memory' AS source, CAST(w.position AS INTEGER) AS position, w.item_id,
         CAST(NULL AS VARCHAR) AS memory_id, CAST(NULL AS VARCHAR) AS memory_category, CAST(NULL AS VARCHAR) AS memory_subtype,
         i.token_count, CAST(i.relevance_score AS DOUBLE) AS relevance_score,
         'Recent ' || i.content_type || ' from current session' AS why_included, CAST(NULL AS DOUBLE) AS similarity
  FROM _wrows w JOIN items i USING (item_id)
  UNION ALL
  SELECT l.request_id, 'long_term', CAST(coalesce(n.nw, 0) + l.lt_position AS INTEGER), CAST(NULL AS VARCHAR),
         l.memory_id, s.memory_category, s.memory_subtype, s.token_count, round(s.score, 3),
         concat_ws(' | ', s.memory_category || '.' || s.memory_subtype || ' memory',
                   CASE WHEN s.entity_matches > 0 THEN 'entity match' END,
                   CASE WHEN s.score > 0.8 THEN 'highly relevant' WHEN s.score > 0.5 THEN 'relevant' END),
         round(s.similarity, 6)
  FROM _lrows l JOIN _sc s ON s.request_id = l.request_id AND s.memory_id = l.memory_id
  LEFT JOIN _nw n ON n.request_id = l.request_id
),
assembled_full AS (
  SELECT a.*, t.total_tokens, CAST((t.total_tokens * 20000 + t.token_budget) // (2 * t.token_budget) AS DOUBLE) / 100 AS budget_used_pct
  FROM assembled a JOIN _tot t USING (request_id)
)
"""


def _assemble(spark, sf):
    out = cx.assemble_context(td.requests(spark, sf), td.items(spark, sf), td.memories(spark, sf),
                              min_similarity=T_TYPED)
    return out.withColumn("similarity", F.round("similarity", 6))


@register("assemble_context", CONTEXT_SQL + "SELECT * FROM assembled_full")
def q_assemble_context(spark, sf):
    return _assemble(spark, sf)


@register("context_stats", CONTEXT_SQL + """
SELECT request_id, 'source' AS dimension, source AS value, count(*) AS n FROM assembled GROUP BY 1, 3
UNION ALL
SELECT request_id, 'category', memory_category, count(*) FROM assembled WHERE source = 'long_term' GROUP BY 1, 3
UNION ALL
SELECT request_id, 'subtype', memory_subtype, count(*) FROM assembled WHERE source = 'long_term' GROUP BY 1, 3
""")
def q_context_stats(spark, sf):
    return cx.context_stats(_assemble(spark, sf))


@register("working_context", CONTEXT_SQL + """
SELECT w.request_id, u.working_used, w.item_id, CAST(w.position AS INTEGER) AS position
FROM _wrows w JOIN _used u USING (request_id)
""")
def q_working_context(spark, sf):
    req = td.requests(spark, sf)
    rw = cx.request_weights(req).where(F.col("weight_key") == "working_memory")
    r = (req.join(rw, "request_id", "left")
         .withColumn("working_budget", (F.col("token_budget") * F.coalesce("weight", F.lit(0.35))).cast("int"))
         .select("request_id", "session_id", "working_budget"))
    out = cx.working_context(td.items(spark, sf), r)
    return out.select("request_id", "working_used", "item_id", "position")


@register("budget_split", CONTEXT_SQL + """
SELECT t.request_id, t.memory_category, t.memory_subtype, t.weight,
       CAST(floor((q.token_budget - u.working_used) * t.weight) AS INTEGER) AS type_budget
FROM _types t JOIN _req q USING (request_id) JOIN _used u USING (request_id)
""")
def q_budget_split(spark, sf):
    req = td.requests(spark, sf)
    rw = cx.budget_split(req)
    wm = rw.where(F.col("weight_key") == "working_memory").select("request_id", F.col("weight").alias("w_wm"))
    r = (req.join(wm, "request_id", "left")
         .withColumn("working_budget", (F.col("token_budget") * F.coalesce("w_wm", F.lit(0.35))).cast("int"))
         .select("request_id", "session_id", "working_budget"))
    used = (r.select("request_id").join(cx.working_context(td.items(spark, sf), r)
                                         .groupBy("request_id").agg(F.max("working_used").alias("working_used")),
                                         "request_id", "left")
            .select("request_id", F.coalesce("working_used", F.lit(0)).alias("working_used")))
    out = (rw.where(F.col("weight_key") != "working_memory").join(used, "request_id")
           .withColumn("type_budget", ((F.col("token_budget") - F.col("working_used")) * F.col("weight")).cast("int"))
           .where(F.col("type_budget") >= 50))
    return out.select("request_id", F.split_part("weight_key", F.lit("."), F.lit(1)).alias("memory_category"),
                      F.split_part("weight_key", F.lit("."), F.lit(2)).alias("memory_subtype"), "weight", "type_budget")


@register("request_weights", f"""
SELECT r.request_id, w.weight_key, w.weight FROM requests r
JOIN intent_weights w ON w.intent = CASE WHEN r.intent IN ({_KNOWN}) THEN r.intent ELSE 'general' END
""")
def q_request_weights(spark, sf):
    return cx.request_weights(td.requests(spark, sf))


@register("normalize_intent", f"""
SELECT conv_id, turn,
  CASE WHEN contains(t, 'how') THEN 'how_to' WHEN contains(t, 'happened') THEN 'what_happened'
       WHEN contains(t, 'what_is') OR contains(t, 'what is') THEN 'what_is' WHEN contains(t, 'debug') THEN 'debug'
       WHEN t IN ({_KNOWN}) THEN t ELSE 'general' END AS intent
FROM (SELECT conv_id, turn, lower(trim(regexp_replace(coalesce(text, ''), '["'']', '', 'g'))) AS t FROM conversations)
""")
def q_normalize_intent(spark, sf):
    c = td.read(spark, sf, "conversations")
    return c.select("conv_id", "turn", cx.normalize_intent("text").alias("intent"))


@register("assemble_context_unified")
def q_assemble_unified(spark, sf):
    out = cx.assemble_context_unified(td.requests(spark, sf), td.items(spark, sf), td.memories(spark, sf),
                                      min_similarity=T_TYPED)
    return out.select("request_id", "position", "id", "source", "token_count", F.round("score", 6).alias("score"),
                      "total_tokens")


def _attach():
    from .registry import attach_sql
    attach_sql("assemble_context_unified", f"""
_rw AS (
  SELECT r.request_id, w.weight_key, w.weight FROM requests r
  JOIN intent_weights w ON w.intent = CASE WHEN r.intent IN ({_KNOWN}) THEN r.intent ELSE 'general' END
),
_types AS (
  SELECT request_id, split_part(weight_key, '.', 1) AS memory_category, split_part(weight_key, '.', 2) AS memory_subtype,
         weight FROM _rw WHERE weight_key <> 'working_memory'
),
_hits AS (
  SELECT t.request_id, t.weight, m.memory_id, m.content, m.entities, m.importance, q.focus_entities,
         t.memory_category, t.memory_subtype, {cosine('q.embedding', 'm.embedding')} AS similarity
  FROM _types t JOIN requests q USING (request_id)
  JOIN live m ON m.user_id = q.user_id AND m.memory_category = t.memory_category AND m.memory_subtype = t.memory_subtype
),
_top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, memory_category, memory_subtype
                                              ORDER BY similarity DESC NULLS LAST, memory_id) AS rk FROM _hits)
  WHERE rk <= 20 AND similarity >= {T_TYPED}
),
_all AS (
  SELECT request_id, memory_id AS id, CAST(length(content) // 4 AS INTEGER) AS token_count,
         CASE WHEN coalesce(len(list_intersect(focus_entities, entities)), 0) > 0
              THEN similarity * weight * (1.0 + importance) * (1.0 + 0.3 * len(list_intersect(focus_entities, entities)))
              ELSE similarity * weight * (1.0 + importance) END AS score, 'long_term' AS source
  FROM _top
  UNION ALL
  SELECT q.request_id, i.item_id, i.token_count, i.relevance_score * w.weight, 'working_memory'
  FROM requests q JOIN _rw w ON w.request_id = q.request_id AND w.weight_key = 'working_memory'
  JOIN items i ON i.session_id = q.session_id
),
_l AS (SELECT request_id, list_sort(list({{'k0': -score, 'id': id, 'tok': CAST(token_count AS BIGINT)}})) AS xs
       FROM _all GROUP BY 1),
_f AS (
  SELECT q.request_id, list_reduce(l.xs, lambda acc, x: CASE WHEN acc.used + x.tok <= q.token_budget
                THEN {{'used': acc.used + x.tok, 'picked': list_append(acc.picked, x.id)}} ELSE acc END,
                {{'used': CAST(0 AS BIGINT), 'picked': CAST([] AS VARCHAR[])}}) AS r
  FROM requests q JOIN _l l USING (request_id)
),
_x AS (SELECT request_id, r.used AS total_tokens, unnest(r.picked) AS id, generate_subscripts(r.picked, 1) - 1 AS position
       FROM _f)
SELECT x.request_id, CAST(x.position AS INTEGER) AS position, x.id, a.source, a.token_count,
       round(a.score, 6) AS score, x.total_tokens
FROM _x x JOIN _all a ON a.request_id = x.request_id AND a.id = x.id
""")


_attach()


# ------------------------------------------------- per-step views of the assembly
SCORE_SQL = f"""
_rw AS (
  SELECT r.request_id, w.weight_key, w.weight FROM requests r
  JOIN intent_weights w ON w.intent = CASE WHEN r.intent IN ({_KNOWN}) THEN r.intent ELSE 'general' END
),
_hits AS (
  SELECT q.request_id, w.weight, m.memory_id, m.entities, m.importance, q.focus_entities,
         m.memory_category, m.memory_subtype, {cosine('q.embedding', 'm.embedding')} AS similarity
  FROM _rw w JOIN requests q USING (request_id)
  JOIN live m ON m.user_id = q.user_id AND m.memory_category = split_part(w.weight_key, '.', 1)
             AND m.memory_subtype = split_part(w.weight_key, '.', 2)
  WHERE w.weight_key <> 'working_memory'
),
_top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id, memory_category, memory_subtype
                                              ORDER BY similarity DESC NULLS LAST, memory_id) AS rk FROM _hits)
  WHERE rk <= 5 AND similarity >= {T_TYPED}
)
SELECT request_id, memory_id, CAST(coalesce(len(list_intersect(focus_entities, entities)), 0) AS INTEGER) AS entity_matches,
       round(CASE WHEN coalesce(len(list_intersect(focus_entities, entities)), 0) > 0
                  THEN similarity * weight * (1.0 + importance) * (1.0 + 0.3 * len(list_intersect(focus_entities, entities)))
                  ELSE similarity * weight * (1.0 + importance) END, 6) AS score
FROM _top
"""


@register("score_candidates", SCORE_SQL)
def q_score_candidates(spark, sf):
    from ..operators.context import known_intent, profile_types, score_candidates
    from ..operators.search import typed_topk
    req = td.requests(spark, sf)
    q = req.select("request_id", "user_id", "embedding", known_intent().alias("intent"))
    hits = typed_topk(q, td.memories(spark, sf), profile_types(spark), n=5, min_similarity=T_TYPED)
    hits = hits.join(req.select("request_id", "focus_entities"), "request_id")
    out = score_candidates(hits)
    return out.select("request_id", "memory_id", F.col("entity_matches").cast("int").alias("entity_matches"),
                      F.round("score", 6).alias("score"))


@register("pack_context", CONTEXT_SQL + """
SELECT request_id, memory_id, position, token_count FROM assembled WHERE source = 'long_term'
""")
def q_pack_context(spark, sf):
    a = _assemble(spark, sf)
    return a.where(F.col("source") == "long_term").select("request_id", "memory_id", "position", "token_count")


@register("explain_inclusion", CONTEXT_SQL + """
SELECT request_id, memory_id, why_included FROM assembled WHERE source = 'long_term'
""")
def q_explain_inclusion(spark, sf):
    a = _assemble(spark, sf)
    return a.where(F.col("source") == "long_term").select("request_id", "memory_id", "why_included")


# per-request weight overrides (a user-tuned profile for one intent)
OVERRIDES = {"how_to": {"working_memory": 0.4, "procedural.workflow": 0.1}}


@register("intent_weights_override", f"""
SELECT r.request_id, w.weight_key,
       CASE WHEN w.intent = 'how_to' AND w.weight_key = 'working_memory' THEN CAST(0.4 AS DOUBLE)
            WHEN w.intent = 'how_to' AND w.weight_key = 'procedural.workflow' THEN CAST(0.1 AS DOUBLE)
            ELSE w.weight END AS weight
FROM requests r
JOIN intent_weights w ON w.intent = CASE WHEN r.intent IN ({_KNOWN}) THEN r.intent ELSE 'general' END
""")
def q_intent_weights_override(spark, sf):
    return cx.request_weights(td.requests(spark, sf), cx.intent_weights(spark, OVERRIDES))
