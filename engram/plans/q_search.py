"""Registered queries: filters (2.2), vector search (2.3) and recall (2.4)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import filters as flt
from ..operators import ivf as IVF
from ..operators import recall as rc
from ..operators import search as S
from ..session import shared_path
from ..sources import testdata as td
from .blocking import blocked
from .oracle import AS_OF_SQL, cosine
from .registry import register

R6 = 6
#: Rows of a block where every pair is a row of the result: a row is sent once for every block of the other side.
PAIR_BLOCK_ROWS = 4096


def _r(c, n=R6):
    return F.round(c, n)


# ---------------------------------------------------------------- vector maths
@register("vector_functions", f"""
SELECT r.request_id, m.memory_id,
       round({cosine('r.embedding', 'm.embedding')}, 6) AS cosine_similarity,
       round(1 - {cosine('r.embedding', 'm.embedding')}, 6) AS cosine_distance,
       round(sqrt(list_sum(list_transform(list_zip(CAST(r.embedding AS DOUBLE[]), CAST(m.embedding AS DOUBLE[])),
             lambda x: (x[1] - x[2]) * (x[1] - x[2])))), 6) AS euclidean_distance,
       round(list_dot_product(CAST(r.embedding AS DOUBLE[]), CAST(m.embedding AS DOUBLE[])), 6) AS inner_product,
       round(greatest(0.0, least(1.0, 1 - (1 - {cosine('r.embedding', 'm.embedding')}) / 2)), 6) AS score_half,
       round(1.0 / (1.0 + greatest(0.0, sqrt(list_sum(list_transform(list_zip(CAST(r.embedding AS DOUBLE[]), CAST(m.embedding AS DOUBLE[])),
             lambda x: (x[1] - x[2]) * (x[1] - x[2])))))), 6) AS score_inverse
FROM requests r JOIN memories m ON r.user_id = m.user_id WHERE m.embedding IS NOT NULL
""")
def q_vector_functions(spark, sf):
    r = td.requests(spark, sf).select("request_id", "user_id", F.col("embedding").alias("a"))
    m = td.memories(spark, sf).where(S.has_vector("embedding")).select("memory_id", "user_id",
                                                                       F.col("embedding").alias("b"))
    # vectors of different lengths, or with null components, have no measure
    whole = F.when(F.forall("a", lambda x: x.isNotNull()), F.size("a"))
    r = r.withColumns({"_a_dim": whole, "_a_norm": V.norm("a")})
    m = m.withColumns({"_b_dim": F.size("b"), "_b_norm": V.norm("b")})
    dim = m.agg(F.max("_b_dim")).first()[0] or 0
    r, m, on = blocked(r, m, ["user_id"], "request_id", "memory_id", PAIR_BLOCK_ROWS)
    if dim <= V.MOST_PARTS:
        # sent as arrays, half as large as their double columns
        r, m = V.with_parts(r.repartition(*on), "a", dim, "_a"), V.with_parts(m.repartition(*on), "b", dim, "_b")
        dot, gap = V.dot_parts(dim, "_a", "_b"), V.euclidean_parts(dim, "_a", "_b")
    else:
        dot, gap = V.inner_product("a", "b"), V.euclidean_distance("a", "b")
    meet = F.col("_a_dim") == F.col("_b_dim")
    j = r.join(m, on).select(
        "request_id", "memory_id", "_a_norm", "_b_norm", F.when(meet, dot).alias("ip"), F.when(meet, gap).alias("l2"))
    j = j.withColumn("cos", V.cosine_from_parts(F.col("ip"), F.col("_a_norm"), F.col("_b_norm")))
    return j.select(
        "request_id", "memory_id",
        _r(F.col("cos")).alias("cosine_similarity"),
        _r(F.lit(1.0) - F.col("cos")).alias("cosine_distance"),
        _r(F.col("l2")).alias("euclidean_distance"),
        _r(F.col("ip")).alias("inner_product"),
        _r(V.score_from_distance(F.lit(1.0) - F.col("cos"), "half")).alias("score_half"),
        _r(V.score_from_distance("l2", "inverse")).alias("score_inverse"),
    )


KNN_SQL = f"""
_k AS (
  SELECT r.request_id, r.user_id, m.memory_id, m.importance,
         {cosine('r.embedding', 'm.embedding')} AS score
  FROM requests r JOIN live m ON r.user_id = m.user_id WHERE m.embedding IS NOT NULL
),
_kr AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY request_id
         ORDER BY score DESC NULLS LAST, importance DESC NULLS LAST, memory_id) AS INTEGER) AS rank
  FROM _k
)
"""


KNN_OUT = """
SELECT request_id, user_id, memory_id, round(score, 6) AS score, rank FROM _kr WHERE rank <= 10
"""


@register("knn_exact", KNN_SQL + KNN_OUT)
def q_knn_exact(spark, sf):
    out = S.knn_exact(td.requests(spark, sf), td.memories(spark, sf), 10)
    return out.select("request_id", "user_id", "memory_id", _r(F.col("score")).alias("score"), "rank")


@register("knn_exact_sql", KNN_SQL + KNN_OUT)
def q_knn_exact_sql(spark, sf):
    """The same search scored by the native dot-product expression."""
    out = S.knn_exact(td.requests(spark, sf), td.memories(spark, sf), 10, method="sql")
    return out.select("request_id", "user_id", "memory_id", _r(F.col("score")).alias("score"), "rank")


@register("knn_post_filter", f"""
_g AS (
  SELECT r.request_id, r.user_id AS req_user, m.user_id, m.deleted_at, m.memory_id,
         {cosine('r.embedding', 'm.embedding')} AS score,
         row_number() OVER (PARTITION BY r.request_id ORDER BY {cosine('r.embedding', 'm.embedding')} DESC NULLS LAST,
                            m.importance DESC NULLS LAST, m.memory_id) AS global_rank
  FROM requests r CROSS JOIN memories m WHERE m.embedding IS NOT NULL
)
SELECT request_id, user_id, memory_id, round(score, 6) AS score, CAST(global_rank AS INTEGER) AS global_rank,
       CAST(row_number() OVER (PARTITION BY request_id ORDER BY global_rank) AS INTEGER) AS rank
FROM _g WHERE global_rank <= 40 AND user_id = req_user AND deleted_at IS NULL
""")
def q_knn_post_filter(spark, sf):
    out = S.knn_post_filter(td.requests(spark, sf), td.memories(spark, sf), 40)
    return out.select("request_id", "user_id", "memory_id", _r(F.col("score")).alias("score"),
                      "global_rank", "rank")


@register("knn_block", KNN_SQL + KNN_OUT)
def q_knn_block(spark, sf):
    out = S.knn_block(td.requests(spark, sf), td.memories(spark, sf), 10)
    return out.select("request_id", "user_id", "memory_id", _r(F.col("score")).alias("score"), "rank")


@register("ann_lsh")
def q_ann_lsh(spark, sf):
    out = S.ann_lsh(td.requests(spark, sf), td.memories(spark, sf), 10, threshold=0.0,
                    bands=S.UNCLUSTERED_BANDS, bits=None)
    return out.select("request_id", "user_id", "memory_id", _r(F.col("score")).alias("score"), "rank")


@register("ann_index", KNN_SQL + KNN_OUT)
def q_ann_index(spark, sf):
    """The index written to the shared folder, then searched.  At its margin the result
    is expected to be that of the exact search, which the twin computes."""
    path = shared_path(spark, f"ivf-{uuid.uuid4().hex}")
    IVF.build_index(td.memories(spark, sf), path)
    out = IVF.search_index(td.requests(spark, sf), path, 10)
    return out.select("request_id", "user_id", "memory_id", _r(F.col("score")).alias("score"), "rank")


@register("min_similarity_filter", KNN_SQL + """
SELECT request_id, memory_id, round(score, 6) AS score FROM _kr WHERE rank <= 10 AND score >= 0.25
""")
def q_min_similarity(spark, sf):
    out = S.min_similarity_filter(S.knn_exact(td.requests(spark, sf), td.memories(spark, sf), 10), 0.25)
    return out.select("request_id", "memory_id", _r(F.col("score")).alias("score"))


@register("entity_boost", KNN_SQL + """
SELECT k.request_id, k.memory_id,
       CAST(coalesce(len(list_intersect(r.focus_entities, m.entities)), 0) AS INTEGER) AS entity_matches,
       round(CASE WHEN coalesce(len(list_intersect(r.focus_entities, m.entities)), 0) > 0
             THEN least(1.0, k.score * (1 + 0.2 * len(list_intersect(r.focus_entities, m.entities))))
             ELSE least(1.0, k.score) END, 6) AS boost_recall,
       round(CASE WHEN coalesce(len(list_intersect(r.focus_entities, m.entities)), 0) > 0
             THEN k.score * (1 + 0.3 * len(list_intersect(r.focus_entities, m.entities)))
             ELSE k.score END, 6) AS boost_context,
       round(CASE WHEN coalesce(len(list_intersect(r.focus_entities, m.entities)), 0) > 0
             THEN k.score * 1.3 ELSE k.score END, 6) AS boost_flat
FROM _kr k JOIN requests r USING (request_id) JOIN memories m USING (memory_id)
WHERE k.rank <= 10
""")
def q_entity_boost(spark, sf):
    req = td.requests(spark, sf)
    hits = S.knn_exact(req, td.memories(spark, sf), 10, carry=["entities"], qcarry=["focus_entities"])
    m = S.entity_matches("focus_entities", "entities")
    return hits.select(
        "request_id", "memory_id", m.cast("int").alias("entity_matches"),
        _r(S.entity_boost("score", m, "recall")).alias("boost_recall"),
        _r(S.entity_boost("score", m, "context")).alias("boost_context"),
        _r(S.entity_boost("score", m, "flat")).alias("boost_flat"))


@register("hybrid_relevance", KNN_SQL + f"""
SELECT k.request_id, k.memory_id,
       round(0.5 * k.score
             + 0.2 * exp(-(epoch_us({AS_OF_SQL}) - epoch_us(coalesce(m.last_accessed, m.created_at))) / 1e6 / 2592000.0)
             + 0.1 * (ln(1.0 + m.access_count) / ln(101.0))
             + 0.2 * m.importance, 6) AS relevance_score
FROM _kr k JOIN memories m USING (memory_id)
WHERE k.rank <= 10
""")
def q_hybrid(spark, sf):
    hits = S.knn_exact(td.requests(spark, sf), td.memories(spark, sf), 10,
                       carry=["last_accessed", "created_at", "access_count"])
    out = S.hybrid_relevance(hits, td.as_of())
    return out.select("request_id", "memory_id", _r(F.col("relevance_score")).alias("relevance_score"))


@register("typed_topk", f"""
_w AS (
  SELECT r.request_id, r.user_id, r.embedding, split_part(w.weight_key, '.', 1) AS memory_category,
         split_part(w.weight_key, '.', 2) AS memory_subtype, w.weight
  FROM requests r JOIN intent_weights w ON w.intent = r.intent WHERE w.weight_key <> 'working_memory'
),
_s AS (
  SELECT w.request_id, w.memory_category, w.memory_subtype, w.weight, m.memory_id,
         {cosine('w.embedding', 'm.embedding')} AS similarity
  FROM _w w JOIN live m ON m.user_id = w.user_id AND m.memory_category = w.memory_category
                        AND m.memory_subtype = w.memory_subtype
),
_r AS (
  SELECT *, row_number() OVER (PARTITION BY request_id, memory_category, memory_subtype
                               ORDER BY similarity DESC NULLS LAST, memory_id) AS rank FROM _s
)
SELECT request_id, memory_category, memory_subtype, weight, memory_id, round(similarity, 6) AS similarity,
       CAST(rank AS INTEGER) AS rank
FROM _r WHERE rank <= 5 AND similarity >= 0.2
""")
def q_typed_topk(spark, sf):
    from ..operators.context import known_intent, profile_types
    req = td.requests(spark, sf).select("request_id", "user_id", "embedding", known_intent().alias("intent"))
    out = S.typed_topk(req, td.memories(spark, sf), profile_types(spark), n=5, min_similarity=0.2)
    return out.select("request_id", "memory_category", "memory_subtype", "weight", "memory_id",
                      _r(F.col("similarity")).alias("similarity"), "rank")


@register("near_duplicates", f"""
_inc AS (
  SELECT 'n' || memory_id AS request_id, user_id, embedding FROM memories
),
_k AS (
  SELECT i.request_id, i.user_id, m.memory_id, m.content, m.importance,
         {cosine('i.embedding', 'm.embedding')} AS similarity
  FROM _inc i JOIN live m ON i.user_id = m.user_id
),
_r AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY similarity DESC NULLS LAST,
                               importance DESC NULLS LAST, memory_id) AS rank FROM _k
),
_d AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rank) AS dup_rank
  FROM _r WHERE rank <= 10 AND similarity >= 0.3
)
SELECT request_id, user_id, memory_id, round(similarity, 6) AS similarity, CAST(dup_rank AS INTEGER) AS dup_rank,
       CASE WHEN length(content) > 100 THEN left(content, 100) || '...' ELSE content END AS content_preview
FROM _d WHERE dup_rank <= 3
""")
def q_near_duplicates(spark, sf):
    inc = td.memories(spark, sf).select(F.concat(F.lit("n"), "memory_id").alias("request_id"),
                                        "user_id", "embedding")
    out = S.near_duplicates(inc, td.memories(spark, sf), t=0.3, n=3)
    return out.withColumn("similarity", _r(F.col("similarity")))


# ---------------------------------------------------------------- recall
RECALL_SQL = KNN_SQL.replace("SELECT r.request_id, r.user_id, m.memory_id, m.importance,",
                             "SELECT r.request_id, r.user_id, m.memory_id, m.importance, r.focus_entities, "
                             "m.entities, m.memory_category, m.memory_subtype,") + """,
_f AS (
  SELECT *, CAST(coalesce(len(list_intersect(focus_entities, entities)), 0) AS INTEGER) AS entity_matches
  FROM _kr WHERE rank <= 30 AND score >= 0.2
),
_e AS (
  SELECT request_id, user_id, memory_id, memory_category, memory_subtype, entity_matches,
         round(score, 4) AS similarity,
         round(CASE WHEN entity_matches > 0 THEN least(1.0, score * (1 + 0.2 * entity_matches))
                    ELSE least(1.0, score) END, 4) AS effective_similarity,
         rank AS fetch_rank
  FROM _f
),
_rec AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY effective_similarity DESC, fetch_rank)
         AS INTEGER) AS final_rank FROM _e
),
recalled AS (SELECT * FROM _rec WHERE final_rank <= 10)
"""


@register("recall", RECALL_SQL + """
SELECT request_id, user_id, memory_id, memory_category, memory_subtype, similarity,
       effective_similarity, entity_matches, final_rank AS rank
FROM recalled
""")
def q_recall(spark, sf):
    out = rc.recall(td.requests(spark, sf), td.memories(spark, sf), limit=10, min_similarity=0.2)
    return out.select("request_id", "user_id", "memory_id", "memory_category", "memory_subtype",
                      "similarity", "effective_similarity", F.col("entity_matches").cast("int"), "rank")


FILTER = {"after": "2024-04-20 00:00:00", "tags": ["en", "de"], "min_confidence": 0.8}


@register("recall_filtered", RECALL_SQL.replace("live m ON", f"""(
  SELECT * FROM live WHERE created_at >= TIMESTAMP '{FILTER["after"]}' AND confidence >= {FILTER["min_confidence"]}
    AND json_extract_string(metadata, '$.tags[0]') IN ('en', 'de')) m ON""") + """
SELECT request_id, memory_id, similarity, effective_similarity, entity_matches, final_rank AS rank FROM recalled
""")
def q_recall_filtered(spark, sf):
    out = rc.recall(td.requests(spark, sf), td.memories(spark, sf), limit=10, min_similarity=0.2, **FILTER)
    return out.select("request_id", "memory_id", "similarity", "effective_similarity",
                      F.col("entity_matches").cast("int"), "rank")


@register("retrieval_breakdown", RECALL_SQL + """
SELECT request_id, 'category' AS dimension, memory_category AS value, count(*) AS n FROM recalled GROUP BY 1, 3
UNION ALL
SELECT request_id, 'subtype', memory_subtype, count(*) FROM recalled GROUP BY 1, 3
UNION ALL
SELECT request_id, 'total', NULL, count(*) FROM recalled GROUP BY 1
UNION ALL
SELECT request_id, 'entity_matches', NULL, count(*) FILTER (WHERE entity_matches > 0) FROM recalled GROUP BY 1
""")
def q_retrieval_breakdown(spark, sf):
    rec = rc.recall(td.requests(spark, sf), td.memories(spark, sf), limit=10, min_similarity=0.2)
    return rc.retrieval_breakdown(rec)


@register("bump_access", RECALL_SQL + f"""
, _h AS (SELECT memory_id, count(*) AS hits FROM recalled GROUP BY 1)
SELECT m.memory_id,
       CASE WHEN h.hits IS NOT NULL THEN m.access_count + CAST(h.hits AS INTEGER) ELSE m.access_count END AS access_count,
       CASE WHEN h.hits IS NOT NULL THEN {AS_OF_SQL} ELSE m.last_accessed END AS last_accessed
FROM memories m LEFT JOIN _h h USING (memory_id)
""")
def q_bump_access(spark, sf):
    mem = td.memories(spark, sf)
    rec = rc.recall(td.requests(spark, sf), mem, limit=10, min_similarity=0.2)
    return rc.bump_access(mem, rec, td.as_of()).select("memory_id", "access_count", "last_accessed")


@register("log_access", RECALL_SQL + f"""
SELECT r.memory_id, q.session_id, r.user_id, q.query AS query_text,
       CAST(r.similarity AS DOUBLE) AS similarity_score, CAST(NULL AS BOOLEAN) AS was_useful,
       CAST(NULL AS BOOLEAN) AS was_used, {AS_OF_SQL} AS accessed_at
FROM recalled r JOIN requests q USING (request_id)
""")
def q_log_access(spark, sf):
    req = td.requests(spark, sf)
    rec = rc.recall(req, td.memories(spark, sf), limit=10, min_similarity=0.2)
    sel = rec.join(req.select("request_id", "session_id", "query"), "request_id")
    return rc.log_access(sel, td.as_of()).drop("access_id")


# ---------------------------------------------------------------- filters
@register("live", "SELECT memory_id, user_id FROM memories WHERE deleted_at IS NULL")
def q_live(spark, sf):
    return flt.live(td.memories(spark, sf)).select("memory_id", "user_id")


@register("scope_users", """
SELECT m.memory_id, m.user_id FROM memories m
WHERE m.user_id IN (SELECT DISTINCT user_id FROM sessions WHERE total_tokens > 500)
""")
def q_scope_users(spark, sf):
    users = td.sessions(spark, sf).where(F.col("total_tokens") > 500).select("user_id")
    return flt.scope_users(td.memories(spark, sf), users).select("memory_id", "user_id")


@register("taxonomy_filter", """
SELECT memory_id, memory_category, memory_subtype FROM memories
WHERE memory_category IN ('episodic', 'semantic') AND memory_subtype IN ('decision', 'entity', 'project')
""")
def q_taxonomy_filter(spark, sf):
    out = flt.taxonomy_filter(td.memories(spark, sf), ["episodic", "semantic"], ["decision", "entity", "project"])
    return out.select("memory_id", "memory_category", "memory_subtype")


@register("temporal_tag_filter", """
SELECT memory_id, created_at, confidence FROM memories
WHERE created_at >= TIMESTAMP '2024-04-15 00:00:00' AND created_at < TIMESTAMP '2024-05-20 00:00:00'
  AND list_has_any(CAST(json_extract_string(metadata, '$.tags') AS VARCHAR[]), ['en', 'fr'])
  AND confidence >= 0.8
""")
def q_temporal_tag_filter(spark, sf):
    out = flt.temporal_tag_filter(td.memories(spark, sf), after="2024-04-15 00:00:00",
                                  before="2024-05-20 00:00:00", tags=["en", "fr"], min_confidence=0.8)
    return out.select("memory_id", "created_at", "confidence")


@register("lookup_by_ids", """
SELECT m.memory_id, m.user_id, m.memory_category FROM live m
WHERE EXISTS (SELECT 1 FROM edges e WHERE e.target_id = m.memory_id AND e.user_id = m.user_id)
""")
def q_lookup_by_ids(spark, sf):
    ids = td.edges(spark, sf).select(F.col("target_id").alias("memory_id"), "user_id")
    return flt.lookup_by_ids(td.memories(spark, sf), ids).select("memory_id", "user_id", "memory_category")


@register("validate_taxonomy", """
SELECT m.memory_id, m.memory_category, m.memory_subtype, (t.memory_category IS NOT NULL) AS is_valid
FROM memories m LEFT JOIN taxonomy t USING (memory_category, memory_subtype)
""")
def q_validate_taxonomy(spark, sf):
    return flt.validate_taxonomy(td.memories(spark, sf)).select(
        "memory_id", "memory_category", "memory_subtype", "is_valid")


@register("item_type_filter", """
SELECT item_id, content_type FROM items WHERE content_type IN ('message', 'task_state')
""")
def q_item_type_filter(spark, sf):
    return flt.item_type_filter(td.items(spark, sf), ["message", "task_state"]).select("item_id", "content_type")


@register("authorize_requests", """
_req AS (
  SELECT 'z' || source_id AS request_id, target_id AS memory_id, user_id FROM edges
)
SELECT r.request_id, r.memory_id, r.user_id,
       CASE WHEN m.user_id IS NULL THEN 'not_found' WHEN m.user_id <> r.user_id THEN 'unauthorized'
            ELSE 'ok' END AS status
FROM _req r LEFT JOIN live m ON m.memory_id = r.memory_id
""")
def q_authorize_requests(spark, sf):
    e = td.edges(spark, sf)
    reqs = e.select(F.concat(F.lit("z"), "source_id").alias("request_id"),
                    F.col("target_id").alias("memory_id"), "user_id")
    return flt.authorize_requests(reqs, td.memories(spark, sf))


@register("preview", """
SELECT memory_id, CASE WHEN length(content) > 100 THEN left(content, 100) || '...' ELSE content END AS preview_100,
       CASE WHEN length(summary) > 50 THEN left(summary, 50) || '...' ELSE summary END AS preview_50
FROM memories
""")
def q_preview(spark, sf):
    m = td.memories(spark, sf)
    return m.select("memory_id", flt.preview("content", 100).alias("preview_100"),
                    flt.preview("summary", 50).alias("preview_50"))
