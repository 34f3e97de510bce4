"""Registered queries: long-term memory changes (2.5) and consolidation (2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle as lc
from ..operators.gating import classify
from ..sources import testdata as td
from .oracle import AS_OF_SQL
from .q_text import _classify_sql, _gate_sql
from .registry import register

VID_SQL = "CAST(substr(memory_id, 2) AS INTEGER)"


def _vid():
    return F.substring("memory_id", 2, 10).cast("int")


def _changes(m):
    v = _vid()
    return m.select(F.concat(F.lit("c"), "memory_id").alias("request_id"), "memory_id",
                    F.when(v % 7 == 3, F.lit("u9")).otherwise(F.col("user_id")).alias("user_id"),
                    F.when(v % 3 == 0, F.concat("summary", F.lit(" (edited)"))).alias("content"),
                    F.when(v % 3 == 1, F.col("importance") / 2).alias("importance"),
                    F.lit(None).cast("array<string>").alias("entities"),
                    F.lit(None).cast("string").alias("metadata"))


CHANGES_SQL = f"""
_ch AS (
  SELECT 'c' || memory_id AS request_id, memory_id,
         CASE WHEN {VID_SQL} % 7 = 3 THEN 'u9' ELSE user_id END AS user_id,
         CASE WHEN {VID_SQL} % 3 = 0 THEN summary || ' (edited)' END AS content,
         CASE WHEN {VID_SQL} % 3 = 1 THEN importance / 2 END AS importance
  FROM memories
),
_st AS (
  SELECT c.*, CASE WHEN l.user_id IS NULL THEN 'not_found' WHEN l.user_id <> c.user_id THEN 'unauthorized'
                   WHEN c.content IS NULL AND c.importance IS NULL THEN 'empty' ELSE 'ok' END AS status
  FROM _ch c LEFT JOIN live l USING (memory_id)
)
"""


@register("update_memories_report", CHANGES_SQL + """
SELECT request_id, memory_id, user_id, status, (content IS NOT NULL AND status = 'ok') AS re_embedded FROM _st
""")
def q_update_report(spark, sf):
    m = td.memories(spark, sf)
    _, rep = lc.update_memories(m, _changes(m), td.as_of(), 64)
    return rep


@register("update_memories", CHANGES_SQL + f"""
SELECT m.memory_id, CASE WHEN s.status = 'ok' THEN coalesce(s.content, m.content) ELSE m.content END AS content,
       CASE WHEN s.status = 'ok' THEN coalesce(s.importance, m.importance) ELSE m.importance END AS importance,
       CASE WHEN s.status = 'ok' THEN {AS_OF_SQL} ELSE m.updated_at END AS updated_at
FROM memories m LEFT JOIN _st s USING (memory_id)
""")
def q_update(spark, sf):
    m = td.memories(spark, sf)
    out, _ = lc.update_memories(m, _changes(m), td.as_of(), 64)
    return out.select("memory_id", "content", "importance", "updated_at")


@register("set_embeddings", f"""
SELECT m.memory_id, round(CAST(CASE WHEN m.memory_category = 'procedural' THEN list_reverse(m.embedding) ELSE m.embedding END AS DOUBLE[])[1], 6) AS first_component,
       CASE WHEN m.memory_category = 'procedural' AND m.embedding IS NOT NULL THEN {AS_OF_SQL} ELSE m.updated_at END AS updated_at
FROM memories m
""")
def q_set_embeddings(spark, sf):
    m = td.memories(spark, sf)
    vec = m.where(F.col("memory_category") == "procedural").select("memory_id", F.reverse("embedding").alias("embedding"))
    out = lc.set_embeddings(m, vec, td.as_of())
    return out.select("memory_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_component"),
                      "updated_at")


DEL_SQL = "_dq AS (SELECT DISTINCT target_id AS memory_id, user_id FROM edges WHERE relationship = 'depends_on')"


def _del_reqs(spark, sf):
    return td.edges(spark, sf).where(F.col("relationship") == "depends_on").select(
        F.col("target_id").alias("memory_id"), "user_id")


@register("soft_delete", DEL_SQL + f"""
SELECT m.memory_id, CASE WHEN d.memory_id IS NOT NULL THEN {AS_OF_SQL} ELSE m.deleted_at END AS deleted_at,
       CASE WHEN d.memory_id IS NOT NULL THEN {AS_OF_SQL} ELSE m.updated_at END AS updated_at
FROM memories m LEFT JOIN _dq d USING (memory_id, user_id)
""")
def q_soft_delete(spark, sf):
    out = lc.soft_delete(td.memories(spark, sf), _del_reqs(spark, sf), td.as_of())
    return out.select("memory_id", "deleted_at", "updated_at")


@register("hard_delete", DEL_SQL + """
SELECT m.memory_id, m.user_id FROM memories m WHERE NOT EXISTS
  (SELECT 1 FROM _dq d WHERE d.memory_id = m.memory_id AND d.user_id = m.user_id)
""")
def q_hard_delete(spark, sf):
    return lc.hard_delete(td.memories(spark, sf), _del_reqs(spark, sf)).select("memory_id", "user_id")


FORGET_SQL = """
_fu AS (SELECT DISTINCT user_id FROM sessions WHERE total_tokens > 1000)
"""


def _forget(spark, sf):
    users = (td.sessions(spark, sf).where(F.col("total_tokens") > 1000)
             .select("user_id", F.lit("DELETE ALL MY DATA").alias("confirmation")))
    tables = {"memories": td.memories(spark, sf), "sessions": td.sessions(spark, sf),
              "items": td.items(spark, sf), "edges": td.edges(spark, sf), "access_log": td.access_log(spark, sf)}
    return lc.forget_users(tables, users)


@register("forget_users", FORGET_SQL + """
SELECT u.user_id, (SELECT count(*) FROM memories m WHERE m.user_id = u.user_id) AS memories_deleted,
       (SELECT count(*) FROM sessions s WHERE s.user_id = u.user_id) AS sessions_deleted
FROM _fu u
""")
def q_forget_users(spark, sf):
    return _forget(spark, sf)[1]


@register("forget_users_remaining", FORGET_SQL + """
SELECT 'memories' AS table_name, count(*) AS n FROM memories WHERE user_id NOT IN (SELECT user_id FROM _fu)
UNION ALL SELECT 'sessions', count(*) FROM sessions WHERE user_id NOT IN (SELECT user_id FROM _fu)
UNION ALL SELECT 'items', count(*) FROM items WHERE user_id NOT IN (SELECT user_id FROM _fu)
UNION ALL SELECT 'edges', count(*) FROM edges WHERE user_id NOT IN (SELECT user_id FROM _fu)
UNION ALL SELECT 'access_log', count(*) FROM access_log WHERE user_id NOT IN (SELECT user_id FROM _fu)
""")
def q_forget_remaining(spark, sf):
    tables, _ = _forget(spark, sf)
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SUP_SQL = f"""
_pairs AS (SELECT target_id AS old_id, source_id AS new_id, user_id FROM edges WHERE relationship = 'updates'),
_pe AS (
  SELECT p.*, CASE WHEN o.memory_id IS NULL THEN 'Old memory ' || p.old_id || ' not found or already deleted'
                   WHEN n.memory_id IS NULL THEN 'New memory ' || p.new_id || ' not found'
                   WHEN p.old_id = p.new_id THEN 'Memory ' || p.old_id || ' cannot supersede itself' END AS e0
  FROM _pairs p LEFT JOIN live o ON o.memory_id = p.old_id AND o.user_id = p.user_id
  LEFT JOIN live n ON n.memory_id = p.new_id AND n.user_id = p.user_id
),
_po AS (SELECT *, CASE WHEN e0 IS NULL THEN row_number() OVER (PARTITION BY old_id, e0 IS NULL ORDER BY new_id) END AS turn
        FROM _pe),
_pn AS (SELECT *, CASE WHEN turn = 1 THEN row_number() OVER w END AS place, CASE WHEN turn = 1 THEN min(old_id) OVER w END AS first_old
        FROM _po WINDOW w AS (PARTITION BY new_id, coalesce(turn = 1, false) ORDER BY old_id)),
_ps AS (
  SELECT old_id, new_id, user_id, CASE WHEN e0 IS NOT NULL THEN e0
         WHEN turn > 1 THEN 'Old memory ' || old_id || ' not found or already deleted'
         WHEN place > 1 THEN 'New memory ' || new_id || ' already supersedes ' || first_old END AS error
  FROM _pn
)
"""


def _sup(spark, sf):
    pairs = td.edges(spark, sf).where(F.col("relationship") == "updates").select(
        F.col("target_id").alias("old_id"), F.col("source_id").alias("new_id"), "user_id")
    return lc.supersede(td.memories(spark, sf), pairs, td.as_of())


@register("supersede_report", SUP_SQL + "SELECT old_id, new_id, user_id, error FROM _ps")
def q_supersede_report(spark, sf):
    return _sup(spark, sf)[1]


@register("supersede", SUP_SQL + f"""
, _ok AS (SELECT * FROM _ps WHERE error IS NULL),
_s AS (SELECT new_id AS memory_id, min(old_id) AS sup FROM _ok GROUP BY 1),
_d AS (SELECT DISTINCT old_id AS memory_id FROM _ok)
SELECT m.memory_id, coalesce(s.sup, m.supersedes) AS supersedes,
       CASE WHEN d.memory_id IS NOT NULL THEN {AS_OF_SQL} ELSE m.deleted_at END AS deleted_at
FROM memories m LEFT JOIN _s s USING (memory_id) LEFT JOIN _d d USING (memory_id)
""")
def q_supersede(spark, sf):
    return _sup(spark, sf)[0].select("memory_id", "supersedes", "deleted_at")


def _incoming(spark, sf):
    r = td.requests(spark, sf)
    m = td.memories(spark, sf).select(F.concat(F.lit("q"), F.substring("memory_id", 2, 10)).alias("request_id"),
                                      "memory_category", "memory_subtype", "summary", "importance", "entities")
    return r.join(m, "request_id").select("request_id", "user_id", "memory_category", "memory_subtype",
                                          F.col("query").alias("content"), "summary", "embedding", "importance",
                                          "entities")


@register("dedup_upsert")
def q_dedup_upsert(spark, sf):
    _, rep = lc.dedup_upsert(td.memories(spark, sf), _incoming(spark, sf), td.as_of(), t=0.45)
    return rep


@register("dedup_upsert_table")
def q_dedup_upsert_table(spark, sf):
    out, _ = lc.dedup_upsert(td.memories(spark, sf), _incoming(spark, sf), td.as_of(), t=0.45)
    return out.select("memory_id", "user_id", "access_count", "importance", "last_accessed")


def _to_store(spark, sf):
    v = F.substring("request_id", 2, 10).cast("int")
    return _incoming(spark, sf).drop("entities").withColumns({
        "memory_category": F.when(v % 4 != 0, F.col("memory_category")),
        "memory_subtype": F.when(v % 4 == 0, F.lit(None)).when(v % 9 == 1, "other").otherwise(F.col("memory_subtype"))})


@register("store_memories")
def q_store_memories(spark, sf):
    _, rep = lc.store_memories(td.memories(spark, sf), _to_store(spark, sf), td.as_of(), 64, t=0.45)
    return rep.withColumn("entities", F.array_join(F.array_sort("entities"), ","))


@register("reembed_stale")
def q_reembed(spark, sf):
    m = td.memories(spark, sf)
    m = m.withColumn("embedding", F.when(F.col("memory_category") == "episodic", F.lit(None).cast("array<float>"))
                     .otherwise(F.col("embedding")))
    cache = m.where(F.col("memory_subtype") == "decision").select(F.sha2("content", 256).alias("text_hash"),
                                            F.array_repeat(F.lit(0.125).cast("float"), 64).alias("embedding"))
    out = lc.reembed_stale(m, cache, 64)
    return out.select("memory_id", F.size("embedding").alias("dim"))


@register("checkpoint_candidates", f"""
_c AS (SELECT i.*, {_classify_sql("coalesce(i.content, '')")} FROM items i)
SELECT item_id, session_id, importance AS importance_cls FROM _c
WHERE NOT pinned AND token_count >= 20 AND relevance_score >= 0.3
  AND content_type NOT IN ('system', 'retrieved_memory') AND importance >= 0.4
""")
def q_checkpoint_candidates(spark, sf):
    it = td.items(spark, sf)
    c = classify(it, "content").withColumnRenamed("importance", "importance_cls")
    return lc.checkpoint_candidates(c).select("item_id", "session_id", "importance_cls")


@register("checkpoint")
def q_checkpoint(spark, sf):
    _, _, _, rep = lc.checkpoint(td.items(spark, sf), td.memories(spark, sf), td.sessions(spark, sf),
                                 td.as_of(), 64, t=0.9)
    return rep


@register("extract_memories")
def q_extract_memories(spark, sf):
    turns = td.read(spark, sf, "conversations").withColumn(
        "user_id", F.concat(F.lit("u"), ((F.col("conv_id") + 1) % td.N_USERS).cast("string")))
    _, rep = lc.extract_memories(turns, td.memories(spark, sf), td.as_of(), 64, t=0.9)
    return rep


ISSUE_SQL = """
_iss AS (
  SELECT user_id, CAST(substr(error_id, 2) AS INTEGER) AS sequence_num, error_id AS item_id,
         'ISSUE_LOG: ' || error_type || ' | ' || tool_name || ' failed | retry ' || tool_name AS content
  FROM errors
)
"""


def _issue_items(spark, sf):
    e = td.errors(spark, sf)
    return e.select("user_id", F.substring("error_id", 2, 12).cast("int").alias("sequence_num"),
                    F.col("error_id").alias("item_id"),
                    F.concat(F.lit("ISSUE_LOG: "), "error_type", F.lit(" | "), "tool_name", F.lit(" failed | retry "),
                             "tool_name").alias("content"))


@register("recurring_issues", ISSUE_SQL + """
, _p AS (
  SELECT user_id, trim(string_split_regex(regexp_extract(content, '^ISSUE_LOG:\\s*(.*)$', 1), '\\s*\\|\\s*')[1]) AS issue_type,
         trim(string_split_regex(regexp_extract(content, '^ISSUE_LOG:\\s*(.*)$', 1), '\\s*\\|\\s*')[-1]) AS resolution,
         sequence_num, item_id
  FROM _iss WHERE starts_with(content, 'ISSUE_LOG:')
)
SELECT user_id, issue_type, count(*) AS occurrences, arg_max(resolution, (sequence_num, item_id)) AS latest_resolution
FROM _p GROUP BY 1, 2 HAVING count(*) >= 3
""")
def q_recurring_issues(spark, sf):
    return lc.recurring_issues(_issue_items(spark, sf), 3)


# ---------------------------------------------------------------- oracles
def _dedup_sql(incoming: str, t: float) -> str:
    from .oracle import cosine
    return f"""
_incf AS (
  {incoming}
),
_k AS (
  SELECT i.request_id, m.memory_id, {cosine('i.embedding', 'm.embedding')} AS sim,
         row_number() OVER (PARTITION BY i.request_id ORDER BY {cosine('i.embedding', 'm.embedding')} DESC NULLS LAST,
                            m.importance DESC NULLS LAST, m.memory_id) AS r
  FROM _incf i JOIN live m ON m.user_id = i.user_id
),
_best AS (SELECT request_id, memory_id FROM _k WHERE r = 1 AND sim >= {t}),
_fresh AS (SELECT * FROM _incf WHERE request_id NOT IN (SELECT request_id FROM _best)),
_lead AS (
  SELECT a.request_id, min(b.request_id) AS first_id
  FROM _fresh a JOIN _fresh b ON a.user_id = b.user_id AND b.request_id < a.request_id
  WHERE {cosine('a.embedding', 'b.embedding')} >= {t} GROUP BY 1
),
_new AS (
  SELECT coalesce(l.first_id, f.request_id) AS leader, f.request_id, f.user_id, f.importance,
         l.first_id IS NOT NULL AS merged
  FROM _fresh f LEFT JOIN _lead l USING (request_id)
)
"""


def _attach():
    from .registry import attach_sql
    base = _dedup_sql("""SELECT r.request_id, r.user_id, r.embedding, m.importance
  FROM requests r JOIN memories m ON 'q' || substr(m.memory_id, 2) = r.request_id""", 0.45)
    attach_sql("dedup_upsert", base + """
SELECT request_id, 'updated' AS action, memory_id FROM _best
UNION ALL
SELECT request_id, CASE WHEN merged THEN 'merged' ELSE 'inserted' END, 'n-' || leader FROM _new
""")
    attach_sql("dedup_upsert_table", base + f"""
, _upd AS (
  SELECT b.memory_id, count(*) AS hits, arg_max(i.importance, b.request_id) AS imp
  FROM _best b JOIN _incf i USING (request_id) GROUP BY 1
),
_grp AS (SELECT leader, count(*) AS extra, arg_max(importance, request_id) AS imp FROM _new WHERE merged GROUP BY 1)
SELECT m.memory_id, m.user_id,
       CASE WHEN u.hits IS NOT NULL THEN m.access_count + CAST(u.hits AS INTEGER) ELSE m.access_count END AS access_count,
       CASE WHEN u.hits IS NOT NULL THEN u.imp ELSE m.importance END AS importance,
       CASE WHEN u.hits IS NOT NULL THEN {AS_OF_SQL} ELSE m.last_accessed END AS last_accessed
FROM memories m LEFT JOIN _upd u USING (memory_id)
UNION ALL
SELECT 'n-' || n.leader, n.user_id, CAST(coalesce(g.extra, 0) AS INTEGER),
       CASE WHEN g.extra IS NOT NULL THEN g.imp ELSE n.importance END,
       CASE WHEN g.extra IS NOT NULL THEN {AS_OF_SQL} END
FROM _new n LEFT JOIN _grp g USING (leader) WHERE NOT n.merged
""")
    attach_sql("store_memories", f"""
_g AS (WITH {_gate_sql("requests", "request_id", "query")}),
_cl AS (SELECT request_id, {_classify_sql("coalesce(query, '')")} FROM requests),
_rq AS (
  SELECT r.request_id, r.user_id, r.query AS content, r.embedding, c.entities, m.summary, g.error_message,
         coalesce(length(r.query), 0) = 0 AS empty,
         CASE WHEN v % 4 = 0 THEN c.memory_category ELSE m.memory_category END AS memory_category,
         CASE WHEN v % 4 = 0 THEN c.memory_subtype WHEN v % 9 = 1 THEN 'other' ELSE m.memory_subtype END AS memory_subtype,
         CASE WHEN v % 4 = 0 AND m.importance = 0.5 THEN c.importance ELSE m.importance END AS importance
  FROM (SELECT *, CAST(substr(request_id, 2) AS INTEGER) AS v FROM requests) r
  JOIN memories m ON 'q' || substr(m.memory_id, 2) = r.request_id
  JOIN _g g ON g.request_id = r.request_id JOIN _cl c ON c.request_id = r.request_id
),
_jd AS (
  SELECT *, CASE WHEN empty THEN 'invalid' WHEN error_message IS NOT NULL THEN 'refused'
                 WHEN (memory_category, memory_subtype) NOT IN (SELECT (memory_category, memory_subtype) FROM taxonomy)
                 THEN 'invalid' END AS bad
  FROM _rq
),
{_dedup_sql("SELECT request_id, user_id, embedding, importance FROM _jd WHERE bad IS NULL", 0.45)},
_st AS (
  SELECT request_id, 'updated' AS action, memory_id FROM _best
  UNION ALL
  SELECT request_id, CASE WHEN merged THEN 'merged' ELSE 'inserted' END, 'n-' || leader FROM _new
)
SELECT j.request_id, coalesce(j.bad, s.action) AS action, s.memory_id,
       CASE WHEN empty THEN 'no content' WHEN bad = 'refused' THEN error_message
            WHEN bad = 'invalid' THEN 'Subtype ' || memory_subtype || ' is not one of category ' || memory_category END AS message,
       CASE WHEN bad IS NULL THEN memory_category END AS memory_category,
       CASE WHEN bad IS NULL THEN memory_subtype END AS memory_subtype,
       CASE WHEN bad IS NULL THEN importance END AS importance,
       CASE WHEN bad IS NULL THEN entities END AS entities,
       CASE WHEN bad IS NULL AND length(content) // 4 > 50 THEN summary END AS summary,
       CASE WHEN bad IS NULL THEN CAST(length(content) // 4 AS INTEGER) END AS content_tokens
FROM _jd j LEFT JOIN _st s USING (request_id)
""")
    attach_sql("reembed_stale", "SELECT memory_id, 64 AS dim FROM memories")


_attach()
