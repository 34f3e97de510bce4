"""Registered queries: link graph (2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import links as lk
from ..operators import recall as rc
from ..schemas import RELATIONSHIPS
from ..sources import testdata as td
from .oracle import AS_OF_SQL, cosine
from .q_search import RECALL_SQL
from .registry import register

T_LINK = 0.3
_REL6 = RELATIONSHIPS + ["mentions"]
_REL_CASE = "CASE {v} % 6 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_REL6)) + " END"


def _link_reqs(spark, sf):
    m = td.memories(spark, sf)
    v = F.substring("memory_id", 2, 10).cast("int")
    rel = None
    for i, r in enumerate(_REL6):
        rel = F.when(v % 6 == i, F.lit(r)) if rel is None else rel.when(v % 6 == i, F.lit(r))
    step = F.when(v % 2 == 0, F.lit(8)).otherwise(F.lit(16))
    return m.select(F.concat(F.lit("k"), "memory_id").alias("request_id"), F.col("memory_id").alias("source_id"),
                    F.concat(F.lit("m"), F.lpad((v + step).cast("string"), 6, "0")).alias("target_id"),
                    "user_id", rel.alias("relationship"), F.lit(0.5).alias("strength"),
                    F.lit("linked by request").alias("context"))


LINK_SQL = f"""
_lr AS (
  SELECT 'k' || memory_id AS request_id, memory_id AS source_id,
         'm' || lpad(CAST(CAST(substr(memory_id, 2) AS INTEGER) + CASE WHEN CAST(substr(memory_id, 2) AS INTEGER) % 2 = 0
                    THEN 8 ELSE 16 END AS VARCHAR), 6, '0') AS target_id,
         user_id, {_REL_CASE.format(v='CAST(substr(memory_id, 2) AS INTEGER)')} AS relationship,
         0.5 AS strength, 'linked by request' AS context
  FROM memories
),
_ls AS (
  SELECT r.*, CASE WHEN r.relationship NOT IN ({", ".join(f"'{x}'" for x in RELATIONSHIPS)}) THEN 'invalid_relationship'
                   WHEN s.memory_id IS NULL OR t.memory_id IS NULL THEN 'not_found' ELSE 'ok' END AS status
  FROM _lr r LEFT JOIN live s ON s.memory_id = r.source_id AND s.user_id = r.user_id
  LEFT JOIN live t ON t.memory_id = r.target_id AND t.user_id = r.user_id
),
_good AS (SELECT * FROM _ls WHERE status = 'ok')
"""


@register("link_report", LINK_SQL + "SELECT request_id, status FROM _ls")
def q_link_report(spark, sf):
    _, rep = lk.link(td.edges(spark, sf), _link_reqs(spark, sf), td.memories(spark, sf), td.as_of())
    return rep


@register("link", LINK_SQL + f"""
SELECT e.relationship_id, e.source_id, e.target_id, e.user_id,
       CASE WHEN g.request_id IS NOT NULL THEN g.relationship ELSE e.relationship END AS relationship,
       CASE WHEN g.request_id IS NOT NULL THEN g.strength ELSE e.strength END AS strength,
       CASE WHEN g.request_id IS NOT NULL THEN g.context ELSE e.context END AS context
FROM edges e LEFT JOIN _good g USING (source_id, target_id, user_id)
UNION ALL
SELECT 'l-' || g.request_id, g.source_id, g.target_id, g.user_id, g.relationship, g.strength, g.context
FROM _good g WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.source_id = g.source_id AND e.target_id = g.target_id
                                                    AND e.user_id = g.user_id)
""")
def q_link(spark, sf):
    out, _ = lk.link(td.edges(spark, sf), _link_reqs(spark, sf), td.memories(spark, sf), td.as_of())
    return out.select("relationship_id", "source_id", "target_id", "user_id", "relationship", "strength", "context")


@register("symmetrize", """
SELECT relationship_id, source_id, target_id, user_id, relationship, strength FROM edges
UNION ALL
SELECT relationship_id || '-rev', target_id, source_id, user_id, relationship, strength FROM edges e
WHERE relationship IN ('related_to', 'contradicts')
  AND NOT EXISTS (SELECT 1 FROM edges x WHERE x.source_id = e.target_id AND x.target_id = e.source_id
                                          AND x.user_id = e.user_id)
""")
def q_symmetrize(spark, sf):
    return lk.symmetrize(td.edges(spark, sf)).select("relationship_id", "source_id", "target_id", "user_id",
                                                     "relationship", "strength")


@register("unlink", """
_u AS (SELECT source_id, target_id, user_id FROM edges WHERE strength < 0.2
       UNION SELECT target_id, source_id, user_id FROM edges WHERE strength < 0.2)
SELECT e.relationship_id, e.source_id, e.target_id FROM edges e
WHERE NOT EXISTS (SELECT 1 FROM _u u WHERE u.source_id = e.source_id AND u.target_id = e.target_id AND u.user_id = e.user_id)
""")
def q_unlink(spark, sf):
    e = td.edges(spark, sf)
    return lk.unlink(e, e.where(F.col("strength") < 0.2)).select("relationship_id", "source_id", "target_id")


@register("related", """
_ids AS (SELECT 'r' || memory_id AS request_id, memory_id, user_id FROM live),
_o AS (
  SELECT i.request_id, i.memory_id, i.user_id, e.target_id AS other_id, e.relationship, e.strength, 'outgoing' AS direction,
         row_number() OVER (PARTITION BY i.request_id ORDER BY e.strength DESC, e.target_id) AS r
  FROM _ids i JOIN edges e ON e.source_id = i.memory_id AND e.user_id = i.user_id
),
_i AS (
  SELECT i.request_id, i.memory_id, i.user_id, e.source_id AS other_id, e.relationship, e.strength, 'incoming' AS direction,
         row_number() OVER (PARTITION BY i.request_id ORDER BY e.strength DESC, e.source_id) AS r
  FROM _ids i JOIN edges e ON e.target_id = i.memory_id AND e.user_id = i.user_id
),
_b AS (
  SELECT * FROM _o WHERE r <= 10
  UNION ALL
  SELECT * FROM _i WHERE r <= 10 AND NOT EXISTS (SELECT 1 FROM _o WHERE _o.r <= 10 AND _o.request_id = _i.request_id
                                                                   AND _o.other_id = _i.other_id)
),
_l AS (
  SELECT b.*, m.memory_category, m.memory_subtype,
         row_number() OVER (PARTITION BY b.request_id ORDER BY b.strength DESC, b.direction = 'incoming', b.other_id) AS rank
  FROM _b b JOIN live m ON m.memory_id = b.other_id AND m.user_id = b.user_id
)
SELECT request_id, memory_id, other_id, direction, relationship, strength, CAST(rank AS INTEGER) AS rank,
       memory_category, memory_subtype
FROM _l WHERE rank <= 10
""")
def q_related(spark, sf):
    m = td.memories(spark, sf)
    ids = m.where(F.col("deleted_at").isNull()).select(F.concat(F.lit("r"), "memory_id").alias("request_id"),
                                                       "memory_id", "user_id")
    return lk.related(td.edges(spark, sf), m, ids, limit=10)


@register("expand_related", RECALL_SQL + """
, _c AS (
  SELECT r.request_id, r.user_id, r.memory_id, r.final_rank, e.target_id, e.relationship, e.strength,
         row_number() OVER (PARTITION BY r.request_id, r.memory_id ORDER BY e.strength DESC, e.target_id) AS rr
  FROM recalled r JOIN edges e ON e.source_id = r.memory_id AND e.user_id = r.user_id
),
_d AS (
  SELECT c.*, m.memory_category, m.memory_subtype,
         row_number() OVER (PARTITION BY c.request_id, c.target_id ORDER BY c.final_rank, c.rr) AS f
  FROM _c c JOIN live m ON m.memory_id = c.target_id AND m.user_id = c.user_id
  WHERE c.rr <= 3 AND NOT EXISTS (SELECT 1 FROM recalled x WHERE x.request_id = c.request_id AND x.memory_id = c.target_id)
)
SELECT request_id, memory_id, target_id, relationship, strength, memory_category, memory_subtype FROM _d WHERE f = 1
""")
def q_expand_related(spark, sf):
    m = td.memories(spark, sf)
    rec = rc.recall(td.requests(spark, sf), m, limit=10, min_similarity=0.2)
    return lk.expand_related(rec, td.edges(spark, sf), m)


@register("auto_link", f"""
_q AS (SELECT memory_id AS source_id, user_id, embedding, memory_category AS qcat FROM live),
_n AS (
  SELECT q.source_id, q.user_id, q.qcat, m.memory_id AS target_id, m.memory_category, m.importance,
         {cosine('q.embedding', 'm.embedding')} AS similarity
  FROM _q q JOIN live m ON m.user_id = q.user_id
),
_nr AS (
  SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY similarity DESC NULLS LAST, importance DESC NULLS LAST,
                                                               target_id) AS rank
  FROM _n
),
_f AS (
  SELECT * FROM _nr n WHERE rank <= 10 AND target_id <> source_id AND memory_category = qcat AND similarity >= {T_LINK}
    AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.source_id = n.source_id AND e.target_id = n.target_id
                                          AND e.user_id = n.user_id)
),
_k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY rank) AS k FROM _f),
_p AS (
  SELECT source_id, target_id, user_id, round(similarity, 4) AS strength,
         'Auto-linked by similarity (' || CAST(round(similarity, 2) AS VARCHAR) || ')' AS context FROM _k WHERE k <= 5
  UNION ALL
  SELECT target_id, source_id, user_id, round(similarity, 4),
         'Auto-linked by similarity (' || CAST(round(similarity, 2) AS VARCHAR) || ')' FROM _k WHERE k <= 5
),
_pd AS (
  SELECT *, row_number() OVER (PARTITION BY source_id, target_id, user_id ORDER BY strength DESC) AS d FROM _p
)
SELECT 'a-' || source_id || '-' || target_id AS relationship_id, source_id, target_id, user_id,
       'related_to' AS relationship, strength, context, {AS_OF_SQL} AS created_at, 'auto_link' AS created_by
FROM _pd p WHERE d = 1 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.source_id = p.source_id
                                       AND e.target_id = p.target_id AND e.user_id = p.user_id)
""")
def q_auto_link(spark, sf):
    return lk.auto_link(td.memories(spark, sf), td.edges(spark, sf), td.as_of(), t=T_LINK, max_links=5)
