"""Registered queries: sources, sinks and loading (2.1)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_path
from ..sources import io
from ..sources import testdata as td
from .oracle import AS_OF_SQL
from .registry import register

VID_SQL = "CAST(substr(memory_id, 2) AS INTEGER)"


def _vid():
    return F.substring("memory_id", 2, 10).cast("int")


def _raw_memories(spark, sf):
    m = td.memories(spark, sf)
    v = _vid()
    return (m.withColumn("importance", F.when(v % 4 == 0, F.lit(None).cast("double")).otherwise(F.col("importance")))
             .withColumn("access_count", F.when(v % 5 == 0, F.lit(None).cast("int")).otherwise(F.col("access_count")))
             .withColumn("last_accessed", F.col("last_accessed"))
             .withColumn("entities", F.when(v % 6 == 0, F.array_union(F.coalesce("entities", F.array().cast("array<string>")),
                                                                      F.array(F.lit(" "), F.lit(" tool:x "))))
                         .otherwise(F.col("entities"))))


@register("normalize_memories", f"""
_raw AS (
  SELECT memory_id, CASE WHEN {VID_SQL} % 4 = 0 THEN NULL ELSE importance END AS importance,
         CASE WHEN {VID_SQL} % 5 = 0 THEN NULL ELSE access_count END AS access_count,
         confidence, source_type, event_time, last_accessed,
         CASE WHEN {VID_SQL} % 6 = 0 THEN list_distinct(list_concat(coalesce(entities, CAST([] AS VARCHAR[])), [' ', ' tool:x ']))
              ELSE entities END AS entities
  FROM memories
)
SELECT memory_id, coalesce(importance, 0.5) AS importance, CAST(coalesce(access_count, 0) AS INTEGER) AS access_count,
       coalesce(confidence, 1.0) AS confidence, coalesce(source_type, 'conversation') AS source_type,
       event_time IS NOT NULL AS is_temporal, coalesce(last_accessed, {AS_OF_SQL}) AS last_accessed,
       array_to_string(list_sort(list_filter(list_transform(coalesce(entities, CAST([] AS VARCHAR[])), lambda x: trim(x)),
                                             lambda x: x IS NOT NULL AND x <> '')), '|') AS entities
FROM _raw
""")
def q_normalize_memories(spark, sf):
    out = io.normalize_memories(_raw_memories(spark, sf), td.as_of())
    return out.select("memory_id", "importance", "access_count", "confidence", "source_type", "is_temporal",
                      "last_accessed", F.array_join(F.array_sort("entities"), "|").alias("entities"))


@register("normalize_entities", f"""
_t AS (
  SELECT memory_id, CASE WHEN {VID_SQL} % 2 = 0 THEN array_to_string(entities, ' , ')
                         ELSE '{{' || array_to_string(entities, ',') || '}}' END AS raw
  FROM memories
)
SELECT memory_id, array_to_string(list_filter(list_transform(string_split(
         regexp_replace(coalesce(raw, ''), '^\\s*\\{{|\\}}\\s*$', '', 'g'), ','), lambda x: trim(x)), lambda x: x <> ''), '|')
       AS entities
FROM _t
""")
def q_normalize_entities(spark, sf):
    m = td.memories(spark, sf)
    raw = F.when(_vid() % 2 == 0, F.array_join("entities", " , ")).otherwise(
        F.concat(F.lit("{"), F.array_join("entities", ","), F.lit("}")))
    out = io.normalize_entities(m.select("memory_id", raw.alias("raw")), "raw", "ents")
    return out.select("memory_id", F.array_join("ents", "|").alias("entities"))


@register("insert_or_replace", f"""
_d AS (SELECT memory_id, user_id, importance + 1 AS importance FROM memories WHERE importance >= 0.8
       UNION ALL SELECT 'x' || request_id, user_id, 0.5 FROM requests WHERE intent = 'debug')
SELECT memory_id, user_id, importance FROM memories WHERE memory_id NOT IN (SELECT memory_id FROM _d)
UNION ALL SELECT * FROM _d
""")
def q_insert_or_replace(spark, sf):
    m = td.memories(spark, sf).select("memory_id", "user_id", "importance")
    r = td.requests(spark, sf)
    delta = (m.where(F.col("importance") >= 0.8).withColumn("importance", F.col("importance") + 1)
             .unionByName(r.where(F.col("intent") == "debug")
                          .select(F.concat(F.lit("x"), "request_id").alias("memory_id"), "user_id",
                                  F.lit(0.5).alias("importance"))))
    return io.insert_or_replace(m, delta, "memory_id")


@register("parity_check", f"""
_p AS (SELECT memory_id, user_id, importance, access_count FROM memories),
_s AS (SELECT memory_id, user_id, CASE WHEN memory_subtype = 'project' THEN importance + 0.01 ELSE importance END AS importance,
              access_count FROM memories WHERE memory_category <> 'preference'
       UNION ALL SELECT 'extra-' || memory_id, user_id, importance, access_count FROM memories
       WHERE memory_subtype = 'decision')
SELECT coalesce(p.memory_id, s.memory_id) AS memory_id,
       CASE WHEN s.memory_id IS NULL THEN 'missing_in_secondary' WHEN p.memory_id IS NULL THEN 'missing_in_primary'
            ELSE 'different' END AS status
FROM _p p FULL OUTER JOIN _s s ON p.memory_id = s.memory_id
WHERE s.memory_id IS NULL OR p.memory_id IS NULL OR p.user_id IS DISTINCT FROM s.user_id
   OR p.importance IS DISTINCT FROM s.importance OR p.access_count IS DISTINCT FROM s.access_count
""")
def q_parity_check(spark, sf):
    full = td.memories(spark, sf)
    sec = (full.where(F.col("memory_category") != "preference")
           .withColumn("importance", F.when(F.col("memory_subtype") == "project", F.col("importance") + 0.01)
                       .otherwise(F.col("importance")))
           .unionByName(full.where(F.col("memory_subtype") == "decision")
                        .withColumn("memory_id", F.concat(F.lit("extra-"), "memory_id"))))
    return io.parity_check(full, sec, "memory_id")


BACKUP_SQL = f"""
_b AS (
  SELECT memory_id, CASE WHEN memory_category = 'semantic' THEN updated_at - INTERVAL 1 DAY ELSE updated_at END AS updated_at
  FROM memories WHERE created_at < TIMESTAMP '2024-05-01 00:00:00'
),
_new AS (SELECT m.memory_id, m.updated_at FROM memories m WHERE m.memory_id NOT IN (SELECT memory_id FROM _b)),
_newer AS (SELECT m.memory_id, m.updated_at FROM memories m JOIN _b b USING (memory_id) WHERE m.updated_at > b.updated_at)
"""


def _backup(spark, sf):
    m = td.memories(spark, sf)
    b = (m.where(F.col("created_at") < td.ts("2024-05-01 00:00:00"))
         .withColumn("updated_at", F.when(F.col("memory_category") == "semantic",
                                          F.timestamp_add("DAY", F.lit(-1), "updated_at"))
                                        .otherwise(F.col("updated_at"))))
    return io.incremental_backup(m, b)


@register("incremental_backup", BACKUP_SQL + """
SELECT memory_id, updated_at FROM _b WHERE memory_id NOT IN (SELECT memory_id FROM _newer)
UNION ALL SELECT * FROM _new UNION ALL SELECT * FROM _newer
""")
def q_incremental_backup(spark, sf):
    return _backup(spark, sf)[0].select("memory_id", "updated_at")


@register("incremental_backup_report", BACKUP_SQL + """
SELECT 'added' AS kind, count(*) AS n FROM _new UNION ALL SELECT 'refreshed', count(*) FROM _newer
""")
def q_incremental_backup_report(spark, sf):
    return _backup(spark, sf)[1]


@register("seed_if_absent", """
_seeds AS (
  SELECT CASE WHEN CAST(substr(request_id, 2) AS INTEGER) % 2 = 0 THEN 'u' || CAST(CAST(substr(request_id, 2) AS INTEGER) % 8 AS VARCHAR)
              ELSE user_id END AS user_id, left(query, 80) AS summary, request_id
  FROM requests
)
SELECT s.request_id, s.user_id, s.summary FROM _seeds s
WHERE NOT EXISTS (SELECT 1 FROM live m WHERE m.user_id = s.user_id AND m.summary = s.summary)
""")
def q_seed_if_absent(spark, sf):
    r = td.requests(spark, sf)
    n = F.substring("request_id", 2, 10).cast("int")
    seeds = r.select("request_id", F.when(n % 2 == 0, F.concat(F.lit("u"), (n % 8).cast("string")))
                     .otherwise(F.col("user_id")).alias("user_id"), F.col("query").alias("content"))
    # the same seed is the same whole text; its first 80 characters are only shown
    new = io.seed_if_absent(td.memories(spark, sf), seeds, text="content")
    return new.select("request_id", "user_id", F.left("content", F.lit(80)).alias("summary"))


@register("storage_estimate")
def q_storage_estimate(spark, sf):
    return io.storage_estimate({"memories": td.memories(spark, sf), "sessions": td.sessions(spark, sf),
                                "items": td.items(spark, sf), "edges": td.edges(spark, sf),
                                "access_log": td.access_log(spark, sf), "errors": td.errors(spark, sf),
                                "metrics": td.metrics(spark, sf)})


@register("append_rows")
def q_append_rows(spark, sf):
    path = shared_path(spark, f"append-{uuid.uuid4().hex}")
    m = td.memories(spark, sf).drop("embedding")
    io.append_rows(m, path)
    io.append_rows(m.where(F.col("memory_category") == "semantic"), path)
    return spark.read.parquet(path).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@register("write_snapshot")
def q_write_snapshot(spark, sf):
    root = shared_path(spark, f"snap-{uuid.uuid4().hex}")
    m = td.memories(spark, sf).select("memory_id", "user_id", "importance")
    io.write_snapshot(m, root)
    io.write_snapshot(io.read_current(spark, root).withColumn("importance", F.col("importance") / 2), root)
    return io.read_current(spark, root)


@register("mirror_write")
def q_mirror_write(spark, sf):
    a = shared_path(spark, f"mirror-a-{uuid.uuid4().hex}")
    b = shared_path(spark, f"mirror-b-{uuid.uuid4().hex}")
    io.mirror_write(td.memories(spark, sf), a, b)
    return io.parity_check(spark.read.parquet(a), spark.read.parquet(b), "memory_id") \
        .unionByName(spark.read.parquet(b).select("memory_id", F.lit("copied").alias("status")))


@register("export_user_memories")
def q_export(spark, sf):
    path = shared_path(spark, f"export-{uuid.uuid4().hex}")
    users = td.sessions(spark, sf).where(F.col("total_tokens") > 1000).select("user_id")
    io.export_user_memories(td.memories(spark, sf), users, path)
    return spark.read.json(path).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- oracles
def _attach():
    from .registry import attach_sql
    attach_sql("append_rows", f"""
SELECT user_id, count(*) + count(*) FILTER (WHERE memory_category = 'semantic') AS n FROM memories GROUP BY 1
""")
    attach_sql("export_user_memories", """
SELECT user_id, count(*) AS n FROM memories
WHERE user_id IN (SELECT user_id FROM sessions WHERE total_tokens > 1000) GROUP BY 1
""")
    attach_sql("write_snapshot", "SELECT memory_id, user_id, importance / 2 AS importance FROM memories")
    attach_sql("mirror_write", "SELECT memory_id, 'copied' AS status FROM memories")


_attach()
