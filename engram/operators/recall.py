"""End-to-end recall for a table of requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.blocking import BLOCK_ROWS
from .filters import taxonomy_filter, temporal_tag_filter
from .search import entity_boost, entity_matches, knn_exact

RECALL_CARRY = ["memory_category", "memory_subtype", "entities", "access_count", "content", "summary"]


def recall(requests: DataFrame, memories: DataFrame, limit: int = 10, min_similarity: float = 0.2, *,
           focus_col: str = "focus_entities", categories: Sequence[str] | None = None,
           subtypes: Sequence[str] | None = None, after=None, before=None, tags: Sequence[str] | None = None,
           min_confidence: float | None = None, time_col: str = "created_at", block_rows: int | None = BLOCK_ROWS,
           carry: Sequence[str] = ("memory_category", "memory_subtype", "entities")) -> DataFrame:
    """Per request: fetch ``3 * limit`` nearest live rows of the requester,
    drop those under ``min_similarity``, boost by matching focus entities
    (min(1, s (1 + 0.2 m))), order by the rounded effective similarity (fetch
    order breaks ties) and keep ``limit``.  Scores are rounded to 4 dp.

    Filters on category, subtype, time (``after <= time_col < before``), tags (any
    of them) and confidence are applied before the search, so ``limit`` rows come
    back wherever that many qualify.  A NULL never passes a filter that is set."""
    mem = temporal_tag_filter(taxonomy_filter(memories, categories, subtypes), after, before, tags,
                              min_confidence, time_col)
    carry = list(dict.fromkeys(list(carry) + ["entities"]))
    hits = knn_exact(requests, mem, 3 * limit, carry=carry, block_rows=block_rows,
                     score="similarity", rank="fetch_rank", qcarry=[focus_col])
    hits = hits.where(F.col("similarity") >= F.lit(float(min_similarity)))
    m = entity_matches(focus_col, "entities")
    hits = (hits.withColumn("entity_matches", m)
            .withColumn("effective_similarity", F.round(entity_boost("similarity", m, "recall"), 4))
            .withColumn("similarity", F.round("similarity", 4)))
    w = Window.partitionBy("request_id").orderBy(F.col("effective_similarity").desc(), F.col("fetch_rank"))
    out = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return out.drop(focus_col)


def retrieval_breakdown(recalled: DataFrame, qid: str = "request_id") -> DataFrame:
    """Per request: counts by category, by subtype, the total and the number
    of rows with an entity match, from ONE grouping-sets aggregate (a single
    shuffle).  Output rows: (qid, dimension, value, n) with dimension in
    {category, subtype, total, entity_matches}."""
    g = (recalled.groupingSets([[qid, "memory_category"], [qid, "memory_subtype"], [qid]],
                               qid, "memory_category", "memory_subtype")
         .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("entity_matches") > 0).alias("em"),
              F.grouping_id().alias("gid")))
    # grouping_id bits (category, subtype): 1 -> by category, 2 -> by subtype, 3 -> per request
    null = F.lit(None).cast("string")
    rows = (F.when(F.col("gid") == 1, F.array(F.struct(F.lit("category").alias("dimension"),
                                                      F.col("memory_category").alias("value"), F.col("n").alias("n"))))
            .when(F.col("gid") == 2, F.array(F.struct(F.lit("subtype").alias("dimension"),
                                                     F.col("memory_subtype").alias("value"), F.col("n").alias("n"))))
            .otherwise(F.array(F.struct(F.lit("total").alias("dimension"), null.alias("value"), F.col("n").alias("n")),
                               F.struct(F.lit("entity_matches").alias("dimension"), null.alias("value"),
                                        F.col("em").alias("n")))))
    return g.select(qid, F.explode(rows).alias("r")).select(qid, "r.dimension", "r.value", "r.n")


def bump_access(memories: DataFrame, recalled: DataFrame, as_of: Column) -> DataFrame:
    """access_count += number of times each row was returned; last_accessed
    = as_of for returned rows.  Returns the whole table."""
    hits = recalled.groupBy("memory_id").agg(F.count(F.lit(1)).cast("int").alias("_hits"))
    j = memories.join(hits, "memory_id", "left")
    return j.select(
        *[F.when(F.col("_hits").isNotNull(), F.col("access_count") + F.col("_hits"))
           .otherwise(F.col("access_count")).alias("access_count") if c == "access_count"
          else F.when(F.col("_hits").isNotNull(), as_of).otherwise(F.col("last_accessed")).alias("last_accessed")
          if c == "last_accessed" else F.col(c)
          for c in memories.columns])


def log_access(selected: DataFrame, as_of: Column, query_col: str = "query",
               max_chars: int | None = None) -> DataFrame:
    """Access-log rows for selected memories, with the whole query text (or its
    first ``max_chars`` characters, if the log must stay narrow)."""
    return selected.select(
        F.expr("uuid()").alias("access_id"), "memory_id", "session_id", "user_id",
        (F.left(F.col(query_col), F.lit(max_chars)) if max_chars else F.col(query_col)).alias("query_text"),
        F.col("similarity").cast("double").alias("similarity_score"),
        F.lit(None).cast("boolean").alias("was_useful"),
        F.lit(None).cast("boolean").alias("was_used"),
        as_of.alias("accessed_at"))
