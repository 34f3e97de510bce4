"""Typed link graph between memories: upsert, symmetrise, unlink, neighbour
look-ups and similarity-based auto-linking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import RELATIONSHIPS, SYMMETRIC_RELATIONSHIPS
from .filters import live

EDGE_COLS = ["relationship_id", "source_id", "target_id", "user_id", "relationship", "strength", "context",
             "created_at", "created_by"]


def link(edges: DataFrame, reqs: DataFrame, memories: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """reqs (request_id, source_id, target_id, user_id, relationship,
    strength, context): both ends must be live rows of the user and the type
    known; a valid request updates relationship / strength / context of the
    existing (source, target, user) edge or inserts one.  Returns (edges
    after, report: request_id, status)."""
    own = live(memories).select("memory_id", "user_id")
    src = own.select(F.col("memory_id").alias("source_id"), "user_id", F.lit(True).alias("_s"))
    dst = own.select(F.col("memory_id").alias("target_id"), "user_id", F.lit(True).alias("_t"))
    r = reqs.join(src, ["source_id", "user_id"], "left").join(dst, ["target_id", "user_id"], "left")
    status = (F.when(~F.col("relationship").isin(RELATIONSHIPS), "invalid_relationship")
              .when(F.col("_s").isNull() | F.col("_t").isNull(), "not_found")
              .otherwise("ok"))
    rep = r.select("request_id", status.alias("status"))
    key = ["source_id", "target_id", "user_id"]
    w = Window.partitionBy(*key).orderBy(F.col("request_id").desc())
    good = (r.where(status == "ok").withColumn("_r", F.row_number().over(w)).where("_r = 1")
            .select(*key, "request_id", "relationship", F.coalesce("strength", F.lit(1.0)).alias("strength"),
                    "context"))
    old = edges.join(good.select(*key, F.col("relationship").alias("_rel"), F.col("strength").alias("_str"),
                                 F.col("context").alias("_ctx"), F.lit(True).alias("_hit")), key, "left")
    kept = old.select(*[
        F.when(F.col("_hit"), F.col("_rel")).otherwise(F.col("relationship")).alias("relationship")
        if c == "relationship" else
        F.when(F.col("_hit"), F.col("_str")).otherwise(F.col("strength")).alias("strength")
        if c == "strength" else
        F.when(F.col("_hit"), F.col("_ctx")).otherwise(F.col("context")).alias("context")
        if c == "context" else F.col(c) for c in EDGE_COLS])
    new = good.join(edges.select(*key), key, "left_anti").select(
        F.concat(F.lit("l-"), F.col("request_id")).alias("relationship_id"), *key, "relationship", "strength",
        "context", as_of.alias("created_at"), F.lit(None).cast("string").alias("created_by"))
    return kept.unionByName(new.select(*EDGE_COLS)), rep


def symmetrize(edges: DataFrame) -> DataFrame:
    """For symmetric types add the reverse edge unless some (target, source)
    edge of the user already exists."""
    rev = (edges.where(F.col("relationship").isin(SYMMETRIC_RELATIONSHIPS))
           .select(F.concat(F.col("relationship_id"), F.lit("-rev")).alias("relationship_id"),
                   F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"),
                   "user_id", "relationship", "strength", "context", "created_at", "created_by"))
    rev = rev.join(edges.select("source_id", "target_id", "user_id"), ["source_id", "target_id", "user_id"],
                   "left_anti")
    rev = rev.dropDuplicates(["source_id", "target_id", "user_id"])
    return edges.select(*EDGE_COLS).unionByName(rev.select(*EDGE_COLS))


def unlink(edges: DataFrame, reqs: DataFrame, both_directions: bool = True) -> DataFrame:
    """reqs (source_id, target_id, user_id): drop those edges (and the
    reverse ones when ``both_directions``)."""
    k = ["source_id", "target_id", "user_id"]
    drop = reqs.select(*k)
    if both_directions:
        drop = drop.unionByName(reqs.select(F.col("target_id").alias("source_id"),
                                            F.col("source_id").alias("target_id"), "user_id"))
    return edges.join(drop.distinct(), k, "left_anti")


def related(edges: DataFrame, memories: DataFrame, ids: DataFrame, types: list[str] | None = None,
            limit: int = 10) -> DataFrame:
    """ids (request_id, memory_id, user_id) -> up to ``limit`` linked live
    memories: the strongest outgoing edges, plus the strongest incoming ones
    whose other end is not already an outgoing neighbour; final order by
    strength desc, outgoing first, id."""
    e = edges if not types else edges.where(F.col("relationship").isin(types))
    q = ids.select("request_id", "memory_id", "user_id")
    out = (q.join(e.select(F.col("source_id").alias("memory_id"), "user_id",
                           F.col("target_id").alias("other_id"), "relationship", "strength"),
                  ["memory_id", "user_id"])
           .withColumn("direction", F.lit("outgoing")))
    inc = (q.join(e.select(F.col("target_id").alias("memory_id"), "user_id",
                           F.col("source_id").alias("other_id"), "relationship", "strength"),
                  ["memory_id", "user_id"])
           .withColumn("direction", F.lit("incoming")))
    w = Window.partitionBy("request_id").orderBy(F.col("strength").desc(), F.col("other_id"))
    out = out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")
    inc = inc.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")
    inc = inc.join(out.select("request_id", "other_id"), ["request_id", "other_id"], "left_anti")
    both = out.unionByName(inc)
    lv = live(memories).select(F.col("memory_id").alias("other_id"), "user_id", "content",
                               "memory_category", "memory_subtype")
    both = both.join(lv, ["other_id", "user_id"])
    wf = Window.partitionBy("request_id").orderBy(F.col("strength").desc(),
                                                   (F.col("direction") == "incoming").asc(), F.col("other_id"))
    return (both.withColumn("rank", F.row_number().over(wf)).where(F.col("rank") <= limit)
            .select("request_id", "memory_id", "other_id", "direction", "relationship", "strength", "rank",
                    "memory_category", "memory_subtype"))


def expand_related(recalled: DataFrame, edges: DataFrame, memories: DataFrame, per_row: int = 3) -> DataFrame:
    """recalled (request_id, user_id, memory_id, rank): per row its
    ``per_row`` strongest outgoing edges; targets already recalled for the
    request, not live, or already attached to a better-ranked row are
    dropped."""
    e = edges.select(F.col("source_id").alias("memory_id"), "user_id", "target_id", "relationship", "strength")
    cand = recalled.select("request_id", "user_id", "memory_id", "rank").join(e, ["memory_id", "user_id"])
    w = Window.partitionBy("request_id", "memory_id").orderBy(F.col("strength").desc(), F.col("target_id"))
    cand = cand.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_row)
    cand = cand.join(recalled.select("request_id", F.col("memory_id").alias("target_id")),
                     ["request_id", "target_id"], "left_anti")
    lv = live(memories).select(F.col("memory_id").alias("target_id"), "user_id", "content",
                               "memory_category", "memory_subtype")
    cand = cand.join(lv, ["target_id", "user_id"])
    w2 = Window.partitionBy("request_id", "target_id").orderBy("rank", "_r")
    return (cand.withColumn("_first", F.row_number().over(w2)).where("_first = 1")
            .select("request_id", "memory_id", "target_id", "relationship", "strength",
                    "memory_category", "memory_subtype"))


def auto_link(memories: DataFrame, edges: DataFrame, as_of: Column, t: float = 0.75, max_links: int = 5,
              block_rows: int | None = None) -> DataFrame:
    """Batch auto-linking.  Per live memory: its ``2 * max_links`` nearest
    live rows of the same user (itself may take a slot), then same category,
    not itself, similarity >= t and no existing (source, target) edge; the
    first ``max_links`` give related_to edges in both directions with
    strength round(sim, 4).  Set rule for a batch: proposals from both ends
    of a pair collapse to one edge per direction; existing edges win."""
    from ..plans.blocking import BLOCK_ROWS
    from .search import knn_exact
    lv = live(memories)
    q = lv.select(F.col("memory_id").alias("source_id"), "user_id", "embedding",
                  F.col("memory_category").alias("_qcat"))
    nn = knn_exact(q, lv, 2 * max_links, qid="source_id", qcarry=["_qcat"], carry=["memory_category"],
                   block_rows=block_rows or BLOCK_ROWS, score="similarity")
    nn = nn.where((F.col("memory_id") != F.col("source_id")) & (F.col("memory_category") == F.col("_qcat"))
                  & (F.col("similarity") >= t))
    nn = nn.withColumnRenamed("memory_id", "target_id")
    nn = nn.join(edges.select("source_id", "target_id", "user_id"), ["source_id", "target_id", "user_id"],
                 "left_anti")
    w = Window.partitionBy("source_id").orderBy("rank")
    nn = nn.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= max_links)
    strength = F.round("similarity", 4)
    ctx = F.concat(F.lit("Auto-linked by similarity ("), F.round("similarity", 2).cast("string"), F.lit(")"))
    fwd = nn.select("source_id", "target_id", "user_id", strength.alias("strength"), ctx.alias("context"))
    back = nn.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "user_id",
                     strength.alias("strength"), ctx.alias("context"))
    prop = fwd.unionByName(back)
    wk = Window.partitionBy("source_id", "target_id", "user_id").orderBy(F.col("strength").desc())
    prop = prop.withColumn("_d", F.row_number().over(wk)).where("_d = 1").drop("_d")
    prop = prop.join(edges.select("source_id", "target_id", "user_id"), ["source_id", "target_id", "user_id"],
                     "left_anti")
    return prop.select(F.concat(F.lit("a-"), F.col("source_id"), F.lit("-"), F.col("target_id")).alias("relationship_id"),
                       "source_id", "target_id", "user_id", F.lit("related_to").alias("relationship"),
                       "strength", "context", as_of.alias("created_at"),
                       F.lit("auto_link").alias("created_by"))
