"""Usage analytics over memories, sessions, logs and service metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.quantiles import order_stat
from ..plans.sizing import broadcast_fixed
from ..schemas import CATEGORIES
from .filters import live, preview


# Averages that are rounded for display are taken over exact decimals, so the
# result cannot depend on the (partition-dependent) order of a float sum.
EXACT = "decimal(20,6)"


def memory_counts(memories: DataFrame, sessions: DataFrame, items: DataFrame,
                  access_log: DataFrame) -> DataFrame:
    """Headline counters as (metric, value) rows."""
    m = memories.agg(F.count_if(F.col("deleted_at").isNull()).alias("live_memories"),
                     F.count(F.lit(1)).alias("all_memories"))
    s = sessions.agg(F.count(F.lit(1)).alias("sessions"))
    it = items.agg(F.count(F.lit(1)).alias("working_items"),
                   F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("working_tokens"))
    a = access_log.agg(F.count(F.lit(1)).alias("access_log_entries"))

    def long(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.map_from_arrays(
            F.array(*[F.lit(c) for c in df.columns]),
            F.array(*[F.col(c).cast("long") for c in df.columns]))).alias("metric", "value"))
    return long(m).unionByName(long(s)).unionByName(long(it)).unionByName(long(a))


def memory_counts_by_user(memories: DataFrame) -> DataFrame:
    return memories.groupBy("user_id").agg(
        F.count_if(F.col("deleted_at").isNull()).alias("live_memories"),
        F.count(F.lit(1)).alias("all_memories"))


def by_category(memories: DataFrame) -> DataFrame:
    """Live rows per category; every known category appears (zero if none)."""
    dim = memories.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "memory_category string")
    counts = live(memories).groupBy("memory_category").agg(F.count(F.lit(1)).alias("n"))
    known = broadcast_fixed(dim).join(counts, "memory_category", "left").select(
        "memory_category", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    other = counts.join(broadcast_fixed(dim), "memory_category", "left_anti")
    return known.unionByName(other)


def by_subtype(memories: DataFrame, user_id: str | None = None) -> DataFrame:
    m = live(memories)
    if user_id:
        m = m.where(F.col("user_id") == user_id)
    return m.groupBy("memory_category", "memory_subtype").agg(F.count(F.lit(1)).alias("n"))


def importance_bucket(col: Column) -> Column:
    return (F.when(col >= 0.8, "critical").when(col >= 0.6, "high")
            .when(col >= 0.4, "medium").otherwise("low"))


def by_importance(memories: DataFrame) -> DataFrame:
    return (live(memories).groupBy(importance_bucket(F.col("importance")).alias("priority"))
            .agg(F.count(F.lit(1)).alias("n")))


def with_entities(memories: DataFrame) -> DataFrame:
    """Per user: live rows whose entities is not NULL."""
    return live(memories).groupBy("user_id").agg(
        F.count_if(F.col("entities").isNotNull()).alias("memories_with_entities"))


def entity_frequency(memories: DataFrame) -> DataFrame:
    """How many live rows carry each entity."""
    e = live(memories).select(F.explode(F.array_distinct("entities")).alias("entity"))
    return e.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


def recent_created(memories: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    cutoff = F.timestamp_add("DAY", F.lit(-days), as_of)
    return live(memories).where(F.col("created_at") >= cutoff)


def top_accessed(memories: DataFrame, n: int = 5) -> DataFrame:
    """The n most accessed live rows (access desc, importance desc, id)."""
    top = live(memories).orderBy(F.col("access_count").desc(), F.col("importance").desc(),
                                 F.col("memory_id")).limit(n)
    return top.select(F.concat(F.left("memory_id", F.lit(8)), F.lit("...")).alias("memory_id_short"),
                      "memory_id", "memory_category", "access_count", "importance",
                      preview("content", 100).alias("content_preview"))


def recent_errors(errors: DataFrame, n: int = 20, tool: str | None = None) -> DataFrame:
    e = errors if tool is None else errors.where(F.col("tool_name") == tool)
    top = e.orderBy(F.col("created_at").desc(), F.col("error_id")).limit(n)
    return top.select(
        F.when(F.col("error_id").isNotNull(), F.concat(F.left("error_id", F.lit(8)), F.lit("...")))
         .alias("error_id"),
        "tool_name", "user_id", "error_type",
        preview("error_message", 200).alias("error_message"),
        preview("input_preview", 100).alias("input_preview"),
        "created_at")


def errors_by_tool(errors: DataFrame) -> DataFrame:
    return errors.groupBy("tool_name").agg(F.count(F.lit(1)).alias("n"))


def service_window(metrics: DataFrame, as_of: Column, minutes: int = 60) -> DataFrame:
    """Per service: calls / errors / avg latency (2 dp) / p95 latency (2 dp) /
    tokens inside the window (recorded_at > as_of - minutes), and all-time
    calls / errors.  p95 = sorted[int(0.95 n)] when n >= 20, else the max.
    Services with no call in the window report zeros (NULL averages)."""
    cutoff = F.timestamp_add("MINUTE", F.lit(-minutes), as_of)
    m = metrics.withColumn("_in", F.col("recorded_at") > cutoff)
    agg = m.groupBy("service").agg(
        F.count_if("_in").alias("calls_in_window"),
        F.count_if(F.col("_in") & ~F.col("success")).alias("errors_in_window"),
        F.round(F.avg(F.when(F.col("_in"), F.col("latency_ms")).cast(EXACT)), 2).cast("double").alias("avg_latency_ms"),
        F.coalesce(F.sum(F.when(F.col("_in"), F.col("tokens_in"))), F.lit(0)).cast("long").alias("tokens_in_window"),
        F.coalesce(F.sum(F.when(F.col("_in"), F.col("tokens_out"))), F.lit(0)).cast("long").alias("tokens_out_window"),
        F.count(F.lit(1)).alias("total_calls"),
        F.count_if(~F.col("success")).alias("total_errors"),
    )
    n = F.col("calls_in_window")
    targets = agg.where(n > 0).select(
        "service",
        F.when(n >= 20, F.floor(n * F.lit(0.95))).otherwise(n - 1).cast("long").alias("target"))
    p95 = order_stat(m.where("_in"), ["service"], "latency_ms", targets, out="p95")
    return (agg.join(p95, "service", "left")
            .withColumn("p95_latency_ms", F.round("p95", 2)).drop("p95"))


def service_by_operation(metrics: DataFrame, as_of: Column, minutes: int = 60) -> DataFrame:
    cutoff = F.timestamp_add("MINUTE", F.lit(-minutes), as_of)
    return (metrics.where(F.col("recorded_at") > cutoff)
            .groupBy("service", "operation")
            .agg(F.count(F.lit(1)).alias("count"),
                 F.count_if(~F.col("success")).alias("errors"),
                 F.avg("latency_ms").alias("avg_latency_ms")))


def recent_calls(metrics: DataFrame, n: int = 50) -> DataFrame:
    """Newest n calls per service (ties by metric_id)."""
    w = Window.partitionBy("service").orderBy(F.col("recorded_at").desc(), F.col("metric_id"))
    return (metrics.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select("service", "rank", "recorded_at", "operation", F.round("latency_ms", 2).alias("latency_ms"),
                    F.coalesce("tokens_in", F.lit(0)).alias("tokens_in"),
                    F.coalesce("tokens_out", F.lit(0)).alias("tokens_out"),
                    "success", F.col("error_msg").alias("error"), "metric_id"))


def recent_calls_feed(metrics: DataFrame, n: int = 50) -> DataFrame:
    """Merged feed: newest n calls across services (from per-service heads)."""
    heads = recent_calls(metrics, n)
    return heads.orderBy(F.col("recorded_at").desc(), F.col("metric_id")).limit(n).drop("rank")
