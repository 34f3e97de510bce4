"""Registered queries: Structured Streaming jobs (2.13), run over all
available input (availableNow) into parquet sinks under the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_path
from ..sources import testdata as td
from ..streaming import jobs as sj
from .registry import register


@register("stream_ingest")
def q_stream_ingest(spark, sf):
    docs = sj.file_stream(spark, sf, "documents").withColumn("ts", F.timestamp_seconds(F.col("doc_id") + 1_700_000_000))
    root = shared_path(spark, f"ingest-{uuid.uuid4().hex}")
    w = sj.stream_ingest(docs, "doc_id", "text", "ts", f"{root}/accepted", f"{root}/rejected")
    q = w.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    # every micro-batch writes both folders, without rows too: one that cannot be read is a failure
    acc = spark.read.parquet(f"{root}/accepted").select("doc_id", F.lit(True).alias("accepted"))
    rej = spark.read.parquet(f"{root}/rejected").select("doc_id", F.lit(False).alias("accepted"))
    return acc.unionByName(rej)


@register("stream_working_memory")
def q_stream_working_memory(spark, sf):
    adds = td.items_from(sj.file_stream(spark, sf, "conversations"))
    events = sj.run_available(sj.stream_working_memory(adds, td.sessions(spark, sf)), "wm")
    return sj.final_item_status(events)


@register("stream_service_metrics")
def q_stream_service_metrics(spark, sf):
    m = td.metrics_from(sj.file_stream(spark, sf, "events"))
    return sj.run_available(sj.stream_service_metrics(m), "svc")


@register("stream_access_counts")
def q_stream_access_counts(spark, sf):
    log = td.access_log_from(sj.file_stream(spark, sf, "events"))
    out = sj.run_available(sj.stream_access_counts(log), "acc", mode="update")
    # latest running value per memory across micro-batches
    return out.groupBy("memory_id").agg(F.max("access_count").alias("access_count"),
                                        F.max("last_accessed").alias("last_accessed"))


# ---------------------------------------------------------------- oracles
def _attach():
    from .q_text import _gate_sql
    from .registry import attach_sql
    attach_sql("stream_access_counts", """
SELECT memory_id, count(*) AS access_count, max(accessed_at) AS last_accessed FROM access_log GROUP BY 1
""")
    attach_sql("stream_ingest", _gate_sql("documents", "doc_id", "text").rstrip().replace(
        "SELECT doc_id, violation_count, error_message, error_message IS NULL AS is_safe FROM _m",
        "SELECT doc_id, error_message IS NULL AS accepted FROM _m"))


_attach()


def _attach_replay():
    from .q_working import REPLAY_SQL
    from .registry import attach_sql
    attach_sql("stream_working_memory", REPLAY_SQL + "SELECT session_id, item_id, status FROM replayed")


_attach_replay()
