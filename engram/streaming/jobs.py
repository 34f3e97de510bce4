"""Structured Streaming versions of the naturally unbounded processes:
ingestion with secret gating, per-session working-memory state, trailing
service metrics and running access counts.

Every job reads a stream and returns a configured ``DataStreamWriter`` (or
starts it with ``run_available``), so callers choose trigger, sink and
checkpoint location; checkpoints belong in the shared folder named by
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import working
from ..operators.gating import gate_secrets
from ..operators.working import fold_adds
from ..session import shared_path


def file_stream(spark: SparkSession, folder: str, name: str, max_files: int | None = None) -> DataFrame:
    """Stream the table ``name``.parquet of ``folder``, a file or a folder of
    files (schema from a batch read of the same table).

    Without ``max_files`` a trigger takes all files that are there.  Files are
    in no order of time or sequence, so whatever depends on that order (sessions,
    watermarks) is right over a table of several files only when one batch has
    them all."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        stream = stream.option("maxFilesPerTrigger", max_files)
    # a pattern may match a file or a folder; a plain path may only be a folder
    return stream.parquet(f"{path[:-1]}[{path[-1]}]")


def stream_ingest(events: DataFrame, id_col: str, text_col: str, time_col: str,
                  accepted_path: str, rejected_path: str, watermark: str = "1 hour"):
    """Secret-gate a stream of stores.  Repeated ids inside the watermark are
    dropped; each micro-batch appends safe rows to ``accepted_path`` and
    blocked rows (with the reason) to ``rejected_path``."""
    ev = events.withColumn(time_col, F.col(time_col).cast("timestamp"))
    dedup = ev.withWatermark(time_col, watermark).dropDuplicatesWithinWatermark([id_col])
    gated = gate_secrets(dedup, text_col)

    def sink(batch: DataFrame, epoch: int) -> None:
        # judged and deduplicated once for both writes
        batch = batch.persist(StorageLevel.DISK_ONLY)
        batch.where("is_safe").drop("is_safe", "error_message").write.mode("append").parquet(accepted_path)
        batch.where(~F.col("is_safe")).write.mode("append").parquet(rejected_path)
        batch.unpersist()
    return gated.writeStream.foreachBatch(sink)


WM_STATE = T.StructType([T.StructField("live_json", T.StringType()), T.StructField("total", T.LongType())])
WM_OUT = T.StructType([
    T.StructField("session_id", T.StringType()), T.StructField("item_id", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("evicted_by", T.StringType()),
    T.StructField("total_after", T.LongType()),
])


def _wm_step(key, pdfs, state):
    if state.exists:
        live_json, total = state.get
        live = {k: tuple(v) for k, v in json.loads(live_json).items()}
    else:
        live, total = {}, 0
    batch = pd.concat(list(pdfs), ignore_index=True).sort_values(["sequence_num", "item_id"])
    max_tokens = int(batch["max_tokens"].iloc[0])
    live, total, events = fold_adds(live, int(total), max_tokens, batch.itertuples(index=False))
    state.update((json.dumps(live), int(total)))
    yield pd.DataFrame({
        "session_id": key[0],
        "item_id": [e[0] for e in events],
        "status": [e[1] for e in events],
        "evicted_by": [e[2] for e in events],
        "total_after": int(total),
    })


class SessionWorkingMemory(StatefulProcessor):
    """transformWithState processor: per session, the live items and the
    token total live in one value state (RocksDB-backed); each micro-batch
    of adds is folded in sequence order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("live", "live_json string, total long")

    def handleInputRows(self, key, rows, timerValues):
        if self.state.exists():
            live_json, total = self.state.get()
            live = {k: tuple(v) for k, v in json.loads(live_json).items()}
        else:
            live, total = {}, 0
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["sequence_num", "item_id"])
        max_tokens = int(batch["max_tokens"].iloc[0])
        live, total, events = fold_adds(live, int(total), max_tokens, batch.itertuples(index=False))
        self.state.update((json.dumps(live), int(total)))
        yield pd.DataFrame({
            "session_id": key[0],
            "item_id": [e[0] for e in events],
            "status": [e[1] for e in events],
            "evicted_by": [e[2] for e in events],
            "total_after": int(total),
        })

    def close(self) -> None:
        pass


@contextmanager
def _code_by_value() -> Iterator[None]:
    """Spark hands the code of a stateful step to a Python process of the driver
    before it goes to the executors.  That process has the path of the JVM, not
    the caller's, and may know nothing of this package, so the code goes whole
    and not as the name of a module."""
    mine = [m for m in (sys.modules[__name__], working) if m.__name__ not in cloudpickle.list_registry_pickle_by_value()]
    for m in mine:
        cloudpickle.register_pickle_by_value(m)
    try:
        yield
    finally:
        for m in mine:
            cloudpickle.unregister_pickle_by_value(m)


def stream_working_memory(adds: DataFrame, sessions: DataFrame, api: str = "transform") -> DataFrame:
    """Per-session working-memory state with eviction.  ``adds`` streams
    (session_id, item_id, sequence_num, token_count, relevance_score,
    pinned); the static ``sessions`` table gives max_tokens.  Inside a
    micro-batch adds are applied in sequence order, across micro-batches in
    arrival order.  Emits one event per add (kept) and per eviction.

    api="transform" uses transformWithStateInPandas on the RocksDB state
    store (set when the session has no provider configured); api="legacy"
    uses applyInPandasWithState."""
    a = adds.select("session_id", "item_id", "sequence_num", "token_count", "relevance_score", "pinned") \
            .join(sessions.select("session_id", "max_tokens"), "session_id")
    if api == "legacy":
        with _code_by_value():
            return a.groupBy("session_id").applyInPandasWithState(
                _wm_step, WM_OUT, WM_STATE, "append", GroupStateTimeout.NoTimeout)
    spark = adds.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    rocks = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    if spark.conf.get(key, None) in (None, "", rocks) or "HDFSBacked" in spark.conf.get(key, ""):
        spark.conf.set(key, rocks)
    with _code_by_value():
        return a.groupBy("session_id").transformWithStateInPandas(
            SessionWorkingMemory(), WM_OUT, "Append", "None")


def final_item_status(events: DataFrame) -> DataFrame:
    """Collapse working-memory events: an item ever evicted is evicted."""
    return events.groupBy("session_id", "item_id").agg(
        F.when(F.count_if(F.col("status") == "evicted") > 0, "evicted").otherwise("kept").alias("status"))


def stream_service_metrics(metrics: DataFrame, length: str = "60 minutes", slide: str = "5 minutes",
                           watermark: str = "10 minutes") -> DataFrame:
    """Trailing-window service statistics (sliding windows; tumbling when
    slide == length), emitted once a window closes under the watermark."""
    m = metrics.withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    return (m.withWatermark("recorded_at", watermark)
            .groupBy(F.window("recorded_at", length, slide).alias("window"), "service")
            .agg(F.count(F.lit(1)).alias("calls"),
                 F.count_if(~F.col("success")).alias("errors"),
                 F.round(F.avg("latency_ms"), 2).alias("avg_latency_ms"),
                 F.percentile_approx("latency_ms", 0.95).alias("p95_latency_ms"),
                 F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    "service", "calls", "errors", "avg_latency_ms", "p95_latency_ms", "tokens_in", "tokens_out"))


def stream_access_counts(log: DataFrame) -> DataFrame:
    """Running access_count and last_accessed per memory (update mode)."""
    return log.groupBy("memory_id").agg(F.count(F.lit(1)).alias("access_count"),
                                        F.max("accessed_at").alias("last_accessed"))


def run_available(df: DataFrame, name: str, mode: str = "append", fmt: str = "parquet") -> DataFrame:
    """Run a streaming DataFrame over everything available (availableNow),
    into a parquet sink under the shared checkpoint folder, and return the
    sink contents as a batch DataFrame.  Update-mode aggregates are written
    per micro-batch through ``foreachBatch``."""
    spark = df.sparkSession
    import uuid
    root = shared_path(spark, f"stream-{name}-{uuid.uuid4().hex}")
    out, ck = f"{root}/out", f"{root}/checkpoint"
    if mode == "append":
        w = df.writeStream.format(fmt).option("path", out).option("checkpointLocation", ck).outputMode("append")
    else:
        def sink(batch: DataFrame, epoch: int) -> None:
            batch.withColumn("_epoch", F.lit(epoch)).write.mode("append").parquet(out)
        w = df.writeStream.foreachBatch(sink).option("checkpointLocation", ck).outputMode(mode)
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)
