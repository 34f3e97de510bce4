"""Derive the memory-layer tables from the shared test tables.

The driver data is a generic analytics fixture (``embeddings``, ``documents``,
``conversations``, ``events``).  These adapters turn it into the tables the
operators work on, using only per-row expressions and one full join, so every
derived table grows with its source.  ``plans.oracle`` holds the same rules as
DuckDB SQL; both must change together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import INTENTS, RELATIONSHIPS

# FIXED VALUES of the adapter rules (shared with plans/oracle.py).
BASE_TS = "2024-06-01 00:00:00"
AS_OF = "2024-07-01 00:00:00"
METRICS_AS_OF = "2024-01-31 00:00:00"
N_USERS = 8
SESSION_MAX_TOKENS = 600
# label -> (category, subtype); label 9 is deliberately outside the taxonomy.
LABEL_TYPES = [
    ("episodic", "event"), ("episodic", "decision"), ("episodic", "outcome"),
    ("semantic", "project"), ("semantic", "entity"), ("semantic", "environment"),
    ("procedural", "workflow"), ("procedural", "debugging"),
    ("preference", "style"), ("procedural", "troubleshooting"),
]
SERVICES = ["embedding", "database", "llm"]
TOOLS = ["store_memory", "recall_memories", "get_relevant_context", "add_to_working_memory"]
ERROR_TYPES = ["ValueError", "TimeoutError", "KeyError"]


def ts(value: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ'{value}'")


def as_of() -> Column:
    return ts(AS_OF)


def _pick(index: Column, values: list) -> Column:
    out = None
    for i, v in enumerate(values):
        out = F.when(index == i, F.lit(v)) if out is None else out.when(index == i, F.lit(v))
    return out


def _id(prefix: str, n: Column, width: int = 6) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))


def _user(n: Column) -> Column:
    return F.concat(F.lit("u"), n.cast("string"))


def _plus_days(days: Column, base: str = BASE_TS) -> Column:
    return F.timestamp_add("DAY", days.cast("int"), ts(base))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one fixture table.  A scan that yields fewer input splits than
    the cluster's parallelism (the fixture files are single row groups, so
    one task would read a whole table) is spread round-robin over the cores;
    on real data the scan already has more splits than cores and this is a
    no-op."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _TABLES:
        df = spark.read.parquet(path)
        par = spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() < par:
            df = df.repartition(par)
        _TABLES[key] = df
    return _TABLES[key]


# (application, path) -> the table's DataFrame: listing and footer reads happen
# once per session (the fixture files are immutable; DataFrames are lazy)
_TABLES: dict = {}


def _docs_and_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all vectors: a document without a vector has a NULL
    vector, a vector without a document NULL text."""
    e = read(spark, sf_dir, "embeddings")
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return e.join(d, e.vec_id == d.doc_id, "full_outer").select(
        F.coalesce("vec_id", "doc_id").alias("vec_id"), "embedding",
        F.coalesce(F.col("label"), (F.col("doc_id") % len(LABEL_TYPES)).cast("int")).alias("label"),
        "text", "lang", "source")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    created = _plus_days(-(v % 60))
    label = F.col("label")
    return _docs_and_vectors(spark, sf_dir).select(
        _id("m", v).alias("memory_id"),
        _user(v % N_USERS).alias("user_id"),
        F.lit(None).cast("string").alias("org_id"),
        _pick(label, [c for c, _ in LABEL_TYPES]).alias("memory_category"),
        _pick(label, [s for _, s in LABEL_TYPES]).alias("memory_subtype"),
        F.col("text").alias("content"),
        F.left(F.col("text"), F.lit(80)).alias("summary"),
        F.col("embedding"),
        F.when(v % 13 == 0, F.lit(None).cast("array<string>"))
         .when(v % 13 == 1, F.array().cast("array<string>"))
         .otherwise(F.array(F.concat(F.lit("lang:"), "lang"),
                            F.concat(F.lit("source:"), "source"))).alias("entities"),
        F.concat(F.lit('{"tags":["'), F.col("lang"), F.lit('"]}')).alias("metadata"),
        F.when(v % 5 == 0, created).alias("event_time"),
        (v % 5 == 0).alias("is_temporal"),
        (((v * 37) % 100).cast("double") / 100).alias("importance"),
        (v % 7).cast("int").alias("access_count"),
        F.lit(1.0).alias("decay_factor"),
        F.lit(None).cast("string").alias("supersedes"),
        F.lit(None).cast("string").alias("source_session"),
        F.lit("conversation").alias("source_type"),
        ((10 - v % 4).cast("double") / 10).alias("confidence"),
        created.alias("created_at"),
        F.when(v % 11 == 0, F.lit(None).cast("timestamp_ntz"))
         .otherwise(F.timestamp_add("DAY", (v % 5).cast("int"), created)).alias("last_accessed"),
        F.timestamp_add("DAY", (v % 3).cast("int"), created).alias("updated_at"),
        F.when(v % 23 == 0, F.timestamp_add("DAY", F.lit(1), created)).alias("deleted_at"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One retrieval request per embedding row, asked by the *next* user."""
    v = F.col("vec_id")
    return _docs_and_vectors(spark, sf_dir).where(F.col("embedding").isNotNull()).select(
        _id("q", v).alias("request_id"),
        _id("s", v).alias("session_id"),
        _user((v + 1) % N_USERS).alias("user_id"),
        F.col("text").alias("query"),
        F.col("embedding"),
        _pick(v % 5, INTENTS).alias("intent"),
        (F.lit(1000) + (v % 4) * 1000).cast("int").alias("token_budget"),
        F.when(v % 3 == 0, F.array(F.lit("lang:en")))
         .when(v % 3 == 1, F.array(F.lit("lang:en"), F.lit("source:src1")))
         .otherwise(F.array().cast("array<string>")).alias("focus_entities"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items_from(read(spark, sf_dir, "conversations"))


def items_from(c: DataFrame) -> DataFrame:
    """Working items from a (batch or streaming) conversations frame."""
    conv, turn, role = F.col("conv_id"), F.col("turn"), F.col("role")
    created = F.timestamp_add("MINUTE", turn.cast("int"), ts(BASE_TS))
    return c.select(
        F.concat(_id("i", conv), F.lit("_"), F.lpad(turn.cast("string"), 3, "0")).alias("item_id"),
        _id("s", conv).alias("session_id"),
        _user((conv + 1) % N_USERS).alias("user_id"),
        F.when(role == "system", "system").when(role == "user", "message")
         .when(turn % 4 == 3, "task_state").otherwise("scratchpad").alias("content_type"),
        F.col("text").alias("content"),
        (F.length("text") / 4).cast("int").alias("token_count"),
        (((conv + turn) % 10).cast("double") / 10).alias("relevance_score"),
        (role == "system").alias("pinned"),
        turn.cast("int").alias("sequence_num"),
        created.alias("created_at"),
        created.alias("last_accessed"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = items(spark, sf_dir)
    return it.groupBy("session_id", "user_id").agg(
        F.sum("token_count").cast("int").alias("total_tokens"),
        F.max("created_at").alias("last_activity"),
    ).select(
        "session_id", "user_id", F.lit(None).cast("string").alias("org_id"),
        "total_tokens", F.lit(SESSION_MAX_TOKENS).alias("max_tokens"),
        ts(BASE_TS).alias("created_at"), "last_activity",
        F.lit(None).cast("timestamp_ntz").alias("expires_at"),
        F.lit(None).cast("string").alias("config"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from each memory to the next memory of the same user; every fourth
    link also exists in the reverse direction."""
    v = F.col("vec_id")
    e = read(spark, sf_dir, "embeddings").select("vec_id")
    rel = _pick(v % 5, RELATIONSHIPS)
    strength = ((v * 17) % 100).cast("double") / 100
    fwd = e.select(
        _id("r", v).alias("relationship_id"), _id("m", v).alias("source_id"),
        _id("m", v + N_USERS).alias("target_id"), _user(v % N_USERS).alias("user_id"),
        rel.alias("relationship"), strength.alias("strength"))
    back = e.where(v % 4 == 0).select(
        F.concat(_id("r", v), F.lit("b")).alias("relationship_id"),
        _id("m", v + N_USERS).alias("source_id"), _id("m", v).alias("target_id"),
        _user(v % N_USERS).alias("user_id"), rel.alias("relationship"), strength.alias("strength"))
    return fwd.unionByName(back).select(
        "*", F.lit(None).cast("string").alias("context"),
        ts(BASE_TS).alias("created_at"), F.lit(None).cast("string").alias("created_by"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics_from(read(spark, sf_dir, "events"))


def metrics_from(ev: DataFrame) -> DataFrame:
    """Service metrics from a (batch or streaming) events frame."""
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        F.concat(F.lit("x"), F.col("event_id").cast("string")).alias("metric_id"),
        _pick(F.col("user_id") % 3, SERVICES).alias("service"),
        F.col("event_type").alias("operation"),
        F.col("value").alias("latency_ms"),
        (F.col("event_type") != "error").alias("success"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error_msg"),
        k.alias("tokens_in"),
        (k * 2).alias("tokens_out"),
        F.col("ts").alias("recorded_at"),
    )


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read(spark, sf_dir, "events").where(F.col("event_type") == "error")
    return ev.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("error_id"),
        _pick(F.col("user_id") % 4, TOOLS).alias("tool_name"),
        _user(F.col("user_id") % N_USERS).alias("user_id"),
        _pick(F.col("event_id") % 3, ERROR_TYPES).alias("error_type"),
        F.concat(F.lit("call failed after "), F.col("value").cast("string"),
                 F.lit(" ms with "), F.col("props")).alias("error_message"),
        F.col("props").alias("input_preview"),
        F.lit(None).cast("string").alias("stack_trace"),
        F.col("ts").alias("created_at"),
    )


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access_log_from(read(spark, sf_dir, "events"))


def access_log_from(events: DataFrame) -> DataFrame:
    ev = events.where(F.col("event_type") == "view")
    return ev.select(
        F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("access_id"),
        _id("m", F.col("event_id") % 2000).alias("memory_id"),
        _id("s", F.col("user_id")).alias("session_id"),
        _user(F.col("event_id") % N_USERS).alias("user_id"),
        F.col("props").alias("query_text"),
        (F.col("value") / 100).alias("similarity_score"),
        F.lit(None).cast("boolean").alias("was_useful"),
        F.lit(None).cast("boolean").alias("was_used"),
        F.col("ts").alias("accessed_at"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")
