"""Table schemas and the fixed vocabularies the operators depend on.

Every constant in the FIXED VALUES blocks below must keep exactly these
values for results to agree with the behaviour this library reproduces.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Table schemas (nullable where the source tables allow NULL)
# --------------------------------------------------------------------------
VECTOR = T.ArrayType(T.FloatType(), containsNull=False)
STRINGS = T.ArrayType(T.StringType())

MEMORIES = T.StructType([
    T.StructField("memory_id", T.StringType(), False),
    T.StructField("user_id", T.StringType(), False),
    T.StructField("org_id", T.StringType()),
    T.StructField("memory_category", T.StringType()),
    T.StructField("memory_subtype", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("embedding", VECTOR),
    T.StructField("entities", STRINGS),
    T.StructField("metadata", T.StringType()),
    T.StructField("event_time", T.TimestampNTZType()),
    T.StructField("is_temporal", T.BooleanType()),
    T.StructField("importance", T.DoubleType()),
    T.StructField("access_count", T.IntegerType()),
    T.StructField("decay_factor", T.DoubleType()),
    T.StructField("supersedes", T.StringType()),
    T.StructField("source_session", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("last_accessed", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("deleted_at", T.TimestampNTZType()),
])

ITEMS = T.StructType([
    T.StructField("item_id", T.StringType(), False),
    T.StructField("session_id", T.StringType(), False),
    T.StructField("user_id", T.StringType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("token_count", T.IntegerType()),
    T.StructField("relevance_score", T.DoubleType()),
    T.StructField("pinned", T.BooleanType()),
    T.StructField("sequence_num", T.IntegerType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("last_accessed", T.TimestampNTZType()),
])

SESSIONS = T.StructType([
    T.StructField("session_id", T.StringType(), False),
    T.StructField("user_id", T.StringType()),
    T.StructField("org_id", T.StringType()),
    T.StructField("total_tokens", T.IntegerType()),
    T.StructField("max_tokens", T.IntegerType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("last_activity", T.TimestampNTZType()),
    T.StructField("expires_at", T.TimestampNTZType()),
    T.StructField("config", T.StringType()),
])

EDGES = T.StructType([
    T.StructField("relationship_id", T.StringType()),
    T.StructField("source_id", T.StringType(), False),
    T.StructField("target_id", T.StringType(), False),
    T.StructField("user_id", T.StringType()),
    T.StructField("relationship", T.StringType()),
    T.StructField("strength", T.DoubleType()),
    T.StructField("context", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("created_by", T.StringType()),
])

ACCESS_LOG = T.StructType([
    T.StructField("access_id", T.StringType()),
    T.StructField("memory_id", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("query_text", T.StringType()),
    T.StructField("similarity_score", T.DoubleType()),
    T.StructField("was_useful", T.BooleanType()),
    T.StructField("was_used", T.BooleanType()),
    T.StructField("accessed_at", T.TimestampNTZType()),
])

ERRORS = T.StructType([
    T.StructField("error_id", T.StringType()),
    T.StructField("tool_name", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("input_preview", T.StringType()),
    T.StructField("stack_trace", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

METRICS = T.StructType([
    T.StructField("metric_id", T.StringType()),
    T.StructField("service", T.StringType()),
    T.StructField("operation", T.StringType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("error_msg", T.StringType()),
    T.StructField("tokens_in", T.IntegerType()),
    T.StructField("tokens_out", T.IntegerType()),
    T.StructField("recorded_at", T.TimestampNTZType()),
])

# --------------------------------------------------------------------------
# FIXED VALUES: memory taxonomy (category -> subtypes), in declared order.
# --------------------------------------------------------------------------
TAXONOMY = {
    "episodic": ["event", "decision", "conversation", "outcome"],
    "semantic": ["user", "project", "environment", "domain", "entity"],
    "procedural": ["workflow", "pattern", "tool_usage", "debugging"],
    "preference": ["communication", "style", "tools", "boundaries"],
}
CATEGORIES = list(TAXONOMY)
TAXONOMY_PAIRS = [(c, s) for c, subs in TAXONOMY.items() for s in subs]

# --------------------------------------------------------------------------
# FIXED VALUES: retrieval weight profiles per query intent.
# Keys are "working_memory" or "category.subtype"; each profile sums to 1.0.
# Unknown intents use "general".
# --------------------------------------------------------------------------
INTENT_WEIGHTS = {
    "how_to": {
        "working_memory": 0.25,
        "procedural.workflow": 0.25,
        "procedural.pattern": 0.15,
        "semantic.project": 0.15,
        "semantic.entity": 0.10,
        "preference.style": 0.05,
        "episodic.decision": 0.05,
    },
    "what_happened": {
        "working_memory": 0.20,
        "episodic.decision": 0.30,
        "episodic.event": 0.20,
        "episodic.outcome": 0.15,
        "semantic.project": 0.10,
        "episodic.conversation": 0.05,
    },
    "what_is": {
        "working_memory": 0.20,
        "semantic.entity": 0.30,
        "semantic.project": 0.20,
        "semantic.domain": 0.15,
        "semantic.environment": 0.10,
        "episodic.decision": 0.05,
    },
    "debug": {
        "working_memory": 0.30,
        "procedural.debugging": 0.25,
        "episodic.outcome": 0.20,
        "semantic.environment": 0.10,
        "semantic.entity": 0.10,
        "preference.tools": 0.05,
    },
    "general": {
        "working_memory": 0.35,
        "semantic.project": 0.15,
        "episodic.decision": 0.15,
        "semantic.entity": 0.10,
        "procedural.workflow": 0.10,
        "preference.communication": 0.10,
        "semantic.user": 0.05,
    },
}
INTENTS = list(INTENT_WEIGHTS)

# FIXED VALUES: link vocabulary, working-item content types, insert defaults.
RELATIONSHIPS = ["related_to", "part_of", "depends_on", "contradicts", "updates"]
SYMMETRIC_RELATIONSHIPS = ["related_to", "contradicts"]
CONTENT_TYPES = ["message", "task_state", "scratchpad", "retrieved_memory", "system"]
DEFAULT_MAX_TOKENS = 8000
MEMORY_DEFAULTS = {
    "importance": 0.5,
    "access_count": 0,
    "decay_factor": 1.0,
    "confidence": 1.0,
    "source_type": "conversation",
}

# FIXED VALUES: entity types recognised in "type:name" entity strings.
ENTITY_TYPES = ["database", "table", "field", "file", "function", "class",
                "api", "service", "person", "tool", "concept"]

# FIXED VALUES: classifier fallback when model output carries no usable JSON.
CLASSIFY_DEFAULT = {
    "memory_category": "semantic",
    "memory_subtype": "domain",
    "importance": 0.5,
    "entities": [],
    "is_temporal": False,
}
