"""Registered queries: text gating and enrichment (2.12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.patterns import (API_KEY_SHAPES, CLASSIFY_RULES, IMPORTANCE_TRIGGERS, PASSWORD_ASSIGNMENT,
                                  PASSWORD_FIELD_NAME, SECRET_PATTERNS, TEMPORAL_HINT, has_group,
                                  redaction_label)
from ..operators import gating as g
from ..schemas import CLASSIFY_DEFAULT, ENTITY_TYPES
from ..sources import testdata as td
from .registry import register


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _viol_sql(text: str) -> str:
    parts = []
    for i, (name, pat, sev, desc) in enumerate(SECRET_PATTERNS):
        idx = 1 if has_group(pat) else 0
        parts.append(
            f"list_transform(regexp_extract_all(coalesce({text}, ''), {_q(pat)}, {idx}), lambda m: "
            f"{{'pattern_index': {i}, 'pattern_name': {_q(name)}, 'severity': {_q(sev)}, "
            f"'matched_text': CASE WHEN length(m) > 12 THEN left(m, 4) || '...' || right(m, 4) ELSE '[REDACTED]' END, "
            f"'description': {_q(desc)}}})")
    return "flatten([" + ", ".join(parts) + "])"


def _scan_sql(table: str, id_col: str, text: str) -> str:
    return f"""
_v AS (SELECT {id_col}, {_viol_sql(text)} AS v FROM {table}),
_x AS (SELECT {id_col}, unnest(v) AS s, generate_subscripts(v, 1) - 1 AS match_no FROM _v WHERE len(v) > 0)
SELECT {id_col}, CAST(match_no AS INTEGER) AS match_no, s.pattern_index AS pattern_index, s.pattern_name AS pattern_name,
       s.severity AS severity, s.matched_text AS matched_text, s.description AS description
FROM _x
"""


@register("scan_secrets", _scan_sql("documents", "doc_id", "text"))
def q_scan_secrets(spark, sf):
    return g.scan_secrets(td.documents(spark, sf), "text", "doc_id")


@register("scan_secrets_pages", _scan_sql("pages", "page_id", "html"))
def q_scan_secrets_pages(spark, sf):
    return g.scan_secrets(td.read(spark, sf, "pages"), "html", "page_id")


def _gate_sql(table: str, id_col: str, text: str) -> str:
    crit = "list_filter(v, lambda x: x.severity = 'critical')"
    high = "list_filter(v, lambda x: x.severity = 'high')"

    def message(severity: str, found: str) -> str:
        before, between, after = map(_q, g.GATE_MESSAGES[severity])
        return (f"{before} || CAST(len({found}) AS VARCHAR) || {between} || "
                f"array_to_string(list_transform({found}, lambda x: x.pattern_name), ', ') || {after}")

    return f"""
_v AS (SELECT {id_col}, {_viol_sql(text)} AS v FROM {table}),
_m AS (
  SELECT {id_col}, CAST(len(v) AS INTEGER) AS violation_count,
         CASE WHEN len({crit}) > 0 THEN {message('critical', crit)}
              WHEN len({high}) > 0 THEN {message('high', high)}
         END AS error_message
  FROM _v
)
SELECT {id_col}, violation_count, error_message, error_message IS NULL AS is_safe FROM _m
"""


@register("gate_secrets", _gate_sql("documents", "doc_id", "text"))
def q_gate_secrets(spark, sf):
    out = g.gate_secrets(td.documents(spark, sf), "text")
    return out.select("doc_id", "violation_count", "error_message", "is_safe")


def _redact_sql(text: str) -> str:
    out = text
    for name, pat, sev, _ in SECRET_PATTERNS:
        if sev in ("critical", "high"):
            out = f"regexp_replace({out}, {_q(pat)}, {_q(redaction_label(name))}, 'g')"
    return out


@register("redact_secrets", f"""
SELECT doc_id, {_redact_sql('text')} AS redacted, ({_redact_sql('text')}) <> text AS changed FROM documents
""")
def q_redact(spark, sf):
    d = td.documents(spark, sf)
    r = g.redact_secrets("text")
    return d.select("doc_id", r.alias("redacted"), (r != F.col("text")).alias("changed"))


_LINES = "unnest(string_split(text, chr(10)))"


@register("flag_api_keys", "SELECT doc_id, line, ("
          + " OR ".join(f"regexp_matches(line, {_q(p)})" for p in API_KEY_SHAPES)
          + f") AS is_api_key FROM (SELECT doc_id, {_LINES} AS line FROM documents)")
def q_flag_api_keys(spark, sf):
    d = td.documents(spark, sf).select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return d.select("doc_id", "line", g.flag_api_keys("line").alias("is_api_key"))


@register("flag_passwords", f"""
SELECT doc_id, line, (NOT regexp_matches(line, {_q(PASSWORD_FIELD_NAME)})
                      AND regexp_matches(line, {_q(PASSWORD_ASSIGNMENT)})) AS is_password
FROM (SELECT doc_id, {_LINES} AS line FROM documents)
""")
def q_flag_passwords(spark, sf):
    d = td.documents(spark, sf).select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return d.select("doc_id", "line", g.flag_passwords("line").alias("is_password"))


@register("token_estimate", "SELECT doc_id, CAST(length(text) // 4 AS INTEGER) AS tokens FROM documents")
def q_token_estimate(spark, sf):
    return td.documents(spark, sf).select("doc_id", g.token_estimate("text").alias("tokens"))


def _entities_sql(text: str) -> str:
    types = "|".join(ENTITY_TYPES)
    pat = r"(?:^|[^\p{L}\p{N}_])((?:" + types + r"):[\p{L}\p{N}_./\-]+)"
    return f"list_distinct(regexp_extract_all(coalesce({text}, ''), {_q(pat)}, 1))"


def _classify_sql(t: str) -> str:
    def first(pick, default):
        whens = " ".join(f"WHEN regexp_matches({t}, {_q(r[1])}) THEN {_q(str(r[pick])) if pick < 4 else repr(float(r[pick]))}"
                         for r in CLASSIFY_RULES)
        d = _q(default) if isinstance(default, str) else repr(float(default))
        return f"CASE {whens} ELSE {d} END"
    imp = f"CAST({first(4, CLASSIFY_DEFAULT['importance'])} AS DOUBLE)"
    for pat, w in IMPORTANCE_TRIGGERS:
        imp = f"(CASE WHEN regexp_matches({t}, {_q(pat)}) THEN greatest({imp}, {w!r}) ELSE {imp} END)"
    return (f"{first(2, CLASSIFY_DEFAULT['memory_category'])} AS memory_category, "
            f"{first(3, CLASSIFY_DEFAULT['memory_subtype'])} AS memory_subtype, "
            f"{imp} AS importance, "
            f"array_to_string(list_sort({_entities_sql(t)}), ',') AS entities, "
            f"regexp_matches({t}, {_q(TEMPORAL_HINT)}) AS is_temporal")


@register("classify", f"SELECT doc_id, {_classify_sql('coalesce(text, chr(0))')} FROM documents"
          .replace("coalesce(text, chr(0))", "coalesce(text, '')"))
def q_classify(spark, sf):
    out = g.classify(td.documents(spark, sf), "text")
    return out.select("doc_id", "memory_category", "memory_subtype", "importance",
                      F.array_join(F.array_sort("entities"), ",").alias("entities"), "is_temporal")


@register("extract_entities", f"""
SELECT conv_id, turn, array_to_string(list_sort({_entities_sql('text')}), ',') AS entities FROM conversations
""")
def q_extract_entities(spark, sf):
    c = td.read(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.array_join(F.array_sort(g.extract_entities("text")), ",").alias("entities"))


_REPLY = """CASE WHEN vec_id % 4 = 0 THEN 'Sure! {"memory_category": "' || memory_category || '", "memory_subtype": "'
                       || memory_subtype || '", "importance": ' || CAST(importance AS VARCHAR) || ', "is_temporal": true} ok'
            WHEN vec_id % 4 = 1 THEN 'no json here: ' || memory_id
            WHEN vec_id % 4 = 2 THEN '{"importance": 0.25, "summary": "' || memory_id || '"'
            ELSE 'x {"entities": ["table:' || memory_id || '"], "summary": "s-' || memory_id || '"} y' END"""


@register("parse_model_json", f"""
_r AS (
  SELECT memory_id, {_REPLY.replace('vec_id', 'CAST(substr(memory_id, 2) AS INTEGER)')} AS reply FROM memories
),
_j AS (SELECT memory_id, regexp_extract(reply, '(?s)\\{{.*\\}}', 0) AS body FROM _r),
_p AS (SELECT memory_id, CASE WHEN body <> '' AND json_valid(body) THEN CAST(body AS JSON) END AS js FROM _j)
SELECT memory_id,
       coalesce(json_extract_string(js, '$.memory_category'), 'semantic') AS memory_category,
       coalesce(json_extract_string(js, '$.memory_subtype'), 'domain') AS memory_subtype,
       coalesce(CAST(json_extract(js, '$.importance') AS DOUBLE), 0.5) AS importance,
       coalesce(array_to_string(CAST(json_extract(js, '$.entities') AS VARCHAR[]), ','), '') AS entities,
       coalesce(CAST(json_extract(js, '$.is_temporal') AS BOOLEAN), false) AS is_temporal,
       json_extract_string(js, '$.summary') AS summary
FROM _p
""")
def q_parse_model_json(spark, sf):
    m = td.memories(spark, sf)
    vid = F.substring("memory_id", 2, 10).cast("int")
    reply = (F.when(vid % 4 == 0, F.concat(
                F.lit('Sure! {"memory_category": "'), "memory_category", F.lit('", "memory_subtype": "'),
                "memory_subtype", F.lit('", "importance": '), F.col("importance").cast("string"),
                F.lit(', "is_temporal": true} ok')))
             .when(vid % 4 == 1, F.concat(F.lit("no json here: "), "memory_id"))
             .when(vid % 4 == 2, F.concat(F.lit('{"importance": 0.25, "summary": "'), "memory_id", F.lit('"')))
             .otherwise(F.concat(F.lit('x {"entities": ["table:'), "memory_id", F.lit('"], "summary": "s-'),
                                 "memory_id", F.lit('"} y'))))
    p = g.parse_model_json(reply)
    return m.select("memory_id", p["memory_category"].alias("memory_category"),
                    p["memory_subtype"].alias("memory_subtype"), p["importance"].alias("importance"),
                    F.array_join(p["entities"], ",").alias("entities"), p["is_temporal"].alias("is_temporal"),
                    p["summary"].alias("summary"))


@register("summarize_fallback", """
_s AS (
  SELECT memory_id, content,
         CASE CAST(substr(memory_id, 2) AS INTEGER) % 3 WHEN 0 THEN summary WHEN 1 THEN 'short' ELSE '```' || summary END AS cand
  FROM memories
)
SELECT memory_id,
       CASE WHEN length(content) // 4 > 50 THEN
         CASE WHEN cand IS NULL OR length(cand) < 10 OR contains(cand, '```')
              THEN regexp_replace(left(content, 200), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')
                   || CASE WHEN length(content) > 200 THEN '...' ELSE '' END
              ELSE cand END
       END AS summary
FROM _s
""")
def q_summarize_fallback(spark, sf):
    m = td.memories(spark, sf)
    vid = F.substring("memory_id", 2, 10).cast("int")
    cand = (F.when(vid % 3 == 0, F.col("summary")).when(vid % 3 == 1, F.lit("short"))
            .otherwise(F.concat(F.lit("```"), F.col("summary"))))
    return m.select("memory_id", g.summarize_fallback(cand, F.col("content")).alias("summary"))


_QUESTIONS_SQL = """
_q AS (
  SELECT conv_id, turn, text,
         list_filter(string_split(text, chr(10)), lambda q: length(q) < 100 AND
                     (contains(q, '?') OR len(list_filter(string_split_regex(q, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) < 8)
         )[1:5] AS questions
  FROM conversations
)
"""


@register("filter_questions", _QUESTIONS_SQL + """
SELECT conv_id, turn, CAST(len(questions) AS INTEGER) AS n_questions, array_to_string(questions, '|') AS questions FROM _q
""")
def q_filter_questions(spark, sf):
    c = td.read(spark, sf, "conversations")
    q = g.filter_questions(F.split("text", "\n", -1))
    return c.select("conv_id", "turn", F.size(q).alias("n_questions"), F.array_join(q, "|").alias("questions"))


@register("augment_text", _QUESTIONS_SQL + """
SELECT conv_id, turn,
       CASE WHEN len(questions) > 0 THEN text || chr(10) || chr(10) || 'Questions this answers: ' || array_to_string(questions, ' ')
            ELSE text END AS augmented
FROM _q
""")
def q_augment_text(spark, sf):
    c = td.read(spark, sf, "conversations")
    q = g.filter_questions(F.split("text", "\n", -1))
    return c.select("conv_id", "turn", g.augment_text(F.col("text"), q).alias("augmented"))


@register("embed")
def q_embed(spark, sf):
    out = g.embed(td.documents(spark, sf), "text", dim=64)
    return out.select("doc_id", F.size("embedding").alias("dim"),
                      F.round(F.aggregate("embedding", F.lit(0.0).cast("double"),
                                          lambda a, x: a + x.cast("double") * x), 4).alias("norm_sq"))


def _attach():
    from .registry import attach_sql
    # every document gets a 64-d vector; unit length when it has a word
    attach_sql("embed", r"""
SELECT doc_id, 64 AS dim,
       CASE WHEN regexp_matches(coalesce(text, ''), '[\p{L}\p{N}]') THEN 1.0 ELSE 0.0 END AS norm_sq
FROM documents
""")


_attach()
