"""Context assembly: intent profiles, budget split, candidate scoring and
greedy token-budget packing, for many requests at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import INTENT_WEIGHTS


def intent_weights(spark: SparkSession, overrides: dict | None = None) -> DataFrame:
    """(intent, weight_key, weight) for the five profiles; ``overrides``
    ({intent: {key: weight}}) replaces single weights."""
    rows = []
    for intent, prof in INTENT_WEIGHTS.items():
        for key, w in prof.items():
            if overrides and key in overrides.get(intent, {}):
                w = overrides[intent][key]
            rows.append((intent, key, float(w)))
    return spark.createDataFrame(rows, "intent string, weight_key string, weight double")


def normalize_intent(col) -> Column:
    """Free-text model reply -> one of the five intents (checked in this
    order: "how", "happened", "what_is"/"what is", "debug"; then an exact
    intent name; else general)."""
    c = F.col(col) if isinstance(col, str) else col
    t = F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[\"']", "")))
    return (F.when(t.contains("how"), "how_to")
            .when(t.contains("happened"), "what_happened")
            .when(t.contains("what_is") | t.contains("what is"), "what_is")
            .when(t.contains("debug"), "debug")
            .when(t.isin(*INTENT_WEIGHTS.keys()), t)
            .otherwise("general"))


def profile_types(spark: SparkSession, weights: DataFrame | None = None) -> DataFrame:
    """(intent, memory_category, memory_subtype, weight) for the long-term
    keys of every profile (a fixed-size table)."""
    w = weights if weights is not None else intent_weights(spark)
    return (w.where(F.col("weight_key") != "working_memory")
            .select("intent", F.split_part("weight_key", F.lit("."), F.lit(1)).alias("memory_category"),
                    F.split_part("weight_key", F.lit("."), F.lit(2)).alias("memory_subtype"), "weight"))


def known_intent(col: str = "intent") -> Column:
    return F.when(F.col(col).isin(list(INTENT_WEIGHTS)), F.col(col)).otherwise(F.lit("general"))


def request_weights(requests: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(request_id, weight_key, weight) for each request's intent; unknown
    intents use the general profile.  The profile table is a fixed 33-row
    constant, so it is broadcast."""
    w = weights if weights is not None else intent_weights(requests.sparkSession)
    known = list(INTENT_WEIGHTS)
    r = requests.select("request_id", F.when(F.col("intent").isin(known), F.col("intent"))
                        .otherwise(F.lit("general")).alias("intent"))
    return r.join(F.broadcast(w), "intent").drop("intent")


def budget_split(requests: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Per request: working budget = int(budget * w_wm); the long-term keys'
    budgets need the working tokens actually used (see ``assemble_context``),
    so this returns the weights next to the budget."""
    rw = request_weights(requests, weights)
    return requests.select("request_id", "token_budget").join(rw, "request_id")


def working_context(items: DataFrame, req: DataFrame) -> DataFrame:
    """req (request_id, session_id, working_budget) -> picked working items
    (pinned desc, sequence desc, greedy skip under the working budget) with
    the tokens used.  Requests of one session and budget share one packing, and no
    item that cannot be taken is copied per request (``plans.packing``)."""
    from ..plans.packing import greedy_pack
    req = req.select("request_id", "session_id", F.coalesce(F.col("working_budget").cast("long"), F.lit(0)).alias("_budget"))
    order = [(~F.col("pinned")), (-F.col("sequence_num")), F.col("item_id")]
    picked = greedy_pack(items, req, "session_id", order, "token_count", "_budget",
                         keep=["item_id", "token_count", "content_type", "relevance_score"])
    return (req.join(picked, ["session_id", "_budget"])
            .select("request_id", "session_id", "item_id", "token_count", "content_type", "relevance_score",
                    "position", F.col("used").alias("working_used")))


def score_candidates(hits: DataFrame, focus_col: str = "focus_entities") -> DataFrame:
    """score = similarity * weight * (1 + importance), then x (1 + 0.3 m) for m
    matching focus entities."""
    from .search import entity_boost, entity_matches
    m = entity_matches(focus_col, "entities")
    base = F.col("similarity") * F.col("weight") * (F.lit(1.0) + F.col("importance"))
    return (hits.withColumn("entity_matches", m)
            .withColumn("score", entity_boost(base, m, "context")))


def explain_inclusion(cat, sub, matches, score) -> Column:
    parts = F.concat_ws(" | ",
                        F.concat(_col(cat), F.lit("."), _col(sub), F.lit(" memory")),
                        F.when(_col(matches) > 0, F.lit("entity match")),
                        F.when(_col(score) > 0.8, F.lit("highly relevant"))
                        .when(_col(score) > 0.5, F.lit("relevant")))
    return parts


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pack_context(cands: DataFrame, budget_col: str = "token_budget", start_col: str = "working_used",
                 dedup_prefix: int | None = None) -> DataFrame:
    """Per request: candidates by score desc (then id); an item is skipped if
    it does not fit the budget (which starts at the working tokens used), then
    skipped if the same text was already taken (with ``dedup_prefix``: the same
    first characters); else taken.  The two checks run in that order."""
    same = F.sha2("content", 256) if dedup_prefix is None else F.left(F.col("content"), F.lit(dedup_prefix))
    key = F.struct((-F.col("score")).alias("k0"), F.col("memory_id").alias("id"),
                   F.col("token_count").cast("long").alias("tok"),
                   same.alias("pfx"))
    per = cands.groupBy("request_id").agg(F.sort_array(F.collect_list(key)).alias("_xs"))
    init = F.struct(F.col(start_col).cast("long").alias("used"),
                    F.array().cast("array<string>").alias("seen"),
                    F.array().cast("array<string>").alias("picked"))
    budget = F.col(budget_col)
    fold = F.aggregate(
        "_xs", init,
        lambda acc, x: F.when((acc["used"] + x["tok"] <= budget) & ~F.array_contains(acc["seen"], x["pfx"]),
                              F.struct((acc["used"] + x["tok"]).alias("used"),
                                       F.concat(acc["seen"], F.array(x["pfx"])).alias("seen"),
                                       F.concat(acc["picked"], F.array(x["id"])).alias("picked")))
        .otherwise(acc))
    return per, fold


def assemble_context(requests: DataFrame, items: DataFrame, memories: DataFrame, *,
                     n_per_type: int = 5, min_similarity: float = 0.5, min_type_budget: int = 50,
                     weights: DataFrame | None = None, block_rows: int | None = None) -> DataFrame:
    """Context for every request at once.

    requests: request_id, session_id, user_id, embedding, intent,
    token_budget, focus_entities.  Returns one row per included item:
    request_id, source, position, item_id / memory_id, category, subtype,
    token_count, relevance_score, why_included, similarity, plus per-request
    total_tokens and budget_used_pct.

    Plan: (1) working items of each request's session are folded under the
    working budget; (2) typed top-k runs for every long-term key of the
    profile (independent of (1), so the vector search never waits for or
    recomputes the working fold) and keys whose type budget is under
    ``min_type_budget`` are dropped afterwards; (3) candidates are scored and
    folded per request.  Picked rows travel inside the fold's structs, so no
    intermediate is joined back or computed twice."""
    from ..plans.blocking import BLOCK_ROWS
    from .search import entity_boost, entity_matches, typed_topk
    block_rows = block_rows or BLOCK_ROWS
    rw = request_weights(requests, weights)
    w_wm = rw.where(F.col("weight_key") == "working_memory").select("request_id", F.col("weight").alias("w_wm"))
    req = (requests.select("request_id", "session_id", "token_budget")
           .join(w_wm, "request_id", "left")
           .withColumn("working_budget",
                       (F.col("token_budget") * F.coalesce("w_wm", F.lit(0.35))).cast("int")))
    # (1) working memory: the picks (at most working_budget of them) are
    #     gathered per request
    wc = working_context(items, req)
    wkey = F.struct(F.col("position").alias("p"), F.col("item_id").alias("id"),
                    F.col("token_count").cast("long").alias("tok"), F.col("content_type").alias("content_type"),
                    F.col("relevance_score").cast("double").alias("relevance_score"))
    wl = wc.groupBy("request_id").agg(F.max("working_used").alias("_used"),
                                      F.sort_array(F.collect_list(wkey)).alias("_wxs"))
    wempty = F.array().cast(wl.schema["_wxs"].dataType)
    wpack = (req.select("request_id", "token_budget").join(wl, "request_id", "left")
             .select("request_id", "token_budget",
                     F.struct(F.coalesce("_used", F.lit(0)).cast("long").alias("used"),
                              F.coalesce("_wxs", wempty).alias("picked")).alias("_w")))
    # (2) typed top-k for all long-term keys of the profile
    q = requests.select("request_id", "user_id", "embedding", known_intent().alias("intent"))
    # only what packing needs travels with the vectors: the token estimate and
    # a hash of the whole text (equal texts are taken once), never the text
    mem = (memories.withColumn("_tok", F.floor(F.length("content") / 4).cast("int"))
           .withColumn("_pfx", F.sha2("content", 256)))
    hits = typed_topk(q, mem, profile_types(requests.sparkSession, weights), n=n_per_type,
                      min_similarity=min_similarity, block_rows=block_rows,
                      carry=("_tok", "_pfx", "entities", "importance"))
    focus = requests.select("request_id", "focus_entities")
    m = entity_matches("focus_entities", "entities")
    base = F.col("similarity") * F.col("weight") * (F.lit(1.0) + F.col("importance"))
    cand = (hits.join(focus, "request_id")
            .select("request_id", "memory_id", "memory_category", "memory_subtype", "weight", "similarity",
                    F.col("_tok").alias("token_count"), F.col("_pfx").alias("pfx"), m.alias("entity_matches"),
                    entity_boost(base, m, "context").alias("score")))
    ckey = F.struct((-F.col("score")).alias("k0"), F.col("memory_id").alias("id"),
                    F.col("token_count").cast("long").alias("tok"), "pfx", "memory_category", "memory_subtype",
                    "weight", "score", "entity_matches", "similarity")
    cl = cand.groupBy("request_id").agg(F.sort_array(F.collect_list(ckey)).alias("_cxs"))
    # (3) type budgets need the working tokens used: filter inside the fold
    j = wpack.join(cl, "request_id", "left")
    cempty = F.array().cast(cl.schema["_cxs"].dataType)
    used_w = F.col("_w.used")
    type_ok = lambda x: ((F.col("token_budget") - used_w) * x["weight"]).cast("int") >= min_type_budget
    cinit = F.struct(used_w.alias("used"), F.array().cast("array<string>").alias("seen"), cempty.alias("picked"))
    cfold = F.aggregate(
        F.filter(F.coalesce("_cxs", cempty), type_ok), cinit,
        lambda acc, x: F.when((acc["used"] + x["tok"] <= F.col("token_budget")) & ~F.array_contains(acc["seen"], x["pfx"]),
                              F.struct((acc["used"] + x["tok"]).alias("used"),
                                       F.concat(acc["seen"], F.array(x["pfx"])).alias("seen"),
                                       F.concat(acc["picked"], F.array(x)).alias("picked")))
        .otherwise(acc))
    packed = j.select("request_id", "token_budget", "_w", cfold.alias("_c"))
    # one explode over both picked lists (a union of two projections would
    # evaluate the whole pipeline twice)
    def as_row(x, source):
        wm = source == "working_memory"
        null_s, null_d = F.lit(None).cast("string"), F.lit(None).cast("double")
        return F.struct(
            F.lit(source).alias("source"),
            (x["id"] if wm else null_s).alias("item_id"),
            (null_s if wm else x["id"]).alias("memory_id"),
            (null_s if wm else x["memory_category"]).alias("memory_category"),
            (null_s if wm else x["memory_subtype"]).alias("memory_subtype"),
            x["tok"].cast("int").alias("token_count"),
            (x["relevance_score"] if wm else F.round(x["score"], 3)).alias("relevance_score"),
            (F.concat(F.lit("Recent "), x["content_type"], F.lit(" from current session")) if wm else
             explain_inclusion(x["memory_category"], x["memory_subtype"], x["entity_matches"], x["score"]))
            .alias("why_included"),
            (null_d if wm else x["similarity"]).alias("similarity"))
    rows = F.concat(F.transform("_w.picked", lambda x: as_row(x, "working_memory")),
                    F.transform("_c.picked", lambda x: as_row(x, "long_term")))
    out = packed.select("request_id", F.col("_c.used").alias("total_tokens"),
                        pct_2dp(F.col("_c.used"), F.col("token_budget")).alias("budget_used_pct"),
                        F.posexplode(rows).alias("position", "x"))
    return out.select("request_id", "x.source", F.col("position").cast("int").alias("position"), "x.item_id",
                      "x.memory_id", "x.memory_category", "x.memory_subtype", "x.token_count", "x.relevance_score",
                      "x.why_included", "x.similarity", "total_tokens", "budget_used_pct")


def pct_2dp(part: Column, whole: Column) -> Column:
    """100 * part / whole rounded half-up to 2 decimals, in exact integer
    arithmetic (no binary-fraction rounding surprises)."""
    num = part.cast("long") * 20000 + whole.cast("long")
    den = whole.cast("long") * 2
    return (num - F.pmod(num, den)).cast("double") / den.cast("double") / 100


def context_stats(assembled: DataFrame) -> DataFrame:
    """Per request: working / long-term item counts and long-term counts per
    category and per subtype, as (request_id, dimension, value, n), from one
    grouping-sets aggregate."""
    g = (assembled.groupingSets([["request_id", "source"], ["request_id", "memory_category"],
                                 ["request_id", "memory_subtype"]],
                                "request_id", "source", "memory_category", "memory_subtype")
         .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("source") == "long_term").alias("n_lt"),
              F.grouping_id().alias("gid")))
    # grouping_id bits (source, category, subtype): 3 -> by source, 5 -> category, 6 -> subtype
    out = g.select(
        "request_id",
        F.when(F.col("gid") == 3, "source").when(F.col("gid") == 5, "category").otherwise("subtype").alias("dimension"),
        F.when(F.col("gid") == 3, F.col("source")).when(F.col("gid") == 5, F.col("memory_category"))
         .otherwise(F.col("memory_subtype")).alias("value"),
        F.when(F.col("gid") == 3, F.col("n")).otherwise(F.col("n_lt")).alias("n"))
    # category / subtype counts cover long-term rows only (working rows have no type)
    return out.where((F.col("dimension") == "source") | (F.col("n") > 0))


def assemble_context_unified(requests: DataFrame, items: DataFrame, memories: DataFrame, *,
                             per_type: int = 20, min_similarity: float = 0.5,
                             weights: DataFrame | None = None) -> DataFrame:
    """Single greedy pass over working items and long-term candidates
    together (20 per type, no prefix dedup).  Working items score
    relevance_score * w_wm; memories similarity * weight * (1 + importance)."""
    from ..plans.packing import first_by_cost, fold, token_cost
    from .search import typed_topk
    rw = request_weights(requests, weights)
    req = requests.select("request_id", "session_id", "user_id", "embedding", "token_budget", "focus_entities")
    q = requests.select("request_id", "user_id", "embedding", known_intent().alias("intent"))
    mem = memories.withColumn("token_count", F.floor(F.length("content") / 4).cast("int"))
    hits = typed_topk(q, mem, profile_types(requests.sparkSession, weights), n=per_type,
                      min_similarity=min_similarity, carry=("token_count", "entities", "importance"))
    lt = hits.join(req.select("request_id", "focus_entities"), "request_id")
    lt = score_candidates(lt).select("request_id", F.col("memory_id").alias("id"), "token_count", "score",
                                     F.lit("long_term").alias("source"))
    # of a session's items only those that some request with the same weight can take
    # are copied per request: order and cost are the same for all of them
    w_wm = rw.where(F.col("weight_key") == "working_memory").select("request_id", F.col("weight").alias("w"))
    wreq = req.select("request_id", "session_id", "token_budget").join(w_wm, "request_id")
    kinds = wreq.groupBy("session_id", "w").agg(F.max(F.coalesce("token_budget", F.lit(0))).alias("_most"))
    scored = (items.select("session_id", "item_id", "token_count", "relevance_score").join(kinds, "session_id")
              .select("session_id", "w", "_most", F.col("item_id").alias("id"), "token_count",
                      (F.col("relevance_score") * F.col("w")).alias("score")))
    left = first_by_cost(scored, ["session_id", "w"], F.struct((-F.col("score")).alias("k0"), "id"),
                         token_cost("token_count"), F.col("_most")).drop("_most")
    wi = (wreq.select("request_id", "session_id", "w").join(left, ["session_id", "w"])
          .select("request_id", "id", "token_count", "score", F.lit("working_memory").alias("source")))
    allc = lt.unionByName(wi).withColumn("cost", token_cost("token_count"))
    # what is gathered is bounded by the budget and the hits; rows without cost are all taken
    limit = F.coalesce(F.col("token_budget").cast("long"), F.lit(0))
    allc = allc.join(req.select("request_id", limit.alias("_limit")), "request_id").where(F.col("cost") <= F.col("_limit"))
    key = F.struct((-F.col("score")).alias("k0"), "id", "cost", "token_count", "score", "source")
    per = allc.where(F.col("cost") > 0).groupBy("request_id", "_limit").agg(F.sort_array(F.collect_list(key)).alias("_xs"))
    paid = per.select("request_id", F.explode(fold(F.col("_xs"), F.col("_limit"))).alias("x")).select("request_id", "x.*")
    free = allc.where(F.col("cost") == 0).select("request_id", key.alias("x")).select("request_id", "x.*")
    w = Window.partitionBy("request_id").orderBy("k0", "id", "cost", "source")
    return (paid.unionByName(free)
            .withColumns({"total_tokens": F.sum("cost").over(Window.partitionBy("request_id")),
                          "position": (F.row_number().over(w) - 1)})
            .select("request_id", "id", "total_tokens", "position", "token_count", "score", "source"))
