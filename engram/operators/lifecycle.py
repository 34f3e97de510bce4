"""Long-term memory changes as set-based table jobs (dedup-upsert, partial
updates, deletes, erasure, supersede, re-embedding) and checkpointing of
working memory into long-term memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions_due(items: DataFrame, threshold: int = 6000) -> DataFrame:
    """Sessions whose working-memory tokens reach the checkpoint threshold."""
    return (items.groupBy("session_id").agg(F.sum("token_count").cast("long").alias("total_tokens"))
            .where(F.col("total_tokens") >= threshold))


def _set_cols(df: DataFrame, updates: dict) -> DataFrame:
    return df.select(*[updates[c].alias(c) if c in updates else F.col(c) for c in df.columns])


def update_memories(memories: DataFrame, changes: DataFrame, as_of: Column, dim: int,
                    embedder=None) -> tuple[DataFrame, DataFrame]:
    """changes (request_id, memory_id, user_id, content?, importance?,
    entities?, metadata?): partial update of live rows owned by the
    requester; ``updated_at`` = as_of.  Returns (table after, report with
    status ok / not_found / unauthorized / empty / blocked / dimension and
    re_embedded).

    Of several changes to a row each field takes the last value that is not
    null, in the order of request_id.  New contents pass the secret gate first
    (a change that fails it is ``blocked`` as a whole), and rows whose content
    changes are embedded anew (``embedder`` as in ``gating.embed``) with ``dim``
    components.  A new content for a row whose vector has another length is
    refused (``dimension``): the row would drop out of every search."""
    from .gating import embed, gate_secrets
    owners = memories.where(F.col("deleted_at").isNull()).select(
        "memory_id", F.col("user_id").alias("_owner"), F.size("embedding").alias("_dim"))
    c = gate_secrets(changes, "content").drop("violation_count", "error_message").join(owners, "memory_id", "left")
    empty = (F.col("content").isNull() & F.col("importance").isNull() & F.col("entities").isNull()
             & F.col("metadata").isNull())
    status = (F.when(F.col("_owner").isNull(), "not_found")
              .when(F.col("_owner") != F.col("user_id"), "unauthorized")
              .when(empty, "empty").when(~F.col("is_safe"), "blocked")
              .when(F.col("content").isNotNull() & (F.col("_dim") > 0) & (F.col("_dim") != dim), "dimension")
              .otherwise("ok"))
    rep = c.select("request_id", "memory_id", "user_id", status.alias("status"),
                   (F.col("content").isNotNull() & (status == "ok")).alias("re_embedded"))
    def last(f: str) -> Column:
        return F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("request_id")))

    ok = c.where(status == "ok").groupBy("memory_id").agg(
        last("content").alias("_c"), last("importance").alias("_i"), last("entities").alias("_e"),
        last("metadata").alias("_m"), F.lit(True).alias("_hit"))
    vectors = embed(ok.where(F.col("_c").isNotNull()).select("memory_id", "_c"), "_c", "_v", dim=dim, model=embedder)
    j = memories.join(ok, "memory_id", "left").join(vectors.select("memory_id", "_v"), "memory_id", "left")
    out = _set_cols(j, {
        "embedding": F.coalesce("_v", "embedding"),
        "content": F.coalesce("_c", "content"), "importance": F.coalesce("_i", "importance"),
        "entities": F.coalesce("_e", "entities"), "metadata": F.coalesce("_m", "metadata"),
        "updated_at": F.when(F.col("_hit"), as_of).otherwise(F.col("updated_at")),
    }).select(*memories.columns)
    return out, rep


def set_embeddings(memories: DataFrame, vectors: DataFrame, as_of: Column, order: str | None = None) -> DataFrame:
    """vectors (memory_id, embedding): replace the vector and stamp updated_at.
    Of several vectors for a row the last by ``order`` counts (else the greatest)."""
    last = F.max_by("embedding", order) if order else F.max("embedding")
    v = vectors.where(F.col("embedding").isNotNull()).groupBy("memory_id").agg(
        last.alias("_v"), F.lit(True).alias("_hit"))
    j = memories.join(v, "memory_id", "left")
    return _set_cols(j, {"embedding": F.coalesce("_v", "embedding"),
                         "updated_at": F.when(F.col("_hit"), as_of).otherwise(F.col("updated_at"))}) \
        .select(*memories.columns)


def soft_delete(memories: DataFrame, reqs: DataFrame, as_of: Column) -> DataFrame:
    """reqs (memory_id, user_id): owned rows get deleted_at = updated_at = as_of."""
    r = reqs.select("memory_id", "user_id", F.lit(True).alias("_hit")).dropDuplicates(["memory_id", "user_id"])
    j = memories.join(r, ["memory_id", "user_id"], "left")
    hit = F.coalesce("_hit", F.lit(False))
    return _set_cols(j, {"deleted_at": F.when(hit, as_of).otherwise(F.col("deleted_at")),
                         "updated_at": F.when(hit, as_of).otherwise(F.col("updated_at"))}) \
        .select(*memories.columns)


def hard_delete(memories: DataFrame, reqs: DataFrame) -> DataFrame:
    return memories.join(reqs.select("memory_id", "user_id"), ["memory_id", "user_id"], "left_anti")


def forget_users(tables: dict, users: DataFrame, confirm_col: str = "confirmation",
                 confirmation: str = "DELETE ALL MY DATA") -> tuple[dict, DataFrame]:
    """Erase every row of the confirmed users from access log, relationships,
    working items, memories (deleted ones too) and sessions.  Returns (tables
    after, per-user report with memories and sessions removed)."""
    u = users.where(F.col(confirm_col) == confirmation).select("user_id").distinct()
    ub = u
    out = {name: df.join(ub, "user_id", "left_anti") for name, df in tables.items()}
    mem = tables["memories"].join(ub, "user_id", "left_semi").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("memories_deleted"))
    ses = tables["sessions"].join(ub, "user_id", "left_semi").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("sessions_deleted"))
    rep = (u.join(mem, "user_id", "left").join(ses, "user_id", "left")
           .select("user_id", F.coalesce("memories_deleted", F.lit(0)).alias("memories_deleted"),
                   F.coalesce("sessions_deleted", F.lit(0)).alias("sessions_deleted")))
    return out, rep


def supersede(memories: DataFrame, pairs: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """pairs (old_id, new_id, user_id): when both are live rows of that user,
    new.supersedes = old and old.deleted_at = as_of; otherwise an error row.

    A row names one predecessor, and a row has one successor.  Of several new rows
    for one old row the one with the smallest id takes it (for the others it is
    deleted already), and of several old rows for one new row the one with the
    smallest id is taken; the others stay live and are reported, so no row is
    deleted without one that names it."""
    lv = memories.where(F.col("deleted_at").isNull()).select("memory_id", "user_id")
    old_ok = lv.select(F.col("memory_id").alias("old_id"), "user_id", F.lit(True).alias("_old"))
    new_ok = lv.select(F.col("memory_id").alias("new_id"), "user_id", F.lit(True).alias("_new"))
    p = pairs.select("old_id", "new_id", "user_id").join(old_ok, ["old_id", "user_id"], "left").join(
        new_ok, ["new_id", "user_id"], "left")
    shown = {c: F.coalesce(F.col(c), F.lit("(none)")) for c in ("old_id", "new_id")}
    gone = F.concat(F.lit("Old memory "), shown["old_id"], F.lit(" not found or already deleted"))
    p = p.withColumn("_error", F.when(F.col("_old").isNull(), gone)
                     .when(F.col("_new").isNull(), F.concat(F.lit("New memory "), shown["new_id"], F.lit(" not found")))
                     .when(F.col("old_id") == F.col("new_id"),
                           F.concat(F.lit("Memory "), shown["old_id"], F.lit(" cannot supersede itself"))))
    fine = F.col("_error").isNull()
    p = p.withColumn("_turn", F.when(fine, F.row_number().over(Window.partitionBy("old_id", fine).orderBy("new_id"))))
    taker = F.coalesce(F.col("_turn") == 1, F.lit(False))
    first = Window.partitionBy("new_id", taker).orderBy("old_id")
    p = p.withColumn("_place", F.when(taker, F.row_number().over(first))).withColumn(
        "_first", F.when(taker, F.first("old_id").over(first)))
    p = p.withColumn("_error", F.when(~fine, F.col("_error")).when(F.col("_turn") > 1, gone).when(
        F.col("_place") > 1, F.concat(F.lit("New memory "), shown["new_id"], F.lit(" already supersedes "), "_first")))
    rep = p.select("old_id", "new_id", "user_id", F.col("_error").alias("error"))
    good = p.where(F.col("_error").isNull())
    sup = good.select(F.col("new_id").alias("memory_id"), F.col("old_id").alias("_sup"))
    dead = good.select(F.col("old_id").alias("memory_id"), F.lit(True).alias("_dead"))
    j = memories.join(sup, "memory_id", "left").join(dead, "memory_id", "left")
    out = _set_cols(j, {"supersedes": F.coalesce("_sup", "supersedes"),
                        "deleted_at": F.when(F.col("_dead"), as_of).otherwise(F.col("deleted_at")),
                        # stamped like any other change, so that the backup sees it
                        "updated_at": F.when(F.col("_dead") | F.col("_sup").isNotNull(), as_of)
                        .otherwise(F.col("updated_at"))})
    return out.select(*memories.columns), rep


def dedup_upsert(memories: DataFrame, incoming: DataFrame, as_of: Column, t: float = 0.95, *,
                 order_col: str = "request_id", block_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Store a batch of new memories with de-duplication.

    incoming: request_id, user_id, memory_category, memory_subtype, content,
    summary, embedding, importance, entities (``order_col`` gives request
    order).  Set-based rule for a batch:
      1. each incoming row is matched against the *table*: its best live row
         of the same user with similarity >= t is updated (content, summary,
         embedding, importance; access_count + 1, last_accessed = updated_at
         = as_of; category and entities kept).  Several incoming rows hitting
         one row: the latest in request order supplies the values and
         access_count grows by the number of hits;
      2. the rest become new rows, except that a new row merges into the
         earliest earlier new row similar to it (>= t).  If that one merged
         itself, both belong to the same root (as one after the other: a merge
         replaces the vector that the next row meets), so every row reported
         ends in a row that exists, with the last content, and access_count is
         the number of merges.
    event_time, is_temporal, metadata, source_session, source_type,
    confidence and org_id are kept where ``incoming`` has them.
    Returns (table after, report: request_id, action, memory_id)."""
    from ..plans.blocking import BLOCK_ROWS
    from .search import knn_exact
    br = block_rows or BLOCK_ROWS
    best = knn_exact(incoming, memories, 1, qid="request_id", block_rows=br, score="similarity")
    matched = best.where(F.col("similarity") >= t).select("request_id", "memory_id")
    # the match result feeds four branches (updates, inserts, merges,
    # report): materialise it once in the shared checkpoint folder instead of
    # re-running the vector search per branch
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(incoming.sparkSession)
    inc = incoming.join(matched, "request_id", "left").checkpoint(eager=True)
    to_table = inc.where(F.col("memory_id").isNotNull())
    fresh = inc.where(F.col("memory_id").isNull()).drop("memory_id")
    # 1. table updates
    # hits per target and the latest values: a partial aggregate, so a row hit
    # by a third of the batch is combined map-side before the shuffle
    last = F.struct(F.col("content").alias("_c"), F.col("summary").alias("_s"),
                    F.col("embedding").alias("_v"), F.col("importance").alias("_i"))
    upd = (to_table.groupBy("memory_id")
           .agg(F.count(F.lit(1)).alias("_hits"), F.max_by(last, F.col(order_col)).alias("_last"))
           .select("memory_id", "_hits", "_last._c", "_last._s", "_last._v", "_last._i"))
    j = memories.join(upd, "memory_id", "left")
    hit = F.col("_hits").isNotNull()
    updated = _set_cols(j, {
        "content": F.when(hit, F.col("_c")).otherwise(F.col("content")),
        "summary": F.when(hit, F.col("_s")).otherwise(F.col("summary")),
        "embedding": F.when(hit, F.col("_v")).otherwise(F.col("embedding")),
        "importance": F.when(hit, F.col("_i")).otherwise(F.col("importance")),
        "access_count": F.when(hit, F.col("access_count") + F.col("_hits").cast("int")).otherwise(F.col("access_count")),
        "last_accessed": F.when(hit, as_of).otherwise(F.col("last_accessed")),
        "updated_at": F.when(hit, as_of).otherwise(F.col("updated_at")),
    }).select(*memories.columns)
    # 2. in-batch leaders among new rows (pairs inside a user, each cut to its
    #    earlier rows; the leader is the earliest similar one)
    f = fresh.select("request_id", "user_id", "embedding", F.col(order_col).alias("_ord"))
    lead = _leaders(f, t, br)
    new_rows = fresh.join(lead, "request_id", "left")
    leaders = new_rows.where(F.col("leader") == F.col("request_id"))
    merged = new_rows.where(F.col("leader") != F.col("request_id"))
    agg = merged.groupBy("leader").agg(F.count(F.lit(1)).cast("int").alias("_extra"),
                                       F.max_by(F.struct("content", "summary", "embedding", "importance"),
                                                F.col(order_col)).alias("_last"))
    ins = leaders.join(agg, "leader", "left")
    has = F.col("_extra").isNotNull()

    def given(c: str, default: Column) -> Column:
        return (F.coalesce(F.col(c), default) if c in incoming.columns else default).alias(c)

    inserted = ins.select(
        F.concat(F.lit("n-"), F.col("request_id")).alias("memory_id"), "user_id",
        given("org_id", F.lit(None).cast("string")), "memory_category", "memory_subtype",
        F.when(has, F.col("_last.content")).otherwise(F.col("content")).alias("content"),
        F.when(has, F.col("_last.summary")).otherwise(F.col("summary")).alias("summary"),
        F.when(has, F.col("_last.embedding")).otherwise(F.col("embedding")).alias("embedding"),
        "entities", given("metadata", F.lit(None).cast("string")),
        given("event_time", F.lit(None).cast("timestamp_ntz")),
        given("is_temporal", F.col("event_time").isNotNull() if "event_time" in incoming.columns else F.lit(False)),
        F.when(has, F.col("_last.importance")).otherwise(F.col("importance")).alias("importance"),
        F.coalesce("_extra", F.lit(0)).alias("access_count"), F.lit(1.0).alias("decay_factor"),
        F.lit(None).cast("string").alias("supersedes"), given("source_session", F.lit(None).cast("string")),
        given("source_type", F.lit("conversation")), given("confidence", F.lit(1.0)),
        as_of.alias("created_at"), F.when(has, as_of).alias("last_accessed"), as_of.alias("updated_at"),
        F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    out = updated.unionByName(inserted.select(*memories.columns), allowMissingColumns=False)
    rep = (to_table.select("request_id", F.lit("updated").alias("action"), "memory_id")
           .unionByName(new_rows.select("request_id",
                                        F.when(F.col("leader") == F.col("request_id"), "inserted")
                                        .otherwise("merged").alias("action"),
                                        F.concat(F.lit("n-"), F.col("leader")).alias("memory_id"))))
    return out, rep


#: Columns that a request to store may bring beside request_id, user_id and content.
STORE_OPTIONAL = {"memory_category": "string", "memory_subtype": "string", "importance": "double",
                  "entities": "array<string>", "summary": "string", "questions": "array<string>",
                  "embedding": "array<float>", "event_time": "timestamp_ntz", "metadata": "string",
                  "source_session": "string"}
DEFAULT_IMPORTANCE = 0.5


def store_memories(memories: DataFrame, requests: DataFrame, as_of: Column, dim: int, t: float = 0.95, *,
                   classifier=None, embedder=None, block_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The whole way of a batch of texts into the table: secret gate, classification,
    taxonomy check, entities, summary, search text, vector, de-duplicating upsert.

    requests: request_id, user_id, content, and any of ``STORE_OPTIONAL`` (a missing
    column is NULL).  Per request:
      1. a text that is NULL or empty is ``invalid``; one with a critical or high finding
         is ``refused``, and nothing of it goes further;
      2. without a category or subtype the classifier fills in what is missing; only then
         it also sets an importance that is NULL or 0.5 and entities that are NULL or empty;
      3. a pair outside the taxonomy is ``invalid``;
      4. entities still missing are taken from the text; a text of over 50 estimated tokens
         gets the given summary or, where that is unusable, its beginning;
      5. usable questions are added to the text that is embedded (``dim`` components) unless the
         request brings a vector of its own;
      6. the rest goes through :func:`dedup_upsert`.
    Returns (table after, report: request_id, action (refused, invalid, updated, inserted or
    merged), memory_id, message, memory_category, memory_subtype, importance, entities,
    summary, content_tokens).  request_id must be unique."""
    from ..session import ensure_checkpoint_dir
    from .filters import validate_taxonomy
    from .gating import (augment_text, classify, embed, extract_entities, filter_questions, gate_secrets,
                         summarize_fallback, token_estimate)
    ensure_checkpoint_dir(requests.sparkSession)
    r = requests.select("request_id", "user_id", "content", *[
        (F.col(c) if c in requests.columns else F.lit(None)).cast(kind).alias(c) for c, kind in STORE_OPTIONAL.items()])
    gated = gate_secrets(r, "content")
    empty = F.coalesce(F.length("content") == 0, F.lit(True))
    gated = gated.select(*r.columns, F.when(empty, F.lit("no content")).otherwise(F.col("error_message")).alias("message"),
                         F.when(empty, "invalid").when(F.col("error_message").isNotNull(), "refused").alias("action"))
    work = gated.withColumn("content", F.when(F.col("action").isNull(), F.col("content")))
    closed = None
    if classifier or embedder:                            # no model sees a text that was refused
        work = work.checkpoint(eager=True)
        closed = work.where(F.col("action").isNotNull()).select("request_id", "action", "message")
        work = work.where(F.col("action").isNull())
    # what the request brings stands aside while the classifier adds columns of the same names
    both = ["memory_category", "memory_subtype", "importance", "entities"]
    c = classify(work.withColumnsRenamed({x: f"_given_{x}" for x in both}), "content", classifier)
    c = c.withColumnsRenamed({x: f"_{x}" for x in both}).withColumnsRenamed({f"_given_{x}": x for x in both})
    lacks = F.coalesce(F.length("memory_category") == 0, F.lit(True)) | F.coalesce(F.length("memory_subtype") == 0, F.lit(True))
    bare = F.coalesce(F.size("entities") <= 0, F.lit(True))
    filled = c.withColumns({
        "memory_category": F.coalesce(F.nullif("memory_category", F.lit("")), "_memory_category"),
        "memory_subtype": F.coalesce(F.nullif("memory_subtype", F.lit("")), "_memory_subtype"),
        "importance": F.when(lacks & F.coalesce(F.col("importance") == DEFAULT_IMPORTANCE, F.lit(True)),
                             F.col("_importance")).otherwise(F.coalesce("importance", F.lit(DEFAULT_IMPORTANCE))),
        "entities": F.when(lacks & bare, F.col("_entities")).otherwise(F.col("entities"))})
    wrong = F.col("action").isNull() & ~F.col("is_valid")
    judged = validate_taxonomy(filled.select(*work.columns)).withColumns({
        "message": F.when(wrong, F.concat(F.lit("Subtype "), "memory_subtype", F.lit(" is not one of category "),
                                          "memory_category")).otherwise(F.col("message")),
        "action": F.when(wrong, "invalid").otherwise(F.col("action")),
        "entities": F.when(F.coalesce(F.size("entities") <= 0, F.lit(True)), extract_entities("content"))
        .otherwise(F.col("entities")),
        "summary": summarize_fallback("summary", "content"),
        "_search": augment_text("content", filter_questions("questions")),
        "_given": F.col("embedding")}).drop("embedding")
    judged = embed(judged, "_search", "_made", dim=dim, model=embedder)
    # every text is judged once: what follows reads it several times
    judged = judged.select(*[x for x in judged.columns if x not in ("_search", "_given", "_made", "questions", "is_valid")],
                           F.coalesce("_given", "_made").alias("embedding")).checkpoint(eager=True)
    ready = judged.where(F.col("action").isNull()).drop("action", "message")
    out = judged.where(F.col("action").isNotNull()).select("request_id", "action", "message")
    after, stored = dedup_upsert(memories, ready, as_of, t, block_rows=block_rows)
    kept = ready.select("request_id", "memory_category", "memory_subtype", "importance", "entities", "summary",
                        token_estimate("content").alias("content_tokens"))
    report = stored.join(kept, "request_id").withColumn("message", F.lit(None).cast("string"))
    report = report.unionByName(out if closed is None else out.unionByName(closed), allowMissingColumns=True)
    return after, report.select("request_id", "action", "memory_id", "message", "memory_category", "memory_subtype",
                                "importance", "entities", "summary", "content_tokens")


def _leaders(f: DataFrame, t: float, block_rows: int) -> DataFrame:
    """leader = the root over "earliest (by ``_ord``) earlier new row of the same
    user with cosine >= t", itself when there is none (blocked matrix kernel,
    no pair ever becomes a row).  Pointers are doubled until none changes; each
    round ends in the shared checkpoint folder."""
    from .search import first_similar_earlier
    first = first_similar_earlier(f, t, rid="request_id", order="_ord", block_rows=block_rows)
    lead = (f.select("request_id").join(first, "request_id", "left")
            .select("request_id", F.coalesce("first_id", "request_id").alias("leader"))).checkpoint(eager=True)
    while True:
        up = lead.select(F.col("request_id").alias("leader"), F.col("leader").alias("_up"))
        lead = lead.join(up, "leader").select("request_id", F.col("_up").alias("leader"),
                                              (F.col("_up") != F.col("leader")).alias("_moved")).checkpoint(eager=True)
        if lead.where("_moved").limit(1).count() == 0:
            return lead.drop("_moved")
        lead = lead.drop("_moved")


def reembed_stale(memories: DataFrame, cache: DataFrame, dim: int, embedder=None) -> DataFrame:
    """Rows whose vector is missing or of another dimension get one: texts
    already in ``cache`` (text_hash = SHA-256 of the text in hex, embedding of
    ``dim`` components; other entries are ignored) are reused, distinct missing
    texts are embedded once (``embed``), and the table is returned whole."""
    from .gating import embed
    stale = F.col("embedding").isNull() | (F.size("embedding") != dim)
    cache = cache.where(F.size("embedding") == dim)
    m = memories.withColumn("_h", F.sha2("content", 256)).withColumn("_stale", stale)
    need = m.where("_stale").select("_h", "content").dropDuplicates(["_h"])
    missing = need.join(cache.select(F.col("text_hash").alias("_h")), "_h", "left_anti")
    fresh = embed(missing, "content", "_newvec", dim=dim, model=embedder).select("_h", F.col("_newvec").alias("_nv"))
    vecs = cache.select(F.col("text_hash").alias("_h"), F.col("embedding").alias("_nv")).unionByName(fresh)
    j = m.join(vecs.dropDuplicates(["_h"]), "_h", "left")
    return (j.withColumn("embedding", F.when(F.col("_stale"), F.col("_nv")).otherwise(F.col("embedding")))
            .select(*memories.columns))


def checkpoint_candidates(items: DataFrame, classified_importance: str = "importance_cls") -> DataFrame:
    """Unpinned, >= 20 tokens, relevance >= 0.3, not system / retrieved_memory,
    classified importance >= 0.4."""
    return items.where(~F.col("pinned") & (F.col("token_count") >= 20) & (F.col("relevance_score") >= 0.3)
                       & ~F.col("content_type").isin("system", "retrieved_memory")
                       & (F.col(classified_importance) >= 0.4))


def checkpoint(items: DataFrame, memories: DataFrame, sessions: DataFrame, as_of: Column,
               dim: int, t: float = 0.9, embedder=None, block_rows: int | None = None):
    """Promote worthy working items: classify, embed, match against the
    user's live memories (best > t strictly -> access bump, else a new row
    with source_type 'checkpoint'); promoted items leave working memory and
    the session total drops by their tokens.  Returns (memories, items,
    sessions, report per session: created, updated, tokens_freed)."""
    from ..plans.blocking import BLOCK_ROWS
    from .gating import classify, embed
    from .search import knn_exact
    br = block_rows or BLOCK_ROWS
    cls = classify(items.select("item_id", "session_id", "user_id", "content", "content_type", "token_count",
                                "relevance_score", "pinned"), "content")
    cls = cls.withColumnRenamed("importance", "importance_cls")
    cand = checkpoint_candidates(cls)
    cand = embed(cand, "content", "embedding", dim=dim, model=embedder)
    best = knn_exact(cand.withColumnRenamed("item_id", "request_id"), memories, 1, block_rows=br,
                     score="similarity", tiebreak=())
    hit = best.where(F.col("similarity") > t).select(F.col("request_id").alias("item_id"), "memory_id")
    c2 = cand.join(hit, "item_id", "left")
    bumps = c2.where(F.col("memory_id").isNotNull()).groupBy("memory_id").agg(
        F.count(F.lit(1)).cast("int").alias("_n"))
    j = memories.join(bumps, "memory_id", "left")
    bumped = _set_cols(j, {
        "access_count": F.when(F.col("_n").isNotNull(), F.col("access_count") + F.col("_n")).otherwise(F.col("access_count")),
        "last_accessed": F.when(F.col("_n").isNotNull(), as_of).otherwise(F.col("last_accessed"))}) \
        .select(*memories.columns)
    new = c2.where(F.col("memory_id").isNull()).select(
        F.concat(F.lit("c-"), F.col("item_id")).alias("memory_id"), "user_id", F.lit(None).cast("string").alias("org_id"),
        "memory_category", "memory_subtype", "content", F.lit(None).cast("string").alias("summary"),
        "embedding", "entities", F.lit(None).cast("string").alias("metadata"),
        F.lit(None).cast("timestamp_ntz").alias("event_time"), "is_temporal",
        F.col("importance_cls").alias("importance"), F.lit(0).alias("access_count"), F.lit(1.0).alias("decay_factor"),
        F.lit(None).cast("string").alias("supersedes"), F.col("session_id").alias("source_session"),
        F.lit("checkpoint").alias("source_type"), F.lit(1.0).alias("confidence"),
        as_of.alias("created_at"), as_of.alias("last_accessed"), as_of.alias("updated_at"),
        F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    mem_out = bumped.unionByName(new.select(*memories.columns))
    promoted = c2.select("item_id", "session_id", "token_count", F.col("memory_id").isNotNull().alias("_upd"))
    items_out = items.join(promoted.select("item_id"), "item_id", "left_anti")
    rep = promoted.groupBy("session_id").agg(
        F.count_if(~F.col("_upd")).alias("memories_created"), F.count_if("_upd").alias("memories_updated"),
        F.sum("token_count").cast("long").alias("tokens_freed"))
    s = sessions.join(rep.select("session_id", "tokens_freed"), "session_id", "left")
    ses_out = _set_cols(s, {"total_tokens": (F.col("total_tokens") - F.coalesce("tokens_freed", F.lit(0))).cast("int")}) \
        .select(*sessions.columns)
    return mem_out, items_out, ses_out, rep


def extract_memories(turns: DataFrame, memories: DataFrame, as_of: Column, dim: int, t: float = 0.9,
                     embedder=None):
    """Turn log (conv / session, turn, role, text) -> classified candidate
    memories (user turns only), embedded and stored with ``dedup_upsert``."""
    from .gating import classify, embed, summarize_fallback
    c = classify(turns.where(F.col("role") == "user"), "text")
    c = embed(c, "text", "embedding", dim=dim, model=embedder)
    inc = c.select(F.concat_ws("-", F.lit("t"), F.lpad(F.col("conv_id").cast("string"), 8, "0"),
                               F.lpad(F.col("turn").cast("string"), 5, "0")).alias("request_id"),
                   "user_id", "memory_category", "memory_subtype", F.col("text").alias("content"),
                   summarize_fallback(F.lit(None).cast("string"), F.col("text")).alias("summary"), "embedding",
                   "importance", "entities")
    return dedup_upsert(memories, inc, as_of, t=t)


def recurring_issues(items: DataFrame, n: int = 3) -> DataFrame:
    """Items shaped ``ISSUE_LOG: type | description | resolution``: issue types
    seen at least n times per user, with the latest resolution."""
    body = F.regexp_extract("content", r"^ISSUE_LOG:\s*(.*)$", 1)
    parts = F.split(body, r"\s*\|\s*")
    issues = (items.where(F.col("content").startswith("ISSUE_LOG:"))
              .select("user_id", F.trim(parts[0]).alias("issue_type"), F.trim(F.element_at(parts, -1)).alias("resolution"),
                      F.struct("sequence_num", "item_id").alias("_ord")))
    return (issues.groupBy("user_id", "issue_type")
            .agg(F.count(F.lit(1)).alias("occurrences"), F.max_by("resolution", "_ord").alias("latest_resolution"))
            .where(F.col("occurrences") >= n))
