"""Vector scoring and nearest-neighbour search over whole tables.

Every search is a batch: a table of queries against a table of memories,
equi-joined on the tenant key (never a cross join of tenants), scored with a
native dot-product expression and cut per query with ``row_number``.  The
blocked pairing in ``plans.blocking`` keeps a hot tenant from landing in one
task.  Ranking always ends in the memory id, so ties are deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vector as V
from ..plans.blocking import BLOCK_ROWS, blocked, blocked_join
from .filters import live

Q_VEC, M_VEC, Q_NORM, M_NORM, DIM = "_q_vec", "_m_vec", "_q_norm", "_m_norm", "_dim"
# query rows scored per matrix product inside a block, and cells that its score
# matrix has at most (fewer rows are taken against a larger block)
QUERY_CHUNK, CHUNK_CELLS = 512, 1 << 21
# signs that ann_lsh takes for a band, of which it compares the first ones
MOST_BITS = 14
# bands of ann_lsh for vectors whose nearest cosines are about 0.1 to 0.5
UNCLUSTERED_BANDS = 192
# rows of a block of ann_lsh
LSH_BLOCK_ROWS = 8192
# knn_exact by SQL: one of FLOOR_PART memories gives the floors, by best scores of FLOOR_BINS x k bins
FLOOR_PART, FLOOR_BINS = 8, 4


def _prep(queries: DataFrame, memories: DataFrame, keys, qid, mid, qvec, mvec,
          tiebreak, carry, live_only, qcarry=()):
    # Every column is re-aliased so both sides get fresh attribute ids: the two
    # inputs are often the same table (self-similarity), and the blocked join
    # below would otherwise be an ambiguous self-join.
    def fresh(names):
        return [F.col(c).alias(c) for c in names]
    qextra = list(dict.fromkeys(c for c in qcarry if c not in keys and c != qid))
    # a row without a vector cannot be near anything; vectors of different lengths never meet
    q = queries.where(has_vector(qvec)).select(*fresh([*keys, qid, *qextra]), F.size(qvec).alias(DIM),
                                               F.col(qvec).alias(Q_VEC), V.norm(qvec).alias(Q_NORM))
    m = live(memories) if live_only else memories
    extra = [c for c in list(tiebreak) + list(carry or []) if c not in keys and c != mid]
    extra = list(dict.fromkeys(extra))
    m = m.where(has_vector(mvec)).select(*fresh([*keys, mid]), F.size(mvec).alias(DIM), F.col(mvec).alias(M_VEC),
                                         V.norm(mvec).alias(M_NORM), *fresh(extra))
    return q, m


def has_vector(vec: str) -> Column:
    """Whether a row can take part in a search: its vector is there, not empty,
    and without null components."""
    return F.col(vec).isNotNull() & (F.size(vec) > 0) & F.forall(F.col(vec), lambda x: x.isNotNull())


def _order(score: str, tiebreak: Sequence[str], mid: str) -> list[Column]:
    return ([F.col(score).desc_nulls_last()] + [F.col(t).desc_nulls_last() for t in tiebreak]
            + [F.col(mid).asc()])


def knn_exact(queries: DataFrame, memories: DataFrame, k: int, *,
              keys: Sequence[str] = ("user_id",), qid: str = "request_id",
              mid: str = "memory_id", qvec: str = "embedding", mvec: str = "embedding",
              tiebreak: Sequence[str] = ("importance",), carry: Sequence[str] | None = None,
              live_only: bool = True, block_rows: int | None = BLOCK_ROWS,
              score: str = "score", rank: str = "rank", qcarry: Sequence[str] = (),
              method: str = "block", exclude_col: str | None = None) -> DataFrame:
    """Per query: rows of the same tenant (``keys``), live only, ordered by
    cosine desc, ``tiebreak`` desc, id asc; the first ``k`` (pre-filter
    semantics).  Output: qid, keys, qcarry, mid, tiebreak + carry, score, rank.

    method="block" (default) scores each (tenant, query block, memory block)
    as one dense matrix product in an Arrow batch and emits only its k best
    rows per query, so pairs never become rows.  method="sql" scores pairs
    with a native dot-product expression after a blocked equi-join.

    ``exclude_col`` names a query-side column; a memory whose id equals it is
    not a candidate (self-exclusion before the top-k cut)."""
    keys = list(keys)
    tiebreak = list(tiebreak)
    qcarry = list(qcarry) + ([exclude_col] if exclude_col and exclude_col not in qcarry else [])
    q, m = _prep(queries, memories, keys, qid, mid, qvec, mvec, tiebreak, carry, live_only, qcarry)
    if method == "sql":
        scored = _sql_scores(q, m, k, keys, qid, mid, score, block_rows, exclude_col)
    elif method == "block":
        scored = _block_scores(q, m, k, keys, qid, mid, tiebreak, score, block_rows or BLOCK_ROWS,
                               exclude_col)
    else:
        raise ValueError(f"unknown knn method {method!r}")
    w = Window.partitionBy(qid).orderBy(*_order(score, tiebreak, mid))
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def knn_block(queries: DataFrame, memories: DataFrame, k: int, **kw) -> DataFrame:
    """``knn_exact`` with the dense matrix-product kernel (the default)."""
    kw["method"] = "block"
    return knn_exact(queries, memories, k, **kw)


def _sql_scores(q: DataFrame, m: DataFrame, k: int, keys, qid, mid, score, block_rows, exclude_col):
    """The pairs of a key group that may be among the ``k`` best of their query, scored natively."""
    dim = q.agg(F.max(DIM)).first()[0] or 0
    if dim <= V.MOST_PARTS:
        q, m = V.with_parts(q, Q_VEC, dim, "_q"), V.with_parts(m, M_VEC, dim, "_m")
        dot = V.dot_parts(dim, "_q", "_m")
    else:
        dot = V.dot(Q_VEC, M_VEC)

    def scores(asked: DataFrame, rows: DataFrame) -> DataFrame:
        pairs = blocked_join(asked, rows, [*keys, DIM], qid, mid, block_rows)
        if exclude_col:
            pairs = pairs.where(F.col(mid) != F.col(exclude_col))
        return pairs.withColumn(score, V.cosine_from_parts(dot, F.col(Q_NORM), F.col(M_NORM)))

    # the best scores of k bins are scores of k rows, so the k-th best row has no less
    bin_ = F.xxhash64(mid, F.lit(1))
    part = m.where(F.pmod(bin_, F.lit(FLOOR_PART)) == 0).withColumn(
        "_bin", F.pmod(F.shiftright(bin_, 8), F.lit(FLOOR_BINS * k)))
    best = scores(q, part).groupBy(F.col(qid).alias("_of"), "_bin").agg(F.max(score).alias("_best"))
    floor = best.groupBy("_of").agg(F.get(F.sort_array(F.collect_list("_best"), asc=False), F.lit(k - 1)).alias("_floor"))
    q = q.join(floor, F.col(qid).eqNullSafe(F.col("_of")), "left").drop("_of")
    parts = [c for c in (*q.columns, *m.columns) if c in (Q_VEC, M_VEC, Q_NORM, M_NORM, DIM, "_floor")]
    parts += [f"{side}{i}" for side in ("_q", "_m") for i in range(dim)]
    return scores(q, m).where(F.col("_floor").isNull() | (F.col(score) >= F.col("_floor"))).drop(*parts)


def _block_scores(q: DataFrame, m: DataFrame, k: int, keys, qid, mid, tiebreak, score, block_rows,
                  exclude_col=None, floor=None, bands=None):
    q2, m2, on = blocked(q, m, [*keys, DIM], qid, mid, block_rows)
    q_out = [c for c in q.columns if c not in (Q_VEC, Q_NORM, DIM)]
    m_out = [c for c in m.columns if c not in (M_VEC, M_NORM, DIM) and c not in keys]
    schema = T.StructType([q.schema[c] for c in q_out] + [m.schema[c] for c in m_out]
                          + [T.StructField(score, T.DoubleType())])
    fn = _block_topk_fn(k, q_out, m_out, mid, list(tiebreak), score, exclude_col, floor, bands)
    return (q2.groupBy(*on).cogroup(m2.groupBy(*on)).applyInPandas(fn, schema))


def _block_topk_fn(k: int, q_out: list[str], m_out: list[str], mid: str, tiebreak: list[str], score: str,
                   exclude_col: str | None = None, floor: str | None = None,
                   bands: tuple[int, int] | None = None):
    def fn(qdf: pd.DataFrame, mdf: pd.DataFrame) -> pd.DataFrame:
        if len(qdf) == 0 or len(mdf) == 0:
            out = pd.concat([qdf[q_out].iloc[:0].reset_index(drop=True),
                             mdf[m_out].iloc[:0].reset_index(drop=True)], axis=1)
            out[score] = pd.Series([], dtype="float64")
            return out
        M = np.stack(mdf[M_VEC].to_numpy()).astype(np.float64)
        mn = mdf[M_NORM].to_numpy(dtype=np.float64)
        mid_rank = np.argsort(np.argsort(mdf[mid].to_numpy().astype(str), kind="stable"), kind="stable")
        ties = [mdf[t].to_numpy(dtype=np.float64) for t in tiebreak]
        met = _meeting(M, qdf["_bits"].iloc[0], *bands) if bands else None
        # score the query rows in chunks so a block's score matrix stays small
        step = max(1, min(QUERY_CHUNK, CHUNK_CELLS // len(mdf)))
        parts = [_topk_chunk(qdf.iloc[i:i + step], mdf, M, mn, mid_rank, ties, met)
                 for i in range(0, len(qdf), step)]
        return pd.concat(parts, ignore_index=True)

    def _topk_chunk(qdf, mdf, M, mn, mid_rank, ties, met):
        Q = np.stack(qdf[Q_VEC].to_numpy()).astype(np.float64)
        den = np.outer(qdf[Q_NORM].to_numpy(dtype=np.float64), mn)
        with np.errstate(divide="ignore", invalid="ignore"):
            S = np.where(den > 0, (Q @ M.T) / den, np.nan)
        fill = np.where(np.isnan(S), -np.inf, S)
        allowed = None
        if exclude_col:
            allowed = qdf[exclude_col].to_numpy().astype(str)[:, None] != mdf[mid].to_numpy().astype(str)[None, :]
        if met is not None:
            allowed = met(Q) if allowed is None else allowed & met(Q)
        if allowed is not None:
            fill = np.where(allowed, fill, -np.inf)
        n = S.shape[1]
        kk = min(k, n)
        thr = np.partition(fill, n - kk, axis=1)[:, n - kk]
        cand = fill >= thr[:, None]
        if allowed is not None:
            cand &= allowed
        if floor:  # a score that the query has k rows at: nothing below it is needed
            cand &= ~(fill < qdf[floor].to_numpy(dtype=np.float64)[:, None])
        qi, mj = np.nonzero(cand)
        # order: query, score desc, tiebreaks desc (nulls last), id asc
        sort_keys = [mid_rank[mj]]
        for tv in reversed(ties):
            sort_keys.append(np.where(np.isnan(tv[mj]), np.inf, -tv[mj]))
        sort_keys += [-fill[qi, mj], qi]
        order = np.lexsort(sort_keys)
        qi, mj = qi[order], mj[order]
        starts = np.r_[0, np.flatnonzero(np.diff(qi)) + 1]
        pos = np.arange(len(qi)) - np.repeat(starts, np.diff(np.r_[starts, len(qi)]))
        keep = pos < kk
        qi, mj = qi[keep], mj[keep]
        out = pd.concat([qdf[q_out].iloc[qi].reset_index(drop=True),
                         mdf[m_out].iloc[mj].reset_index(drop=True)], axis=1)
        out[score] = S[qi, mj]
        return out
    return fn


def knn_post_filter(queries: DataFrame, memories: DataFrame, k: int, *,
                    qid: str = "request_id", mid: str = "memory_id",
                    qvec: str = "embedding", mvec: str = "embedding",
                    block_rows: int | None = None) -> DataFrame:
    """Index semantics: global top-k over *all* rows first (any tenant, deleted
    included), then keep the caller's own live rows -> may return fewer than k.

    The global search is ``cells.knn_cells``: exact, by cells of near rows, so that
    cells too far to reach a query's k-th score are not scored for it."""
    from .cells import knn_cells
    q = queries.select(qid, F.col("user_id").alias("_req_user"), qvec)
    m = memories.select(mid, "user_id", "deleted_at", "importance", mvec)
    top = knn_cells(q, m, k, qid=qid, mid=mid, qvec=qvec, mvec=mvec, carry=["user_id", "deleted_at"],
                    qcarry=["_req_user"], live_only=False, block_rows=block_rows,
                    rank="global_rank")
    kept = top.where((F.col("user_id") == F.col("_req_user")) & F.col("deleted_at").isNull())
    w2 = Window.partitionBy(qid).orderBy("global_rank")
    return kept.select(qid, "user_id", mid, "score", "global_rank",
                       F.row_number().over(w2).alias("rank"))


def _band_signs(vecs: np.ndarray, bands: int, bits: int, seed: int) -> np.ndarray:
    """(bands, vectors): the signs of random projections as numbers of ``bits`` bits,
    the first of MOST_BITS.  Every vector length has normals of its own."""
    dim = vecs.shape[1]
    normals = np.random.default_rng((seed, dim)).normal(size=(bands * MOST_BITS, dim)).T
    out = np.empty((bands, len(vecs)), dtype=np.int32)
    for i in range(0, len(vecs), QUERY_CHUNK):
        up = (vecs[i:i + QUERY_CHUNK] @ normals > 0).reshape(-1, bands, MOST_BITS)[:, :, :bits]
        out[:, i:i + QUERY_CHUNK] = (up @ (1 << np.arange(bits - 1, -1, -1))).T
    return out


def _meeting(rows: np.ndarray, bits: int, bands: int, seed: int):
    """For query vectors: which of ``rows`` agree with each in all signs of a band."""
    signs = _band_signs(rows, bands, int(bits), seed)
    order = np.argsort(signs, axis=1, kind="stable")
    ordered = np.take_along_axis(signs, order, axis=1)

    def met(queries: np.ndarray) -> np.ndarray:
        out = np.zeros((len(queries), len(rows)), dtype=bool)
        for own, at, these in zip(_band_signs(queries, bands, int(bits), seed), order, ordered, strict=True):
            first = np.searchsorted(these, own, "left")
            n = np.searchsorted(these, own, "right") - first
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(np.arange(len(own)), n), at[np.repeat(first, n) + within]] = True
        return out
    return met


def ann_lsh(queries: DataFrame, memories: DataFrame, k: int, *, threshold: float = 0.0,
            qid: str = "request_id", mid: str = "memory_id", qvec: str = "embedding",
            mvec: str = "embedding", bands: int = 16, bits: int | None = 8, seed: int = 7) -> DataFrame:
    """Approximate neighbours of the same user by bands of random-projection
    signs, then the exact cosine: up to ``k`` live rows with cosine >=
    ``threshold``.

    Two vectors at angle a agree in a sign with probability 1 - a / pi, and are
    candidates when all ``bits`` signs of one of ``bands`` bands agree.  The
    defaults are for clustered vectors: candidates nearly always at cosine 0.9,
    in 94 % of cases at 0.8, in 6 % for unrelated ones, but in 20 % only at 0.3.
    Where the nearest cosines are as low as that, take UNCLUSTERED_BANDS bands
    and ``bits=None``: as many bits as suit the number of live rows of the user
    (log2(rows) / 2 + 2.6), since the nearest of few rows are the farther ones.

    Only vectors of equal length meet, and every length takes part.  Equal
    vectors of a user are one class, hashed once: a class of memories stands for
    its first ``k`` rows, all that a query can get of it, and what a class of
    queries finds holds for each of them.  Classes of a user meet in blocks, where
    the rows of every band are sorted by their signs; vectors alone travel, once
    for each block of the other side, never bands or pairs."""
    q, m = _prep(queries, memories, ["user_id"], qid, mid, qvec, mvec, ["importance"], None, True)
    in_class = Window.partitionBy("user_id", M_VEC).orderBy(F.col("importance").desc_nulls_last(), F.col(mid))
    m = m.withColumn("_place", F.row_number().over(in_class)).where(F.col("_place") <= k)
    q = q.withColumn("_q", F.xxhash64(Q_VEC))
    asked = q.select("user_id", "_q", qid)
    q = q.drop(qid).dropDuplicates(["user_id", "_q"])
    if bits is None:
        fit = F.round(F.log2(F.count(F.lit(1))) / 2 + F.lit(2.6)).cast("int")
        used = m.where(F.col("_place") == 1).groupBy("user_id", DIM).agg(F.least(F.lit(MOST_BITS), fit).alias("_bits"))
        q = q.join(used, ["user_id", DIM])
    else:
        q = q.withColumn("_bits", F.lit(bits))
    flat = _block_scores(q, m.drop("_place"), k, ["user_id"], "_q", mid, ["importance"], "score", LSH_BLOCK_ROWS,
                         bands=(bands, seed)).drop("_bits")
    flat = flat.where(F.col("score") >= threshold)
    order = _order("score", ["importance"], mid)
    best = F.row_number().over(Window.partitionBy("user_id", "_q").orderBy(*order))
    flat = flat.withColumn("_place", best).where(F.col("_place") <= k)
    out = asked.join(flat, ["user_id", "_q"]).select(qid, "user_id", mid, "importance", "score")
    rank = F.row_number().over(Window.partitionBy(qid).orderBy(*order))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def min_similarity_filter(scored: DataFrame, t: float, score: str = "score") -> DataFrame:
    return scored.where(F.col(score) >= F.lit(float(t)))


def entity_matches(focus, entities) -> Column:
    """Number of distinct focus entities present in the row's entities."""
    f = F.col(focus) if isinstance(focus, str) else focus
    e = F.col(entities) if isinstance(entities, str) else entities
    return F.coalesce(F.size(F.array_intersect(f, e)), F.lit(0))


def entity_boost(score, matches, mode: str = "recall") -> Column:
    """recall : min(1, s * (1 + 0.2 m))    (m = matching entities)
    context : s * (1 + 0.3 m), uncapped
    flat    : s * 1.3 when any entity matches"""
    s = F.col(score) if isinstance(score, str) else score
    m = F.col(matches) if isinstance(matches, str) else matches
    if mode == "recall":
        return F.when(m > 0, F.least(F.lit(1.0), s * (F.lit(1.0) + F.lit(0.2) * m))).otherwise(
            F.least(F.lit(1.0), s))
    if mode == "context":
        return F.when(m > 0, s * (F.lit(1.0) + F.lit(0.3) * m)).otherwise(s)
    if mode == "flat":
        return F.when(m > 0, s * F.lit(1.3)).otherwise(s)
    raise ValueError(mode)


def hybrid_relevance(scored: DataFrame, as_of: Column, *, score: str = "score",
                     type_weights: dict | None = None, default_type_weight: float = 0.25) -> DataFrame:
    """0.5 sim + 0.2 exp(-age_s / 30 d) + 0.1 ln(1+access)/ln(101) + 0.2 importance.

    Age is measured from ``last_accessed`` (created_at when never accessed) in
    fractional seconds.  With ``type_weights`` ("category.subtype" -> w) the sum
    is multiplied by the row's weight (default 0.25) and capped at 1."""
    last = F.coalesce(F.col("last_accessed"), F.col("created_at"))
    age_s = F.timestamp_diff("MICROSECOND", last, as_of).cast("double") / 1e6
    rel = (F.lit(0.5) * F.col(score)
           + F.lit(0.2) * F.exp(-age_s / F.lit(2592000.0))
           + F.lit(0.1) * (F.log(F.lit(1.0) + F.col("access_count")) / F.log(F.lit(101.0)))
           + F.lit(0.2) * F.col("importance"))
    if type_weights:
        key = F.concat_ws(".", "memory_category", "memory_subtype")
        tw = F.lit(float(default_type_weight))
        for kk, vv in type_weights.items():
            tw = F.when(key == kk, F.lit(float(vv))).otherwise(tw)
        rel = F.least(F.lit(1.0), rel * tw)
    return scored.withColumn("relevance_score", rel)


def typed_topk(requests: DataFrame, memories: DataFrame, weights: DataFrame | None = None, n: int = 5,
               min_similarity: float = 0.5, *, qid: str = "request_id",
               carry: Sequence[str] = ("content", "entities", "importance"),
               block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    """For each (request, category.subtype) of the request's intent profile:
    the top ``n`` live memories of that type by similarity, then drop those
    below ``min_similarity`` (filter after the cut, as the per-type query did).

    ``weights`` is either per intent (intent, memory_category,
    memory_subtype, weight) -- joined to ``requests`` on intent, a broadcast
    of a fixed-size profile table -- or per request (request_id, ...).  With
    ``weights=None`` the ``requests`` rows already carry the type columns."""
    if weights is None:
        q = requests
    elif "intent" in weights.columns:
        q = requests.join(F.broadcast(weights), "intent")
    else:
        q = requests.select(qid, "user_id", "embedding").join(weights, qid)
    q = q.select(qid, "user_id", "embedding", "memory_category", "memory_subtype", "weight") \
         .withColumn("_qk", F.concat_ws("|", qid, "memory_category", "memory_subtype"))
    hits = knn_exact(q, memories, n, keys=["user_id", "memory_category", "memory_subtype"],
                     qid="_qk", tiebreak=(), carry=list(carry), block_rows=block_rows,
                     score="similarity", qcarry=[qid, "weight"])
    return (hits.where(F.col("similarity").isNotNull() & (F.col("similarity") >= min_similarity))
            .drop("_qk"))


def near_duplicates(incoming: DataFrame, memories: DataFrame, t: float = 0.95, n: int = 3, *,
                    qid: str = "request_id", fetch: int = 10,
                    block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    """For each incoming row: among its ``fetch`` nearest live rows of the same
    user, up to ``n`` with similarity >= t, with a 100-char preview."""
    from .filters import preview
    # the 100-char preview is cut before the search, so texts never travel
    mem = memories.withColumn("content_preview", preview("content", 100))
    hits = knn_exact(incoming, mem, fetch, qid=qid, carry=["content_preview"], block_rows=block_rows,
                     score="similarity")
    hits = hits.where(F.col("similarity") >= t)
    w = Window.partitionBy(qid).orderBy("rank")
    return (hits.withColumn("dup_rank", F.row_number().over(w)).where(F.col("dup_rank") <= n)
            .select(qid, "user_id", "memory_id", "similarity", "dup_rank", "content_preview"))


def first_similar_earlier(rows: DataFrame, t: float, *, keys: Sequence[str] = ("user_id",),
                          rid: str = "request_id", order: str = "_ord", vec: str = "embedding",
                          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each row: the earliest (by ``order``) other row of the same key
    group that comes before it and has cosine >= t, or none.

    Computed as blocked matrix products: each (group, block, block) pair is
    one Arrow batch pair, masked to (similar and earlier), and reduced to at
    most one candidate per row before anything leaves the task; a final
    min-by over blocks picks the earliest.  Output: rid, first_id, first_ord."""
    keys = list(keys)
    rows = rows.where(has_vector(vec)).withColumn(DIM, F.size(vec))
    keys = [*keys, DIM]
    q = rows.select(*[F.col(c).alias(c) for c in [*keys, rid, order]], F.col(vec).alias(Q_VEC),
                    V.norm(vec).alias(Q_NORM))
    m = rows.select(*[F.col(c).alias(c) for c in keys], F.col(rid).alias("_cid"), F.col(order).alias("_cord"),
                    F.col(vec).alias(M_VEC), V.norm(vec).alias(M_NORM))
    q2, m2, on = blocked(q, m, keys, rid, "_cid", block_rows)
    schema = T.StructType([q.schema[rid], T.StructField("first_id", m.schema["_cid"].dataType),
                           T.StructField("first_ord", m.schema["_cord"].dataType)])

    def fn(qdf: pd.DataFrame, mdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({rid: qdf[rid].iloc[:0], "first_id": mdf["_cid"].iloc[:0],
                              "first_ord": mdf["_cord"].iloc[:0]})
        if len(qdf) == 0 or len(mdf) == 0:
            return empty
        M = np.stack(mdf[M_VEC].to_numpy()).astype(np.float64)
        mn = mdf[M_NORM].to_numpy(dtype=np.float64)
        mo = mdf["_cord"].to_numpy()
        rank = np.argsort(np.argsort(mo, kind="stable"), kind="stable").astype(np.int64)
        big = np.iinfo(np.int64).max
        parts = []
        for i in range(0, len(qdf), QUERY_CHUNK):
            qc = qdf.iloc[i:i + QUERY_CHUNK]
            Q = np.stack(qc[Q_VEC].to_numpy()).astype(np.float64)
            den = np.outer(qc[Q_NORM].to_numpy(dtype=np.float64), mn)
            with np.errstate(divide="ignore", invalid="ignore"):
                S = np.where(den > 0, (Q @ M.T) / den, -np.inf)
            qo = qc[order].to_numpy()
            ok = (S >= t) & (mo[None, :] < qo[:, None])
            has = ok.any(axis=1)
            if not has.any():
                continue
            pick = np.where(ok, rank[None, :], big).argmin(axis=1)
            qi = np.nonzero(has)[0]
            mj = pick[qi]
            parts.append(pd.DataFrame({rid: qc[rid].to_numpy()[qi], "first_id": mdf["_cid"].to_numpy()[mj],
                                       "first_ord": mo[mj]}))
        return pd.concat(parts, ignore_index=True) if parts else empty

    part = q2.groupBy(*on).cogroup(m2.groupBy(*on)).applyInPandas(fn, schema)
    return part.groupBy(rid).agg(F.min(F.struct("first_ord", "first_id")).alias("_m")) \
               .select(rid, F.col("_m.first_id").alias("first_id"), F.col("_m.first_ord").alias("first_ord"))
