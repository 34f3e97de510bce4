"""Exact nearest neighbours over one whole table by angle bounds.

Rows are placed in cells around centres fitted on a bounded sample, and within a
cell in rings by their angle to the centre.  By the triangle inequality of angles
a query at angle a to a centre can reach no row of a ring of angles lo to hi
better than the cosine of ``max(0, lo - a, a - hi)``.  Neighbouring rings form packs
of about a block of rows.  A first pass scores each query against the packs of its
nearest rings that hold ``k`` rows and gives it a k-th score; a second pass meets only
the packs that can still reach that score.  The centres
decide what is skipped, never what is found: the answer is that of a search over
all rows, whatever the sample was.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.blocking import BLOCK_ROWS
from ..session import ensure_checkpoint_dir
from .search import DIM, M_VEC, Q_VEC, _block_scores, _order, _prep

#: Cells of one vector length: the square root of its rows, at most this many.
MOST_CELLS = 1024
#: Rows that the centres of one length are fitted on, per cell.
SAMPLE_PER_CELL = 32
#: Rings over the half circle of angles.
RINGS = 16
#: Rows compared with all centres at a time.
CHUNK = 1024
#: Taken off a k-th score before a bound is held against it (rounding of angles).
SLACK = 1e-6
#: Ring of the rows whose cosine is undefined (zero or non-finite length).
NO_ANGLE = -1
#: Packs of a table; a pack has a block of rows at least and PACK_NUMBERS numbers at most.
PACKS, PACK_NUMBERS = 16, 1 << 22
RING, PACK = "_ring", "_pack"


def _units(vecs: Sequence) -> np.ndarray:
    """The vectors at unit length; NaN where they have no direction."""
    v = np.stack([np.asarray(x, dtype=np.float64) for x in vecs])
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        size = np.sqrt((v * v).sum(axis=1))
        return np.where((size > 0)[:, None] & np.isfinite(size)[:, None], v / size[:, None], np.nan)


def _fit(units: np.ndarray, cells: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of ``units`` by spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = units[rng.choice(len(units), size=min(cells, len(units)), replace=False)]
    for _ in range(rounds):
        sums, seen = np.zeros_like(centres), np.zeros(len(centres))
        for i in range(0, len(units), CHUNK):
            part = units[i:i + CHUNK]
            at = (part @ centres.T).argmax(axis=1)
            np.add.at(sums, at, part)
            np.add.at(seen, at, 1)
        size = np.sqrt((sums * sums).sum(axis=1))
        moved = (seen > 0) & (size > 0)
        centres[moved] = sums[moved] / size[moved, None]
    return centres


def sample_units(rows: DataFrame, vec: str, mid: str, dim: int, n: int, most: int) -> np.ndarray:
    """Unit vectors of at most ``most`` of the ``n`` rows of length ``dim``, chosen by
    a hash of the row's id."""
    share = F.lit(min(1.0, 1.1 * most / n) * 2 ** 30)
    got = rows.where((F.col(DIM) == dim) & (F.pmod(F.xxhash64(mid), F.lit(2 ** 30)) < share)).select(vec)
    got = got.limit(most).toPandas()[vec]
    units = _units(got) if len(got) else np.empty((0, dim))
    return units[np.isfinite(units).all(axis=1)]


def fit_centres(rows: DataFrame, vec: str, mid: str, seed: int = 7,
                cells: int | None = None) -> dict[int, np.ndarray]:
    """Per vector length (column DIM): centres of a sample of SAMPLE_PER_CELL rows
    for each of ``cells`` cells (default: square root of the rows, at most MOST_CELLS)."""
    out = {}
    for r in rows.groupBy(DIM).agg(F.count(F.lit(1)).alias("n")).collect():
        want = cells or max(1, min(MOST_CELLS, round(r["n"] ** 0.5)))
        units = sample_units(rows, vec, mid, r[DIM], r["n"], want * SAMPLE_PER_CELL)
        out[r[DIM]] = _fit(units, want, seed) if len(units) else np.eye(1, r[DIM])
    return out


def _placed(centres: dict[int, np.ndarray]):
    """Ring of a vector (its cell and the step of its angle) and that angle."""
    @F.pandas_udf("ring int, angle double")
    def place(vecs: pd.Series) -> pd.DataFrame:
        ring = np.full(len(vecs), NO_ANGLE, dtype=np.int32)
        angle = np.zeros(len(vecs))
        sizes = vecs.map(len).to_numpy()
        for dim in np.unique(sizes):
            rows = np.flatnonzero(sizes == dim)
            for i in range(0, len(rows), CHUNK):
                at = rows[i:i + CHUNK]
                units = _units(vecs.iloc[at])
                ok = np.isfinite(units).all(axis=1)
                cos = units[ok] @ centres[dim].T
                cell = cos.argmax(axis=1)
                a = np.arccos(np.clip(cos[np.arange(len(cell)), cell], -1, 1))
                step = np.minimum((a * (RINGS / np.pi)).astype(np.int64), RINGS - 1)
                ring[at[ok]], angle[at[ok]] = cell * RINGS + step, a
        return pd.DataFrame({"ring": ring, "angle": angle})
    return place


def _tour(centres: np.ndarray) -> np.ndarray:
    """Place of every centre on a walk that goes on to the nearest centre left."""
    cos = centres @ centres.T
    place, at = np.empty(len(centres), dtype=np.int64), 0
    for i in range(len(centres)):
        place[at] = i
        cos[:, at] = -np.inf
        at = int(cos[at].argmax())
    return place


def _packs(centres: dict[int, np.ndarray], table: pd.DataFrame, pack_rows: int) -> dict[int, pd.DataFrame]:
    """Per vector length its rings (ring, lo, hi, n) in the order of a walk along the
    centres, cut into packs of about ``pack_rows`` rows.  Queries travel to packs, so
    a query is sent no more often than a search in blocks would send it."""
    out = {}
    for dim, t in table.groupby(DIM):
        t = t.assign(walk=np.where(t["ring"] == NO_ANGLE, len(centres[dim]), _tour(centres[dim])[t["ring"] // RINGS]))
        t = t.sort_values(["walk", "ring"]).reset_index(drop=True)
        pack = (t["n"].cumsum() - t["n"]) // pack_rows
        out[int(dim)] = t.assign(pack=np.where(t["ring"] == NO_ANGLE, pack + 1, pack))
    return out


def _packs_to_visit(centres: dict[int, np.ndarray], rings: dict[int, pd.DataFrame], k: int, second: bool):
    """Per query (vector, k-th score so far) the packs of one pass: in the first those
    of the nearest rings that hold ``k`` rows, in the second all others with a ring
    whose bound reaches the score."""
    def visit(units: np.ndarray, kth: np.ndarray, dim: int) -> list[np.ndarray]:
        table = rings[dim]
        ids, lo, hi = table["ring"].to_numpy(), table["lo"].to_numpy(), table["hi"].to_numpy()
        held, pack = table["n"].to_numpy(), table["pack"].to_numpy()
        starts = np.r_[0, np.flatnonzero(np.diff(pack)) + 1]
        aimed = ids != NO_ANGLE
        ok = np.isfinite(units).all(axis=1)
        a = np.arccos(np.clip(np.where(ok[:, None], units, 0.0) @ centres[dim].T, -1, 1))[:, ids // RINGS]
        # a row without an angle comes after all others, whatever they reach
        bound = np.where(aimed, np.cos(np.maximum(0, np.maximum(lo - a, a - hi))), -1.0)
        nearest = np.where(aimed, np.maximum(a, (lo + hi) / 2), np.inf).argsort(axis=1, kind="stable")
        before = np.cumsum(held[nearest], axis=1) - held[nearest]
        first = np.zeros(bound.shape, dtype=bool)
        np.put_along_axis(first, nearest, before < k, axis=1)
        first = np.logical_or.reduceat(first, starts, axis=1)
        if not second:
            return [pack[starts[f]] for f in first]
        reach = ~(bound < (kth - SLACK)[:, None]) | ~ok[:, None]
        reach = np.logical_or.reduceat(reach, starts, axis=1)
        return [pack[starts[r]] for r in reach & ~first]

    @F.pandas_udf("array<int>")
    def chosen(vecs: pd.Series, kth: pd.Series) -> pd.Series:
        out = np.empty(len(vecs), dtype=object)
        sizes, scores = vecs.map(len).to_numpy(), kth.to_numpy(dtype=np.float64)
        for dim in np.unique(sizes):
            rows = np.flatnonzero(sizes == dim)
            for i in range(0, len(rows), CHUNK):
                at = rows[i:i + CHUNK]
                got = visit(_units(vecs.iloc[at]), scores[at], dim) if dim in rings else [[]] * len(at)
                for r, ids in zip(at, got, strict=True):
                    out[r] = np.asarray(ids, dtype=np.int32)
        return pd.Series(out)
    return chosen


def knn_cells(queries: DataFrame, memories: DataFrame, k: int, *, qid: str = "request_id",
              mid: str = "memory_id", qvec: str = "embedding", mvec: str = "embedding",
              tiebreak: Sequence[str] = ("importance",), carry: Sequence[str] | None = None,
              qcarry: Sequence[str] = (), live_only: bool = True, block_rows: int | None = BLOCK_ROWS,
              cells: int | None = None, seed: int = 7, score: str = "score",
              rank: str = "rank") -> DataFrame:
    """Per query the ``k`` rows of largest cosine of the whole table, as
    ``knn_exact`` without keys gives them (same order, same columns).

    Only vectors of equal length meet.  Rows without a direction have a null score
    and come last; a query without a direction meets all rows.  Null vectors, and
    those with null components, take no part.  ``qid`` must be unique."""
    tiebreak = list(tiebreak)
    spark = memories.sparkSession
    ensure_checkpoint_dir(spark)
    q, m = _prep(queries, memories, [], qid, mid, qvec, mvec, tiebreak, carry, live_only, qcarry)
    centres = fit_centres(m, M_VEC, mid, seed, cells)
    m = m.withColumn("_at", _placed(centres)(M_VEC))
    m = m.withColumn(RING, F.col("_at.ring")).withColumn("_angle", F.col("_at.angle")).drop("_at").checkpoint()
    # one row a ring: at most MOST_CELLS x RINGS of a length
    table = m.groupBy(DIM, F.col(RING).alias("ring")).agg(
        F.min("_angle").alias("lo"), F.max("_angle").alias("hi"), F.count(F.lit(1)).alias("n")).toPandas()
    if block_rows is None:
        longest = int(table[DIM].max()) if len(table) else 1
        block_rows = max(BLOCK_ROWS, min(int(table["n"].sum()) // PACKS, PACK_NUMBERS // longest))
    rings = _packs(centres, table, block_rows)
    pack_of = spark.createDataFrame([(dim, int(r), int(p)) for dim, t in rings.items() for r, p in zip(
        t["ring"], t["pack"], strict=True)], f"{DIM} int, {RING} int, {PACK} int")
    m = m.drop("_angle").join(pack_of, [DIM, RING]).drop(RING)

    def scored(asked: DataFrame, second: bool) -> DataFrame:
        visit = _packs_to_visit(centres, rings, k, second)
        asked = asked.withColumn(PACK, F.explode(visit(F.col(Q_VEC), F.col("_kth"))))
        got = _block_scores(asked, m, k, [PACK], qid, mid, tiebreak, score, block_rows, None, "_kth")
        return got.drop(PACK, "_kth")

    best = F.row_number().over(Window.partitionBy(qid).orderBy(*_order(score, tiebreak, mid)))
    first = scored(q.withColumn("_kth", F.lit(None).cast("double")), False)
    first = first.withColumn(rank, best).where(F.col(rank) <= k).drop(rank).checkpoint()
    kth = first.groupBy(qid).agg(F.when(F.count(score) == k, F.min(score)).alias("_kth"))
    second = scored(q.join(kth, qid, "left"), True)
    return first.unionByName(second).withColumn(rank, best).where(F.col(rank) <= k)
