"""Approximate nearest neighbours by shifted space-filling curves (operator 6).

Every curve projects the vectors to a few dimensions (its own random rotation
and shift), cuts the coordinates into cells and orders the cells along a
Hilbert curve.  The order is made by Spark's range partitioning.  A query meets
the vectors in a window around its own place on each curve; what the windows
find is merged and ranked again by the exact cosine.

Equal vectors are one class with one place on the curves.  A class remembers
its k + 1 smallest ids, which is all that k nearest neighbours can need of it,
so a vector that a third of the rows share is one row of the index.

The window is a share of the curve, and never fewer than LEAST_CLASSES classes
on each side, so small tables are searched whole.  For vectors without structure (the
neighbours hardly closer than the rest) a fixed number of rows around a query
cannot hold the nearest ones at any size, so recall stays only if the window
grows with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CURVES, DIMENSIONS, BITS = 4, 2, 12
#: Share of a curve that is searched on each side of a query.
WINDOW = 0.18
#: Rows of the index in a block; blocks on a curve at least.
BLOCK_ROWS, LEAST_BLOCKS = 2048, 32
#: Classes that are searched on each side of a query at least, however small the window; a curve of no more is
#: searched whole.
LEAST_CLASSES = 64
#: Queries that meet a block in one task.
QUERY_ROWS = 4096
#: Classes that a block hands on for each query, besides the k wanted: what the rounding of a matrix product may swap.
SLACK = 6
SEED = 5


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of cells (n, dimensions) of ``bits`` bits each
    (transposed form of the index, then its bits interleaved)."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(hit, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(unit: np.ndarray, curve: int, seed: int = SEED) -> np.ndarray:
    """Places of unit vectors on one curve.  Coordinates are scaled so that
    random directions have variance 1, and cover -4 to 4 with a shift of up to
    half a unit."""
    dim = unit.shape[1]
    m = min(DIMENSIONS, dim)
    rng = np.random.default_rng((seed, curve, dim))
    axes = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:m] if dim > 1 else np.ones((1, 1))
    shift = rng.uniform(-0.5, 0.5, m)
    z = unit @ axes.T * np.sqrt(dim) + shift
    cells = np.clip((z + 4.5) / 9 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert_index(cells, BITS)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or empty, no null or non-finite
    component, and not zero."""
    return F.coalesce(
        vector.isNotNull() & (F.size(vector) > 0)
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(vector, lambda x: x != 0), F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of equal length in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
                                   F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _place(classes: DataFrame, curves: int) -> DataFrame:
    """(dim, curve, class_id, rank): each class's place on each curve, from 0."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf["vec"].map(len).to_numpy()
            for dim in np.unique(size):
                part = pdf[size == dim]
                v = np.stack(part["vec"].to_numpy()).astype(np.float64)
                v /= np.abs(v).max(axis=1, keepdims=True)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                for c in range(curves):
                    yield pd.DataFrame({"dim": int(dim), "curve": c, "key": curve_keys(v, c),
                                        "class_id": part["class_id"].to_numpy()})

    keys = classes.select("class_id", "vec").mapInPandas(run, "dim int, curve int, key long, class_id long")
    order = ["dim", "curve", "key", "class_id"]
    t = written(keys.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "curves")
    # places: within a range by window, ranges and curves by sums over one small row for each
    counts = t.groupBy("range", "dim", "curve").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("dim", "curve").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = counts.withColumn("n_curve", F.sum("n").over(Window.partitionBy("dim", "curve"))).drop("n")
    own = F.row_number().over(Window.partitionBy("range", "dim", "curve").orderBy("key", "class_id")) - 1
    return t.withColumn("own", own).join(counts, ["range", "dim", "curve"]).select(
        "dim", "curve", "class_id", (F.col("base") + F.col("own")).alias("rank"), "n_curve")


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding",
            curves: int = CURVES, window: float = WINDOW) -> DataFrame:
    """The k nearest vectors by cosine of every row whose id is divisible by
    ``every``, among all rows but its own: query_id, rank (from 1), vec_id,
    score.  Fewer than k if there are fewer candidates; ties to the smaller id.

    Vectors that are null, empty or zero, or hold null or non-finite components,
    and rows without an id take no part.  Only vectors of equal length are
    compared.  Repeated rows (same id and vector) count once, and rows with the
    query's id are never its neighbours.  An empty table gives an empty result.
    The neighbours found are approximate, their scores exact.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vec")).where(
        F.col("vec_id").isNotNull() & usable(F.col("vec"))).dropDuplicates(["vec_id", "vec"])
    ids = rows.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(
        F.col("r") <= k + 1)
    # a class is named by its smallest id; an id that comes with several vectors names several, so number them
    classes = ids.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = written(classes.withColumn("class_id", F.xxhash64(F.element_at("ids", 1), "vec")), "classes")
    queries = written(rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vec").join(
        classes.select("vec", "class_id"), "vec").select("query_id", "class_id"), "queries")

    place = _place(classes, curves)
    n_blocks = F.greatest(F.lit(LEAST_BLOCKS).cast("long"), F.ceil(F.col("n_curve") / BLOCK_ROWS))
    place = place.withColumn("n_blocks", n_blocks).withColumn(
        "block", F.floor(F.col("rank") * F.col("n_blocks") / F.col("n_curve")))
    data = written(place.join(classes.select("class_id", "vec"), "class_id"), "index")
    asked = data.select(*[F.col(c).alias(c) for c in data.columns]).join(
        queries.select("class_id").distinct(), "class_id", "left_semi")
    n_queries = asked.groupBy("dim", "curve").agg(F.count(F.lit(1)).alias("n_asked"))
    # blocks that hold the window, and those that hold the least number of classes whose places spread over the blocks
    least = F.ceil(F.lit(max(LEAST_CLASSES, k + SLACK)) * F.col("n_blocks") / F.col("n_curve"))
    reach = F.least(F.col("n_blocks"), F.greatest(F.ceil(F.col("n_blocks") * F.lit(window)), least)).cast("long")
    # so many groups of queries that those meeting a block stay few
    n_groups = F.greatest(F.lit(1).cast("long"), F.ceil(
        F.col("n_asked") * (2 * reach + 1) / F.col("n_blocks") / QUERY_ROWS))
    asked = asked.join(F.broadcast(n_queries), ["dim", "curve"]).withColumn(
        "group", F.pmod(F.xxhash64("class_id"), n_groups)).withColumn("block", F.explode(F.sequence(
            F.greatest(F.lit(0).cast("long"), F.col("block") - reach),
            F.least(F.col("n_blocks") - 1, F.col("block") + reach))))
    data = data.join(F.broadcast(n_queries), ["dim", "curve"]).withColumn(
        "group", F.explode(F.sequence(F.lit(0).cast("long"), n_groups - 1)))
    by, most = ["dim", "curve", "block", "group"], k + SLACK

    def meet(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": [], "found": [], "near": []}).astype(
            {"query": "int64", "found": "int64", "near": "float64"})
        if not len(q) or not len(d):
            return empty
        unit = lambda t: (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(
            (lambda v: v / np.abs(v).max(axis=1, keepdims=True))(np.stack(t["vec"].to_numpy()).astype(np.float64)))
        a, b = unit(q), unit(d)
        n = min(most, len(b))
        out = []
        for i in range(0, len(a), 512):
            s = a[i:i + 512] @ b.T
            top = np.argpartition(-s, n - 1, axis=1)[:, :n]
            out.append(pd.DataFrame({"query": np.repeat(q["class_id"].to_numpy()[i:i + 512], n),
                                     "found": d["class_id"].to_numpy()[top].ravel(),
                                     "near": np.take_along_axis(s, top, axis=1).ravel()}))
        return pd.concat(out)

    pairs = asked.select(*by, "class_id", "vec").groupBy(*by).cogroup(
        data.select(*by, "class_id", "vec").groupBy(*by)).applyInPandas(
        meet, "query long, found long, near double")
    pairs = pairs.groupBy("query", "found").agg(F.max("near").alias("near"))
    best = Window.partitionBy("query").orderBy(F.desc("near"), "found")
    pairs = pairs.withColumn("r", F.row_number().over(best)).where(F.col("r") <= most)
    of = lambda name, *more: classes.select(F.col("class_id").alias(name), *more)
    pairs = pairs.join(of("query", F.col("vec").alias("a")), "query").join(
        of("found", F.col("vec").alias("b"), "ids"), "found")
    scored = pairs.select(F.col("query").alias("class_id"), cosine(F.col("a"), F.col("b")).alias("score"), "ids")
    out = queries.join(scored, "class_id").withColumn("vec_id", F.explode("ids")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
