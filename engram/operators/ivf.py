"""Inverted-file vector index with product-quantised residuals, kept as a table.

``build_index`` fits coarse centres and code books on bounded samples and writes
every live row with its cell, its code (one byte a part of the residual) and the
length of what the code leaves out; ``append_index`` adds rows by the same model.
``search_index`` reads codes first.  A first probe of the nearest cells gives each
query a k-th score; then all cells of the tenant whose angle bound reaches it are
scored by codes, and only rows whose estimate plus margin reaches it are scored on
their own vectors, in the same task.  Pairs never become rows, and what the codes leave is
never written: a block gives back the best rows of a query, so unstructured vectors or a
large group of near copies cost numpy time and no shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.blocking import BLOCK_ROWS
from ..session import ensure_checkpoint_dir
from .cells import CHUNK, SLACK, _fit, _tour, _units, fit_centres, sample_units
from .filters import live
from .search import DIM, QUERY_CHUNK, _order, has_vector

#: Parts of a residual, each one byte of the code.
PARTS = 16
#: Rows that the code books of one vector length are fitted on.
BOOK_SAMPLE = 16384
#: Deviations of the part left out by the code that a row's estimate is given.
#: Along one query that part has about its length / sqrt(dim); None takes the whole
#: length, which no row can exceed, and makes the search exact at a higher price.
MARGIN = 5.0
#: Rows that the first probe of a query holds at least, as a multiple of k.
PROBE = 8
#: Parts of queries that meet a block together, as its rows are sent once for each meeting.
WIDE = 4


class Model:
    """Coarse centres and residual code books of one vector length."""

    def __init__(self, centres: np.ndarray, books: list[np.ndarray]):
        self.centres, self.books = centres, books
        self.cuts = np.cumsum([0] + [b.shape[1] for b in books])

    def encode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cell, angle to its centre, code bytes, length of what is left out."""
        cos = units @ self.centres.T
        cell = cos.argmax(axis=1)
        angle = np.arccos(np.clip(cos[np.arange(len(cell)), cell], -1, 1))
        rest = units - self.centres[cell]
        code = np.empty((len(units), len(self.books)), dtype=np.uint8)
        for p, book in enumerate(self.books):
            part = rest[:, self.cuts[p]:self.cuts[p + 1]]
            code[:, p] = ((book * book).sum(axis=1)[None, :] - 2 * part @ book.T).argmin(axis=1)
        left = np.sqrt(((units - self.decode(cell, code)) ** 2).sum(axis=1))
        return cell, angle, code, left

    def decode(self, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        return self.centres[cell] + np.concatenate([b[code[:, p]] for p, b in enumerate(self.books)], axis=1)


def _means(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """At most ``k`` centres of ``points`` by k-means."""
    centres = points[rng.choice(len(points), size=min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        at = ((centres * centres).sum(axis=1)[None, :] - 2 * points @ centres.T).argmin(axis=1)
        seen = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, points)
        centres[seen > 0] = sums[seen > 0] / seen[seen > 0, None]
    return centres


def _fit_models(rows: DataFrame, seed: int, cells: int | None) -> dict[int, Model]:
    models = {}
    sizes = {r[DIM]: r["n"] for r in rows.groupBy(DIM).agg(F.count(F.lit(1)).alias("n")).collect()}
    for dim, centres in fit_centres(rows, "embedding", "memory_id", seed, cells).items():
        centres = centres[np.argsort(_tour(centres))]
        units = sample_units(rows, "embedding", "memory_id", dim, sizes[dim], BOOK_SAMPLE)
        if not len(units):
            units = centres
        rest = units - centres[np.concatenate([(units[i:i + CHUNK] @ centres.T).argmax(axis=1)
                                               for i in range(0, len(units), CHUNK)])]
        rng = np.random.default_rng((seed, dim))
        models[dim] = Model(centres, [_means(part, 256, rng) for part in np.array_split(rest, min(PARTS, dim), axis=1)])
    return models


_MODEL = "dim int, kind string, part int, at int, vector array<double>"


def _save(spark: SparkSession, models: dict[int, Model], path: str) -> None:
    out = [(int(d), "centre", 0, i, v.tolist()) for d, m in models.items() for i, v in enumerate(m.centres)]
    out += [(int(d), "book", p, i, v.tolist()) for d, m in models.items() for p, b in enumerate(m.books)
            for i, v in enumerate(b)]
    spark.createDataFrame(out, _MODEL).coalesce(1).write.mode("append").parquet(f"{path}/model")


def _load(spark: SparkSession, path: str) -> dict[int, Model]:
    """The models: at most MOST_CELLS centres and 256 x PARTS code words of a length."""
    table = spark.read.schema(_MODEL).parquet(f"{path}/model").toPandas().sort_values(["kind", "part", "at"])
    models = {}
    for dim, t in table.groupby("dim"):
        parts = t[t["kind"] == "book"].groupby("part")["vector"]
        models[int(dim)] = Model(np.stack(t.loc[t["kind"] == "centre", "vector"]), [np.stack(v) for _, v in parts])
    return models


def _encoded(rows: DataFrame, models: dict[int, Model]) -> DataFrame:
    @F.pandas_udf("cell int, angle double, code binary, rest double")
    def encode(vecs: pd.Series) -> pd.DataFrame:
        cell, angle, rest = np.full(len(vecs), -1), np.zeros(len(vecs)), np.zeros(len(vecs))
        code = np.full(len(vecs), b"", dtype=object)
        sizes = vecs.map(len).to_numpy()
        for dim in np.unique(sizes):
            of_dim = np.flatnonzero(sizes == dim)
            for i in range(0, len(of_dim), CHUNK):
                at = of_dim[i:i + CHUNK]
                units = _units(vecs.iloc[at])
                ok = np.isfinite(units).all(axis=1)
                at = at[ok]
                cell[at], angle[at], bytes_of, rest[at] = models[dim].encode(units[ok])
                code[at] = [b.tobytes() for b in bytes_of]
        return pd.DataFrame({"cell": cell.astype(np.int32), "angle": angle, "code": code, "rest": rest})
    out = rows.withColumn("_e", encode("embedding"))
    return out.select("user_id", DIM, "_e.*", "memory_id", "importance", "embedding").where(F.col("cell") >= 0)


def _usable(df: DataFrame) -> DataFrame:
    return df.where(has_vector("embedding") & F.col("user_id").isNotNull()).withColumn(DIM, F.size("embedding"))


def append_index(memories: DataFrame, path: str, *, cells: int | None = None, seed: int = 7) -> None:
    """Add the live rows of ``memories`` to the index at ``path``, one write.  Centres
    and books stay; a vector length that is new to the index is fitted first."""
    spark = memories.sparkSession
    rows = _usable(live(memories)).select("user_id", DIM, "memory_id", "importance", "embedding")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/model")
    known = _load(spark, path) if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) else {}
    fresh = _fit_models(rows.where(~F.col(DIM).isin(list(known))) if known else rows, seed, cells)
    if fresh or not known:
        _save(spark, fresh, path)
    _encoded(rows, {**known, **fresh}).write.mode("append").parquet(f"{path}/rows")


def build_index(memories: DataFrame, path: str, *, cells: int | None = None, seed: int = 7) -> None:
    """Write the index of the live rows of ``memories`` to the new folder ``path``
    (in a store all executors share).  Rows without a tenant, a vector or a direction
    take no part."""
    append_index(memories, path, cells=cells, seed=seed)


def _segments(codes: DataFrame, asked: DataFrame, block_rows: int) -> tuple[DataFrame, int, int]:
    """Per (tenant, length, cell): rows, angles, the pack it belongs to and the parts
    that the tenant's queries are dealt over, WIDE of which meet a block together.  Cells of
    a tenant in the order of the walk form packs of about ``block_rows`` rows; a pack with
    more is dealt over ``blocks``.  Second and third: how many bins all parts of queries, and
    all packs with the parts that they meet together, go to."""
    t = codes.groupBy("user_id", DIM, "cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("lo"),
                                                  F.max("angle").alias("hi"))
    w = Window.partitionBy("user_id", DIM).orderBy("cell")
    t = t.withColumn("pack", F.floor((F.sum("n").over(w) - F.col("n")) / block_rows).cast("int"))
    size = F.sum("n").over(Window.partitionBy("user_id", DIM, "pack"))
    t = t.withColumn("blocks", F.ceil(size / block_rows).cast("int"))
    queries = asked.groupBy("user_id", DIM).agg(F.count(F.lit(1)).alias("queries"))
    t = t.join(queries, ["user_id", DIM]).withColumn("parts", F.ceil(F.col("queries") / block_rows).cast("int"))
    t = t.withColumn("wide", F.ceil(F.col("parts") / WIDE).cast("int")).checkpoint()
    total = t.agg(F.sum(F.col("n") * F.col("wide")).alias("rows")).first()["rows"]
    total_asked = t.select("user_id", DIM, "queries").distinct().agg(F.sum("queries").alias("n")).first()["n"]
    return t, max(1, -(-(total_asked or 0) // block_rows)), max(1, -(-(total or 0) // block_rows))


def _visits(models: dict[int, Model], least: int, first: bool):
    """Per query the packs to visit and the cells that count there: those nearest that
    hold ``least`` rows (first), or all whose bound reaches the k-th score."""
    keys = ["user_id", DIM, "part"]

    def run(asked: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        names = ["qid", *keys, "_q_vec", "kth", "pack", "blocks", "cells"]
        out = {c: [] for c in names}
        tables = dict(iter(cells.sort_values("cell").groupby(keys)))
        for key, own in asked.groupby(keys):
            t = tables[key]
            cell, held, low, high, pack, parts = (t[c].to_numpy() for c in ("cell", "n", "lo", "hi", "pack", "blocks"))
            centres = models[key[1]].centres[cell]
            for qid, vec, score in own[["qid", "_q_vec", "kth"]].itertuples(index=False):
                unit = _units([vec])[0]
                if not np.isfinite(unit).all():
                    continue
                a = np.arccos(np.clip(centres @ unit, -1, 1))
                take = np.ones(len(cell), dtype=bool)
                if first:
                    order = np.argsort(a, kind="stable")
                    take[order] = np.cumsum(held[order]) - held[order] < least
                elif score == score and score is not None:
                    take = np.cos(np.maximum(0, np.maximum(low - a, a - high))) >= score - SLACK
                # cells come in the order of the walk, so those of a pack are neighbours
                at = np.flatnonzero(take)
                for r in np.split(at, np.flatnonzero(np.diff(pack[at])) + 1) if len(at) else []:
                    for c, v in zip(names, (qid, *key, vec, score, pack[r[0]], parts[r[0]], cell[r]), strict=True):
                        out[c].append(v)
        return pd.DataFrame(out)
    return run


def _key(block: Column) -> Column:
    return F.concat_ws("/", F.col(DIM), F.col("pack"), block, F.col("part"), F.col("user_id"))


def _hits(models: dict[int, Model], k: int, margin: float | None, first: bool):
    """The ``k`` best rows of each query in a block, by their vectors, among those that
    its codes leave: in the first probe the ``k`` best estimates, else all that may reach
    the k-th score.  What the codes leave never goes out of the task."""
    def run(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        names = ["qid", "memory_id", "importance", "score"]
        out = {c: [] for c in names}
        blocks = dict(iter(rows.sort_values("memory_id").groupby("seg")))
        for seg, own in asked.groupby("seg"):
            block = blocks.get(seg)
            if block is None:
                continue
            dim = int(own[DIM].iloc[0])
            cell = block["cell"].to_numpy()
            x = models[dim].decode(cell, np.stack([np.frombuffer(c, dtype=np.uint8) for c in block["code"]]))
            slack = block["rest"].to_numpy() * (1.0 if margin is None else min(1.0, margin / dim ** 0.5))
            v = np.stack(block["embedding"]).astype(np.float64)
            size = np.sqrt((v * v).sum(axis=1))
            ids, importance = block["memory_id"].to_numpy(), block["importance"].to_numpy(dtype=np.float64)
            worth = np.where(np.isnan(importance), np.inf, -importance)
            for i in range(0, len(own), QUERY_CHUNK):
                part = own.iloc[i:i + QUERY_CHUNK]
                guess = _units(part["_q_vec"]) @ x.T
                for (qid, q, kth, cells), g in zip(part[["qid", "_q_vec", "kth", "cells"]].itertuples(index=False), guess,
                                                   strict=True):
                    known = kth == kth and kth is not None
                    counts = np.zeros(len(models[dim].centres), dtype=bool)
                    counts[cells] = True
                    at = np.flatnonzero(counts[cell])
                    if first:
                        at = at[np.argsort(-g[at], kind="stable")[:k]]
                    elif known:
                        at = at[g[at] + slack[at] >= kth - SLACK]
                    q = np.asarray(q, dtype=np.float64)
                    score = (v[at] @ q) / (size[at] * np.sqrt((q * q).sum()))
                    if known:       # the first probe has k rows at the k-th score or above
                        reach = score >= kth - SLACK
                        at, score = at[reach], score[reach]
                    best = np.lexsort((at, worth[at], -score))[:k]
                    out["qid"] += [qid] * len(best)
                    out["memory_id"].append(ids[at[best]])
                    out["importance"].append(importance[at[best]])
                    out["score"].append(score[best])
        if not out["qid"]:
            return pd.DataFrame(columns=names, dtype=object).astype({"importance": float, "score": float})
        return pd.DataFrame({c: out[c] if c == "qid" else np.concatenate(out[c]) for c in names})
    return run


def search_index(queries: DataFrame, path: str, k: int, *, qid: str = "request_id",
                 margin: float | None = MARGIN, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per query (``qid`` unique, user_id, embedding) the ``k`` rows of its tenant in
    the index at ``path`` with the largest cosine, ties by importance (largest first,
    null last) and memory id.  Exact with ``margin=None``; else a row is missed only
    if its code is wrong along the query by over ``margin`` deviations."""
    spark = queries.sparkSession
    ensure_checkpoint_dir(spark)
    models = _load(spark, path)
    rows = spark.read.parquet(f"{path}/rows")
    asked = _usable(queries).select(F.col(qid).alias("qid"), "user_id", DIM, F.col("embedding").alias("_q_vec"))
    cells, asked_bins, bins = _segments(rows, asked, block_rows)

    def binned(df: DataFrame, block: Column) -> DataFrame:
        df = df.withColumn("seg", _key(block))
        return df.withColumn("bin", F.pmod(F.xxhash64("seg"), F.lit(bins)))

    def each(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    in_blocks = rows.drop("angle").join(cells.select("user_id", DIM, "cell", "pack", "blocks", "wide"),
                                        ["user_id", DIM, "cell"]).withColumn("part", each("wide"))
    in_blocks = binned(in_blocks, F.pmod(F.xxhash64("memory_id"), F.col("blocks"))).drop(
        "user_id", DIM, "pack", "blocks", "wide", "part")
    bin_ = F.pmod(F.xxhash64("user_id", DIM, "part"), F.lit(asked_bins)).alias("bin")
    own = cells.withColumn("part", each("parts")).select(bin_, "user_id", DIM, "part", "cell", "n", "lo", "hi", "pack", "blocks")
    dealt = cells.select("user_id", DIM, "parts").distinct()
    id_type = asked.schema["qid"].dataType
    hit_type = T.StructType([T.StructField("qid", id_type), rows.schema["memory_id"], rows.schema["importance"],
                             T.StructField("score", T.DoubleType())])
    visit_type = T.StructType([
        T.StructField("qid", id_type), asked.schema["user_id"], asked.schema[DIM], T.StructField("part", T.IntegerType()),
        asked.schema["_q_vec"], T.StructField("kth", T.DoubleType()), T.StructField("pack", T.IntegerType()),
        T.StructField("blocks", T.IntegerType()), T.StructField("cells", T.ArrayType(T.IntegerType()))])
    best = F.row_number().over(Window.partitionBy("qid").orderBy(*_order("score", ["importance"], "memory_id")))

    def probe(q: DataFrame, first: bool) -> DataFrame:
        q = q.join(dealt, ["user_id", DIM]).withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int"))
        q = q.select(bin_, "qid", "user_id", DIM, "part", "_q_vec", "kth").groupBy("bin").cogroup(
            own.groupBy("bin")).applyInPandas(_visits(models, PROBE * k, first), visit_type)
        q = q.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        q = q.withColumn("part", F.floor(F.col("part") / WIDE).cast("int"))
        q = binned(q, F.col("block")).select("bin", "seg", DIM, "qid", "_q_vec", "kth", "cells")
        hits = q.groupBy("bin").cogroup(in_blocks.groupBy("bin")).applyInPandas(_hits(models, k, margin, first), hit_type)
        # once for every row of its qid, should that come more than once
        hits = hits.join(asked.select("qid"), "qid")
        return hits.withColumn("rank", best).where(F.col("rank") <= k).drop("rank")

    first = probe(asked.withColumn("kth", F.lit(None).cast("double")), True).checkpoint()
    kth = first.groupBy("qid").agg(F.when(F.count("score") == k, F.min("score")).alias("kth"))
    second = probe(asked.join(kth, "qid", "left"), False)
    merged = first.unionByName(second).dropDuplicates(["qid", "memory_id"])
    merged = merged.withColumn("rank", best).where(F.col("rank") <= k)
    return merged.join(asked.select("qid", "user_id"), "qid").select(
        F.col("qid").alias(qid), "user_id", "memory_id", "importance", "score", "rank")
