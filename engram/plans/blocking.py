"""Skew-safe pairing of query rows with candidate rows inside a key group.

Exact nearest-neighbour work is an equi-join on the tenant key followed by a
per-pair score.  A plain join puts a whole tenant into one task, so one user
with a third of all rows would run alone.  Here every key group is cut into
blocks of at most ``block_rows`` rows on each side; block (qb, mb) pairs are
joined on ``keys + (_qblk, _mblk)``.  Small groups get exactly one block (no
replication); a hot group is spread over qb x mb tasks of bounded size.

The join output is hash-partitioned on ``keys + blocks``; a per-query window
placed on top gets a partial (map-side) ``WindowGroupLimit`` before its
shuffle, so only k rows per query and block move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
QBLK, MBLK = "_qblk", "_mblk"


def block_sizes(q: DataFrame, m: DataFrame, keys: Sequence[str], block_rows: int) -> DataFrame:
    qn = q.groupBy(*keys).agg(F.count(F.lit(1)).alias("_qn"))
    mn = m.groupBy(*keys).agg(F.count(F.lit(1)).alias("_mn"))
    # one narrow row per key: Spark joins it by broadcast or shuffle, as its measured size allows
    sizes = qn.join(mn, list(keys)).select(
        *keys,
        F.ceil(F.col("_qn") / block_rows).cast("int").alias("_qb"),
        F.ceil(F.col("_mn") / block_rows).cast("int").alias("_mb"),
    )
    return sizes


def blocked(q: DataFrame, m: DataFrame, keys: Sequence[str], qid: str, mid: str,
            block_rows: int | None = BLOCK_ROWS) -> tuple[DataFrame, DataFrame, list[str]]:
    """Return (q_blocked, m_blocked, join_keys)."""
    keys = list(keys)
    if not block_rows:
        return q, m, keys
    sizes = block_sizes(q, m, keys, block_rows)
    q2 = (q.join(sizes, keys)
          .withColumn(QBLK, F.pmod(F.xxhash64(qid), F.col("_qb")).cast("int"))
          .withColumn(MBLK, F.explode(F.sequence(F.lit(0), F.col("_mb") - 1)))
          .drop("_qb", "_mb"))
    m2 = (m.join(sizes, keys)
          .withColumn(MBLK, F.pmod(F.xxhash64(mid), F.col("_mb")).cast("int"))
          .withColumn(QBLK, F.explode(F.sequence(F.lit(0), F.col("_qb") - 1)))
          .drop("_qb", "_mb"))
    return q2, m2, keys + [QBLK, MBLK]


def blocked_join(q: DataFrame, m: DataFrame, keys: Sequence[str], qid: str, mid: str,
                 block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    q2, m2, on = blocked(q, m, keys, qid, mid, block_rows)
    out = q2.join(m2, on)
    return out.drop(QBLK, MBLK) if block_rows else out
