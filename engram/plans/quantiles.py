"""Exact order statistics per group without collecting a group into one task.

``order_stat(df, group, value, target)`` returns, per group, the value whose
0-based rank in ascending order equals the group's ``target`` column.  It is
a two-level selection:

1. a histogram over a monotone bucketing of the value (partial aggregation,
   bounded by groups x buckets),
2. a running sum over the (small) histogram finds the bucket holding the
   target rank,
3. only rows of that bucket are ranked to pick the exact element.

The only per-row work is a projection and a semi-join; no group's rows are
gathered into one array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BUCKETS_PER_E = 256  # log-scale resolution: buckets per factor e


def _bucket(v: Column) -> Column:
    pos = F.floor(F.log1p(v) * BUCKETS_PER_E)
    neg = -F.floor(F.log1p(-v) * BUCKETS_PER_E) - 1
    return F.when(v >= 0, pos).otherwise(neg).cast("long")


def order_stat(df: DataFrame, group: Sequence[str], value: str, targets: DataFrame,
               target: str = "target", out: str = "order_stat") -> DataFrame:
    """``targets`` has ``group`` columns and a 0-based ``target`` rank."""
    group = list(group)
    rows = df.select(*group, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    rows = rows.withColumn("_b", _bucket(F.col("_v")))
    hist = rows.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    hit = (hist.join(targets.select(*group, F.col(target).alias("_t")), group)
           .where((F.col("_before") <= F.col("_t")) & (F.col("_t") < F.col("_before") + F.col("_c")))
           .select(*group, "_b", (F.col("_t") - F.col("_before")).alias("_local")))
    # inside the bucket equal values are counted first, so a value that most rows
    # have is one row of the window
    cand = rows.join(hit, group + ["_b"], "inner").groupBy(*group, "_v").agg(
        F.count(F.lit(1)).alias("_c"), F.max("_local").alias("_local"))
    upto = F.sum("_c").over(Window.partitionBy(*group).orderBy("_v"))
    return (cand.withColumn("_upto", upto)
            .where((F.col("_upto") > F.col("_local")) & (F.col("_upto") - F.col("_c") <= F.col("_local")))
            .select(*group, F.col("_v").alias(out)))
