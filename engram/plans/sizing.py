"""The one broadcast that is asked for by hand: tables of constants.

All other joins are left to Spark, which broadcasts a side when the size that
it measures is below ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_fixed(df: DataFrame) -> DataFrame:
    """Broadcast a side whose row count is a compile-time constant
    (taxonomy, intent profiles, pattern lists)."""
    return F.broadcast(df)
