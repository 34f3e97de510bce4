"""Filters, projections and id look-ups (all push down to the parquet scan
where the predicate allows it)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.sizing import broadcast_fixed
from ..schemas import TAXONOMY_PAIRS


def live(memories: DataFrame, include_deleted: bool = False) -> DataFrame:
    """Rows not soft-deleted (``deleted_at IS NULL``)."""
    return memories if include_deleted else memories.where(F.col("deleted_at").isNull())


def scope_users(df: DataFrame, users, key: str = "user_id") -> DataFrame:
    """Tenant isolation: keep rows of the given users (a list or a DataFrame
    with a ``key`` column)."""
    if isinstance(users, DataFrame):
        return df.join(users.select(key).distinct(), key, "left_semi")
    return df.where(F.col(key).isin(list(users)))


def taxonomy_filter(df: DataFrame, categories: Sequence[str] | None = None,
                    subtypes: Sequence[str] | None = None) -> DataFrame:
    if categories:
        df = df.where(F.col("memory_category").isin(list(categories)))
    if subtypes:
        df = df.where(F.col("memory_subtype").isin(list(subtypes)))
    return df


def temporal_tag_filter(df: DataFrame, after=None, before=None, tags: Sequence[str] | None = None,
                        min_confidence: float | None = None, time_col: str = "created_at") -> DataFrame:
    """Time range on ``time_col`` (after <= t < before), any-of tag match on
    ``metadata.tags`` and a confidence floor."""
    if after is not None:
        df = df.where(F.col(time_col) >= _ts(after))
    if before is not None:
        df = df.where(F.col(time_col) < _ts(before))
    if tags:
        tag_arr = F.from_json(F.get_json_object("metadata", "$.tags"), "array<string>")
        df = df.where(F.coalesce(F.arrays_overlap(tag_arr, F.array(*[F.lit(t) for t in tags])),
                                 F.lit(False)))
    if min_confidence is not None:
        df = df.where(F.col("confidence") >= F.lit(float(min_confidence)))
    return df


def _ts(v) -> Column:
    if isinstance(v, Column):
        return v
    return F.to_timestamp_ntz(F.lit(str(v)))


def lookup_by_ids(memories: DataFrame, ids: DataFrame, check_owner: bool = True,
                  id_col: str = "memory_id") -> DataFrame:
    """Multi-get of live rows whose id is in ``ids`` (and, with
    ``check_owner``, whose owner equals the requesting ``user_id``)."""
    keys = [id_col, "user_id"] if check_owner else [id_col]
    want = ids.select(*keys).distinct()
    return live(memories).join(want, keys, "left_semi")


def taxonomy_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TAXONOMY_PAIRS, "memory_category string, memory_subtype string")


def validate_taxonomy(df: DataFrame) -> DataFrame:
    """Add ``is_valid``: the (category, subtype) pair is in the taxonomy."""
    dim = taxonomy_dim(df.sparkSession).withColumn("_valid", F.lit(True))
    return (df.join(broadcast_fixed(dim), ["memory_category", "memory_subtype"], "left")
            .withColumn("is_valid", F.coalesce(F.col("_valid"), F.lit(False)))
            .drop("_valid"))


def item_type_filter(items: DataFrame, types: Iterable[str]) -> DataFrame:
    return items.where(F.col("content_type").isin(list(types)))


def authorize_requests(reqs: DataFrame, memories: DataFrame) -> DataFrame:
    """Each (request_id, memory_id, user_id) request -> ok / not_found /
    unauthorized, checked against live rows."""
    owners = live(memories).select("memory_id", F.col("user_id").alias("_owner"))
    j = reqs.join(owners, "memory_id", "left")
    status = (F.when(F.col("_owner").isNull(), "not_found")
              .when(F.col("_owner") != F.col("user_id"), "unauthorized")
              .otherwise("ok"))
    return j.withColumn("status", status).drop("_owner")


def preview(col, n: int) -> Column:
    """First n characters, with "..." only when the text is longer."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)
