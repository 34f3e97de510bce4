"""Sources and sinks: normalisation on load, table mutation by anti-join +
union, snapshot writes, mirrored writes, parity checks, backups, exports and
storage estimates."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MEMORY_DEFAULTS

N_USER_BUCKETS = 64


def normalize_entities(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Entities given as an array, a CSV string or a "{a,b}" string ->
    trimmed array without blanks; NULL -> [].  Dispatches on the column type."""
    from pyspark.sql import types as T
    is_text = isinstance(df.schema[col].dataType, T.StringType)
    expr = normalize_entities_text(col) if is_text else normalize_entities_array(col)
    return df.withColumn(out or col, expr)


def normalize_entities_text(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    body = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s*\{|\}\s*$", "")
    parts = F.transform(F.split(body, ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != F.lit(""))


def normalize_entities_array(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    parts = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x.isNotNull() & (x != F.lit("")))


def normalize_memories(df: DataFrame, as_of: Column) -> DataFrame:
    """Fill insert defaults: importance 0.5, access_count 0, confidence 1,
    decay_factor 1, source_type 'conversation', timestamps = as_of;
    is_temporal = event_time IS NOT NULL; entities normalised."""
    d = MEMORY_DEFAULTS
    fills = {
        "importance": F.coalesce("importance", F.lit(d["importance"])),
        "access_count": F.coalesce("access_count", F.lit(d["access_count"])).cast("int"),
        "confidence": F.coalesce("confidence", F.lit(d["confidence"])),
        "decay_factor": F.coalesce("decay_factor", F.lit(d["decay_factor"])),
        "source_type": F.coalesce("source_type", F.lit(d["source_type"])),
        "created_at": F.coalesce("created_at", as_of),
        "last_accessed": F.coalesce("last_accessed", as_of),
        "updated_at": F.coalesce("updated_at", as_of),
        "is_temporal": F.col("event_time").isNotNull(),
        "entities": normalize_entities_array("entities"),
    }
    return df.select(*[fills[c].alias(c) if c in fills else F.col(c) for c in df.columns])


def user_bucket(col: str = "user_id", n: int = N_USER_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")


def append_rows(df: DataFrame, path: str, bucket_col: str | None = "user_id") -> None:
    """Append a batch; rows are laid out by user bucket and sorted by
    (user, id) inside files so tenant filters skip row groups."""
    if bucket_col:
        # range partitioning on (bucket, user): a big bucket or a hot user is
        # split over several write tasks (sampled boundaries) instead of one
        # task per bucket, and each task still writes few bucket folders
        out = (df.withColumn("user_bucket", user_bucket(bucket_col))
               .repartitionByRange("user_bucket", bucket_col)
               .sortWithinPartitions("user_bucket", bucket_col))
        out.write.mode("append").partitionBy("user_bucket").parquet(path)
    else:
        df.write.mode("append").parquet(path)


def write_snapshot(df: DataFrame, root: str) -> str:
    """Write a new immutable snapshot folder, then add a pointer to it under
    ``root/current``.  A reader of the previous snapshot is never overwritten."""
    spark = df.sparkSession
    snap = f"{root.rstrip('/')}/snap-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(snap)
    # pointers are only ever added, numbered by time: there is no moment without one
    pointer = f"{root.rstrip('/')}/current/at={time.time_ns():020d}"
    spark.createDataFrame([(snap,)], "path string").coalesce(1).write.mode("errorifexists").parquet(pointer)
    return snap


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The snapshot that the newest pointer names."""
    pointers = spark.read.schema("path string, at string").parquet(f"{root.rstrip('/')}/current")
    return spark.read.parquet(pointers.agg(F.max_by("path", "at")).first()[0])


def insert_or_replace(target: DataFrame, delta: DataFrame, key: Sequence[str] | str,
                      order: str | None = None) -> DataFrame:
    """Primary-key overwrite: rows of ``delta`` replace rows with the same key.
    A key that ``delta`` repeats gets one row: the last by ``order`` if given,
    else the greatest row (column by column)."""
    key = [key] if isinstance(key, str) else list(key)
    rest = [c for c in target.columns if c not in key]
    one = F.struct(*rest)
    last = F.max_by(one, F.col(order)) if order else F.max(one)
    d = delta.groupBy(*key).agg(last.alias("_last")).select(*key, *[F.col("_last")[c].alias(c) for c in rest])
    return target.join(d.select(*key), key, "left_anti").unionByName(d.select(*target.columns))


def mirror_write(df: DataFrame, primary: str, secondary: str, fmt: str = "parquet") -> None:
    """Write-through to two sinks from one materialisation of ``df``: the
    batch is written to ``primary`` once and the secondary copy is written
    from those files, so the source plan runs a single time."""
    df.write.mode("overwrite").format(fmt).save(primary)
    df.sparkSession.read.format(fmt).load(primary).write.mode("overwrite").format(fmt).save(secondary)


def mirror_write_stream(stream: DataFrame, primary: str, secondary: str, checkpoint: str):
    """Streaming form: each micro-batch is appended to both sinks."""
    def both(batch: DataFrame, epoch: int) -> None:
        # a folder for each epoch: a batch that is tried again replaces what it wrote before,
        # and the copy is made from the files, so the batch itself runs once
        part = f"{primary.rstrip('/')}/epoch={epoch}"
        batch.write.mode("overwrite").parquet(part)
        batch.sparkSession.read.schema(batch.schema).parquet(part).write.mode("overwrite").parquet(
            f"{secondary.rstrip('/')}/epoch={epoch}")
    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint)


def row_hash(columns: Sequence[Column], seed: int = 0) -> Column:
    """64-bit hash of values in which a null is a value like any other."""
    marked = [x for c in columns for x in (c.isNull(), c)]
    return F.xxhash64(F.lit(seed), *marked)


def _comparable(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Columns to hash: nested ones as JSON, so that nulls inside count too; one
    that the table lacks as a mark, so that it differs from any value."""
    from pyspark.sql import types as T
    out = []
    for c in columns:
        if c not in df.columns:
            out.append(F.lit("no such column"))
        elif isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType)):
            out.append(F.when(F.col(c).isNotNull(), F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"})))
        else:
            out.append(F.col(c))
    return out


#: Ranges of hashed keys whose digests are compared before any row is moved.
PARITY_RANGES = 1 << 12


def parity_check(primary: DataFrame, secondary: DataFrame, key: Sequence[str] | str,
                 ranges: int = PARITY_RANGES) -> DataFrame:
    """Keys missing on either side or whose rows differ in any column:
    (key..., status in {missing_in_secondary, missing_in_primary, different}),
    one row per key.

    Null keys match null keys, and the rows of a repeated key are compared as a
    multiset.  A column that only one side has makes all its rows differ.

    Both sides are first summed up to order-free digests (row count and sums of
    two hashes) of ``ranges`` ranges of hashed keys; only rows of ranges whose
    digests differ are shuffled and compared."""
    key = [key] if isinstance(key, str) else list(key)
    rest = sorted({*primary.columns, *secondary.columns} - set(key))
    digest = [F.count(F.lit(1)).alias("n"), *[F.sum(F.col(h).cast("decimal(38,0)")).alias(h) for h in ("h1", "h2")]]

    def side(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        values = [F.col(c) for c in key] + _comparable(df, rest)
        rows = df.select(*key, F.pmod(row_hash([F.col(c) for c in key], 7), F.lit(ranges)).alias("range"),
                         row_hash(values, 1).alias("h1"), row_hash(values, 2).alias("h2"))
        return rows, rows.groupBy("range").agg(*digest)

    def named(df: DataFrame, mark: str, by: list[str]) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{mark}{i}") for i, c in enumerate(by)],
                         *[F.col(c).alias(f"{mark}{c}") for c in ("n", "h1", "h2")])

    def unlike() -> Column:
        same = F.lit(True)
        for c in ("n", "h1", "h2"):
            same = same & F.col(f"p_{c}").eqNullSafe(F.col(f"s_{c}"))
        return ~same

    (p, p_sum), (s, s_sum) = side(primary), side(secondary)
    differ = named(p_sum, "p_", ["range"]).join(named(s_sum, "s_", ["range"]), F.col("p_0") == F.col("s_0"), "full_outer")
    differ = differ.where(unlike()).select(F.coalesce("p_0", "s_0").alias("range"))
    # at most ``ranges`` numbers
    p, s = (named(x.join(F.broadcast(differ), "range", "left_semi").groupBy(*key).agg(*digest), mark, key)
            for x, mark in ((p, "p_"), (s, "s_")))
    on = F.lit(True)
    for i in range(len(key)):
        on = on & F.col(f"p_{i}").eqNullSafe(F.col(f"s_{i}"))
    status = F.when(F.col("s_n").isNull(), "missing_in_secondary").when(F.col("p_n").isNull(), "missing_in_primary") \
              .otherwise("different")
    return p.join(s, on, "full_outer").where(unlike()).select(
        *[F.when(F.col("p_n").isNotNull(), F.col(f"p_{i}")).otherwise(F.col(f"s_{i}")).alias(c) for i, c in enumerate(key)],
        status.alias("status"))


def incremental_backup(memories: DataFrame, backup: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Backup after the run: ids missing from the backup are added, rows whose
    ``updated_at`` is newer than the backed-up copy replace it.  Returns
    (backup after, report with added / refreshed counts)."""
    b = backup.select("memory_id", F.col("updated_at").alias("_bu"), F.lit(True).alias("_there"))
    j = memories.join(b, "memory_id", "left")
    new = j.where(F.col("_there").isNull()).drop("_bu", "_there")
    # a copy without a time stamp is older than any that has one
    newer = j.where(F.col("_there") & F.col("updated_at").isNotNull()
                    & (F.col("_bu").isNull() | (F.col("updated_at") > F.col("_bu")))).drop("_bu", "_there")
    delta = new.unionByName(newer)
    out = backup.join(newer.select("memory_id"), "memory_id", "left_anti").unionByName(delta.select(*backup.columns))
    rep = memories.sparkSession.createDataFrame([("added",), ("refreshed",)], "kind string")
    counts = (new.select(F.lit("added").alias("kind")).unionByName(newer.select(F.lit("refreshed").alias("kind")))
              .groupBy("kind").agg(F.count(F.lit(1)).alias("n")))
    rep = rep.join(counts, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))
    return out, rep


def seed_if_absent(memories: DataFrame, seeds: DataFrame, order: str | None = None,
                   text: str = "summary") -> DataFrame:
    """Seed rows to insert: those without a live row of the same user and the
    same whole ``text``; of seeds with the same pair, the first by ``order``
    (else the smallest row).  A seed without text is like no other."""
    have = memories.where(F.col("deleted_at").isNull()).select("user_id", text)
    rest = [c for c in seeds.columns if c not in ("user_id", text)]
    new = seeds.join(have, ["user_id", text], "left_anti").select(*seeds.columns)
    if not rest:
        return new.where(F.col(text).isNotNull()).distinct().unionByName(new.where(F.col(text).isNull()))
    one = F.struct(*rest)
    first = F.min_by(one, F.col(order)) if order else F.min(one)
    once = new.where(F.col(text).isNotNull()).groupBy("user_id", text).agg(first.alias("_first")).select(
        *[F.col(c) if c in ("user_id", text) else F.col("_first")[c].alias(c) for c in seeds.columns])
    return once.unionByName(new.where(F.col(text).isNull()))


#: Rows that one task writes of a user.
EXPORT_ROWS = 1 << 14


def export_user_memories(memories: DataFrame, users: DataFrame, path: str, part_rows: int = EXPORT_ROWS) -> DataFrame:
    """All rows (deleted ones too) of the given users, written as JSON lines
    partitioned by user; returns the exported rows.  A user's rows are dealt by
    their ids over files of about ``part_rows``."""
    rows = memories.join(users.select("user_id").distinct(), "user_id", "left_semi")
    parts = rows.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / part_rows).alias("_parts"))
    dealt = memories.join(parts, "user_id").withColumn("_part", F.pmod(F.xxhash64("memory_id"), F.col("_parts")))
    dealt.repartition("user_id", "_part").drop("_part", "_parts").write.mode("overwrite").partitionBy("user_id").json(path)
    return rows


def human_size(b: Column) -> Column:
    kib, mib, gib = 1024.0, 1024.0 ** 2, 1024.0 ** 3
    return (F.when(b < kib, F.concat(b.cast("long").cast("string"), F.lit(" B")))
            .when(b < mib, F.concat(F.format_number(b / kib, 1), F.lit(" KiB")))
            .when(b < gib, F.concat(F.format_number(b / mib, 1), F.lit(" MiB")))
            .otherwise(F.concat(F.format_number(b / gib, 1), F.lit(" GiB"))))


def storage_estimate(tables: dict) -> DataFrame:
    """Per table: rows and estimated bytes (sum of each row's JSON length)."""
    parts = []
    for name, df in tables.items():
        parts.append(df.agg(F.count(F.lit(1)).alias("rows"),
                            F.coalesce(F.sum(F.length(F.to_json(F.struct(*df.columns)))), F.lit(0))
                            .cast("long").alias("bytes"))
                     .select(F.lit(name).alias("table_name"), "rows", "bytes"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("size", human_size(F.col("bytes")))
