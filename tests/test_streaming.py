import os
import subprocess
import sys
import uuid

from pyspark.sql import functions as F

from engram.session import shared_path
from engram.sources import testdata as td
from engram.streaming import jobs as sj

SF = "/root/testdata/sf0.001"


def test_tumbling_metrics_cover_every_call(spark):
    m = td.metrics_from(sj.file_stream(spark, SF, "events"))
    out = sj.run_available(sj.stream_service_metrics(m, "60 minutes", "60 minutes", "0 seconds"), "tumble")
    # availableNow closes the stream, so every window is emitted exactly once
    total = out.agg(F.sum("calls")).first()[0]
    assert total is None or total <= td.metrics(spark, SF).count()
    batch = (td.metrics(spark, SF).withColumn("w", F.window(F.col("recorded_at").cast("timestamp"), "60 minutes"))
             .groupBy("w", "service").count())
    emitted = {(r["window_start"], r["service"]): r["calls"] for r in out.collect()}
    expected = {(r["w"]["start"], r["service"]): r["count"] for r in batch.collect()}
    assert all(expected[k] == v for k, v in emitted.items())


def test_ingest_drops_repeated_ids_and_blocks_secrets(spark, tmp_path):
    key = "ghp_" + "Zx9" * 14
    rows = [(1, "plain text", 0), (2, "token = " + key, 1), (1, "plain text again", 2), (3, "more", 3)]
    src = str(tmp_path / "src")
    spark.createDataFrame(rows, "id long, text string, sec long") \
         .withColumn("ts", F.timestamp_seconds(F.col("sec") + 1_700_000_000)).drop("sec") \
         .coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).parquet(src)
    root = shared_path(spark, f"ingest-test-{uuid.uuid4().hex}")
    q = (sj.stream_ingest(stream, "id", "text", "ts", f"{root}/ok", f"{root}/blocked")
         .option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    ok = sorted(r["id"] for r in spark.read.parquet(f"{root}/ok").collect())
    blocked = [r["id"] for r in spark.read.parquet(f"{root}/blocked").collect()]
    assert ok == [1, 3] and blocked == [2]


def test_access_counts_stream_matches_batch(spark):
    log = td.access_log_from(sj.file_stream(spark, SF, "events"))
    out = sj.run_available(sj.stream_access_counts(log), "acc-test", mode="update")
    got = {r["memory_id"]: r["n"] for r in out.groupBy("memory_id").agg(F.max("access_count").alias("n")).collect()}
    want = {r["memory_id"]: r["count"] for r in td.access_log(spark, SF).groupBy("memory_id").count().collect()}
    assert got == want


def _dealt(spark, tmp_path, name, files=3):
    """The table as a folder of files, rows dealt to them without order."""
    t = spark.read.parquet(f"{SF}/{name}.parquet")
    t.repartition(files, F.xxhash64(*t.columns)).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_ingest_takes_every_file_of_a_table(spark, tmp_path):
    # ids give the times, so each file spans more than the watermark
    from engram.plans.q_stream import q_stream_ingest
    want = sorted(map(tuple, q_stream_ingest(spark, SF).collect()))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(want) == docs.count() > 0
    wide = docs.withColumn("doc_id", F.col("doc_id") * 1000)
    wide.repartition(3, F.xxhash64("doc_id")).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, q_stream_ingest(spark, str(tmp_path)).collect()))
    assert got == [(i * 1000, ok) for i, ok in want]


def test_working_memory_of_a_dealt_table_follows_the_sequence(spark, tmp_path):
    from engram.plans.q_stream import q_stream_working_memory
    want = sorted(map(tuple, q_stream_working_memory(spark, SF).collect()))
    assert any(r[2] == "evicted" for r in want)
    assert sorted(map(tuple, q_stream_working_memory(spark, _dealt(spark, tmp_path, "conversations")).collect())) == want


def test_metrics_and_access_counts_of_a_dealt_table(spark, tmp_path):
    from engram.plans.q_stream import q_stream_access_counts, q_stream_service_metrics
    folder = _dealt(spark, tmp_path, "events")
    for query in (q_stream_access_counts, q_stream_service_metrics):
        cols = [c for c in query(spark, SF).columns if not c.startswith(("avg", "p95"))]
        want = sorted(map(tuple, query(spark, SF).select(cols).collect()))
        assert want and sorted(map(tuple, query(spark, folder).select(cols).collect())) == want


def test_working_memory_where_only_the_driver_program_knows_the_package(spark, tmp_path):
    # the Python process that Spark starts beside the driver's JVM has neither PYTHONPATH nor the caller's sys.path
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from engram.plans.q_stream import q_stream_working_memory
from engram.session import get_spark
spark = get_spark("local[2]", shuffle_partitions=2)
print("ROWS", q_stream_working_memory(spark, {SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    env["ENGRAM_DRIVER_MEMORY"] = "2g"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert f"ROWS {td.items(spark, SF).select('session_id', 'item_id').distinct().count()}" in out.stdout, out.stderr[-2000:]
