"""Plan-shape checks: pushdown, pruning, partial top-k, no cross products."""

import contextlib
import io as _io

from pyspark.sql import functions as F

from engram.operators import filters as flt
from engram.operators import search as S
from engram.sources import io
from engram.sources import testdata as td

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    buf = _io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_live_filter_and_pruning_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "mem")
    io.append_rows(td.memories(spark, SF).drop("embedding"), path)
    stored = spark.read.parquet(path)
    q = flt.live(stored).where(F.col("user_id") == "u3").select("memory_id", "importance")
    p = plan(q)
    pushed = [ln for ln in p.splitlines() if "PushedFilters" in ln][0]
    assert "IsNull(deleted_at)" in pushed and "EqualTo(user_id,u3)" in pushed, pushed
    read_schema = [ln for ln in p.splitlines() if "ReadSchema" in ln][0]
    assert "content" not in read_schema and "importance" in read_schema


def test_per_query_topk_is_a_partial_limit(spark):
    out = S.knn_exact(td.requests(spark, SF), td.memories(spark, SF), 5, method="sql")
    p = plan(out)
    assert "WindowGroupLimit" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_tenant_join_is_an_equi_join(spark):
    out = S.knn_exact(td.requests(spark, SF), td.memories(spark, SF), 5)
    p = plan(out)
    assert "FlatMapCoGroupsInPandas" in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_context_assembly_has_no_cross_products(spark):
    from engram.operators import context as cx
    out = cx.assemble_context(td.requests(spark, SF), td.items(spark, SF), td.memories(spark, SF),
                              min_similarity=0.2)
    p = plan(out)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    # the vector search is one cogrouped kernel in the tree (the formatted
    # plan lists each node again in its details section)
    tree = p.split("\n\n(1)")[0]
    assert tree.count("FlatMapCoGroupsInPandas") == 1
