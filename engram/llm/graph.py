"""Connected components of an edge table, for operators that link documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _state(e: DataFrame) -> tuple:
    """Number and digest of some edges."""
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node
    of its component.

    Large-star and small-star steps in turn: every node hangs its larger, then
    its smaller neighbours on the smallest node around it.  Only minima are
    gathered per node, so a node with very many edges is no burden; each round
    is written to the shared folder.  The number of rounds grows with the
    logarithm of the longest chain."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = written(e, "edges")
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    state = _state(e)
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # no more rows than edges, so what repeats may wait for the end of the round
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        e = written(small, "edges")
        # stars that stay as they are have their centres smallest: done
        before, state = state, _state(e)
        if state == before:
            break
    else:
        raise RuntimeError(f"components not found within {rounds} rounds")
    return nodes.join(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")), "node", "left").select(
        "node", F.coalesce("v", "node").alias("root"))
