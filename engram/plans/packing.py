"""Greedy skip-and-continue packing under a token budget, exact and without
gathering a whole group.

A row is taken when it still fits, else skipped.  What is used only grows, so once
a row of some cost is skipped every later row of that cost is skipped too: of the
rows of one cost a group takes the first ones in order, ``budget / cost`` of them at
most.  That cut is a ranking by (group, cost).  It is taken in two steps, first
within slices of a group, so that a group with most of the rows is cut by many tasks.
At most ``budget * (1 + ln budget)`` rows of a group are left, however many it has.

The same reason goes further: a row that is taken has all earlier rows of its own or a
lower cost taken before it, so these and itself fit the budget together.  Running sums by
classes of cost drop what cannot meet that.  Both cuts hold whatever other rows are
mixed into the walk, as those only use more of the budget.

Only order and cost of what is left are folded, as a native expression.  Rows that cost
nothing need no fold: they are all taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices of a group in the first step of the cut.
SLICES = 32
#: Classes of cost for the running sums: this many to each halving of the budget.
STEPS, CLASSES = 4, 40
_COST, _LIMIT, _ORDER = "_cost", "_limit", "_order"


def token_cost(tok: str | Column) -> Column:
    """Tokens as a whole number; NULL and negative estimates cost nothing."""
    c = F.col(tok) if isinstance(tok, str) else tok
    return F.greatest(F.coalesce(c.cast("long"), F.lit(0)), F.lit(0)).cast("long")


def first_by_cost(rows: DataFrame, group: Sequence[str], order: Column, cost: Column, limit: Column,
                  slices: int = SLICES) -> DataFrame:
    """The rows that a packing of ``group`` in ``order`` (a struct, ascending) under
    ``limit`` or less can take: per cost the first ``limit / cost``, and of these the ones that fit
    together with the cheaper rows before them.  Rows that cost nothing all stay where
    the limit is not negative.  Columns are as they were."""
    names = rows.columns
    on = [F.col(g) for g in group]
    x = (rows.withColumns({_COST: cost, _LIMIT: F.coalesce(limit.cast("long"), F.lit(0)), _ORDER: order})
         .where(F.col(_COST) <= F.col(_LIMIT)))
    most = F.expr(f"{_LIMIT} div greatest({_COST}, 1)")
    ranked = x.where(F.col(_COST) > 0)
    slice_ = F.pmod(F.xxhash64(_ORDER), F.lit(slices))
    for by in ([*on, F.col(_COST), slice_], [*on, F.col(_COST)]):
        w = Window.partitionBy(*by).orderBy(_ORDER)
        ranked = ranked.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most)
    # class 0 holds the dearest rows; what lies in a higher class is cheaper
    ranked = ranked.withColumn("_class", F.least(F.lit(CLASSES - 1), F.floor(
        F.log2(F.col(_LIMIT) / F.col(_COST)) * STEPS)).cast("int"))
    w = Window.partitionBy(*on).orderBy(_ORDER, _COST).rowsBetween(Window.unboundedPreceding, -1)
    cheaper = F.array(*[F.coalesce(F.sum(F.when(F.col("_class") > i, F.col(_COST))).over(w), F.lit(0))
                        for i in range(CLASSES)])
    ranked = (ranked.withColumn("_before", cheaper)
              .where(F.get("_before", F.col("_class")) + F.col("_rank") * F.col(_COST) <= F.col(_LIMIT)))
    return ranked.select(x.columns).unionByName(x.where(F.col(_COST) == 0)).select(*names)


def fold(rows_in_order: Column, limit: Column) -> Column:
    """Array of structs with a field ``cost``, in order -> those that are taken."""
    init = F.struct(F.lit(0).cast("long").alias("used"), F.filter(rows_in_order, lambda x: F.lit(False)).alias("picked"))
    return F.aggregate(
        rows_in_order, init,
        lambda acc, x: F.when(acc["used"] + x["cost"] <= limit,
                              F.struct((acc["used"] + x["cost"]).alias("used"),
                                       F.concat(acc["picked"], F.array(x)).alias("picked")))
        .otherwise(acc), lambda acc: acc["picked"])


def greedy_pack(rows: DataFrame, budgets: DataFrame, key: str, order: Sequence[Column], tok: str, budget: str,
                keep: Sequence[str]) -> DataFrame:
    """Per distinct (key, budget) of ``budgets``: walk the rows of the key in
    ``order`` (ascending, NULLs first), take a row when ``used + tok <= budget``, else skip
    it and continue.  Returns key, budget, ``keep``, ``position`` (0-based among the
    taken) and ``used`` (tokens of all taken).

    NULL tokens or a NULL budget count as 0, a NULL key meets nothing, repeated
    rows are rows of their own, and a pair of (key, budget) that takes nothing gives no row.

    The rows of a key are cut once, under its largest budget; only order and cost
    of what is left are folded per budget.  The taken rows then come back by one join on key
    and cost: of each cost those up to the last one taken."""
    names = list(dict.fromkeys(k for k in keep if k != key))
    order_ = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    rows = rows.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"), token_cost(tok).alias("_c"), order_.alias("_o"),
        F.struct(*[F.col(n) for n in names]).alias("_row"))
    pairs = (budgets.where(F.col(key).isNotNull())
             .select(F.col(key).alias("_key"), F.coalesce(F.col(budget).cast("long"), F.lit(0)).alias("_b")).distinct())
    most = pairs.groupBy("_key").agg(F.max("_b").alias("_most"))

    left = first_by_cost(rows.where(F.col("_c") > 0).select("_key", "_c", "_o").join(most, "_key"),
                         ["_key"], F.col("_o"), F.col("_c"), F.col("_most")).drop("_most")
    folded = (left.join(pairs, "_key").where(F.col("_c") <= F.col("_b")).groupBy("_key", "_b")
              .agg(F.sort_array(F.collect_list(F.struct(F.col("_o").alias("o"), F.col("_c").alias("cost")))).alias("_xs"))
              .select("_key", "_b", F.explode(fold(F.col("_xs"), F.col("_b"))).alias("x")))
    last = (folded.groupBy("_key", "_b", F.col("x.cost").alias("_c"), F.col("x.o").alias("o"))
            .agg(F.count(F.lit(1)).alias("n"))
            .groupBy("_key", "_b", "_c").agg(F.max(F.struct("o", "n")).alias("_last")))
    paid = rows.join(last, ["_key", "_c"]).where(F.col("_o") <= F.col("_last.o"))
    free = (rows.where(F.col("_c") == 0).join(pairs.where(F.col("_b") >= 0), "_key")
            .withColumn("_last", F.lit(None).cast(last.schema["_last"].dataType)))
    # repeats of the last row of a cost may be more than were taken: the first n of them stay
    w = Window.partitionBy("_key", "_b").orderBy("_o", "_c")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("_key", "_b")
    taken = (paid.unionByName(free)
             .withColumns({"_n": F.row_number().over(w) - F.rank().over(w)})
             .where(F.col("_last").isNull() | (F.col("_o") < F.col("_last.o")) | (F.col("_n") < F.col("_last.n")))
             .withColumns({"position": (F.count(F.lit(1)).over(so_far) - 1).cast("int"),
                           "used": F.sum("_c").over(whole)}))
    return taken.select(F.col("_key").alias(key), F.col("_b").alias(budget), *[F.col("_row")[n].alias(n) for n in names],
                        "position", "used")
