"""Mixing sources to target weights (operator 1), DataFrame functions only.

Every source gets a target number of words.  The words of a source are laid
out in shards, each a stream of documents in a seeded order that is cut into
blocks of equal word count.  Sainte-Lague apportionment turns the targets into
whole blocks: first over sources, then over the shards of each source.  Within
a shard the seeded block order decides which blocks are taken.

Nothing but (doc_id, source, size) is shuffled; the texts stay where they are.
A hot source only has more shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, packed_rows, settled, unpacked_rows, word_count, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
BLOCK_WORDS = 64
SHARD_WORDS = 1 << 18
SEED = 17


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE,
                   max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code point order, null last, have the given weights in turn.
    Targets share ``share`` times all words by weight; none is above
    ``max_repeats`` times its source's words, and what a full source leaves is
    shared again among the others.  One row per source goes through the two
    windows.

    In the order of (cap / weight) the sources at their cap come first.  If
    the first k are full, the others get ``level_k`` words per unit of weight,
    and the true level is the largest level_k that fits its own row.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    src = src.withColumn("place", place).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                               (F.col("place") - 1) % len(weights) + 1))
    src = src.withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    src = src.withColumn("fill", F.col("cap") / F.col("weight"))
    before = Window.orderBy("fill", "place").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("fill", "place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    src = src.withColumn(
        "level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    src = src.withColumn("level", F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(everything))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(
        F.least("cap", F.col("level") * F.col("weight")))
    return src.select("source", "source_size", target.alias("target"))


def sainte_lague(parties: DataFrame, by: list[str], ids: list[str], weight: str, seats: str,
                 out: str = "quota") -> DataFrame:
    """Adds the seats that each party gets by highest quotients weight/(2k-1).

    ``seats`` (the same in all rows of a ``by`` group) are handed to the highest
    quotients of the group, ties by ``ids``.  Whatever the divisor of the group
    turns out to be, party j of n gets between share*(seats - n/2) and
    share*(seats + n/2) seats, give or take rounding, so only the quotients in
    that range compete: about 4n rows a group, however many seats there are.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    n, total = F.count(F.lit(1)).over(group), F.sum(weight).over(group)
    p = parties.withColumn("_half", n / F.lit(2.0)).withColumn("_total", total)
    part = F.when(F.col("_total") > 0, F.col(weight) / F.col("_total")).otherwise(F.lit(0.0))
    p = p.withColumn("_low", F.greatest(F.lit(0).cast("long"),
                                        F.floor(part * (F.col(seats) - F.col("_half")) - 0.5).cast("long")))
    p = p.withColumn("_high", F.when(F.col(weight) > 0, F.ceil(
        part * (F.col(seats) + F.col("_half")) + 0.5).cast("long") + 1).otherwise(F.col("_low")))
    p = p.withColumn("_open", F.col(seats) - F.sum("_low").over(group))
    q = p.withColumn("_k", F.explode_outer(F.when(
        F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high")))))
    q = q.withColumn("_quotient", F.col(weight) / (F.col("_k") * 2 - 1))
    best = group.orderBy(F.col("_quotient").desc_nulls_last(), *ids, "_k")
    won = ((F.row_number().over(best) <= F.col("_open")) & F.col("_k").isNotNull()).cast("long")
    # a party's rows are a subset of its group, so this needs no new shuffle
    q = q.withColumn("_won", won)
    return q.groupBy(*parties.columns).agg((F.first("_low") + F.sum("_won")).alias(out))


def _key(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def block_choices(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                  weights=WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS,
                  block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED,
                  name: Column | None = None) -> DataFrame:
    """One row per document and block: which words of the document lie in the
    block (``first_word``, ``n_words``) and how often the mix takes it
    (``times``).  Documents without words have one row without a block.

    Null texts count as empty, null sources are one source of their own, and
    repeated rows are documents of their own (``place`` tells them apart; among
    equal rows it does not matter which is which).  An empty table gives an
    empty result.  ``name``, if given, comes along as a column of that name.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                    word_count(F.col(text)).alias("size"), *([] if name is None else [name.alias("name")]))
    d = written(d, "sizes")                               # words are counted once
    targets = source_targets(d, weights, share, max_repeats)
    n_blocks = F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long")
    quotas = sainte_lague(targets.withColumn("n_blocks", n_blocks), [], ["source"], "target", "n_blocks",
                          "source_quota").drop("n_blocks")
    quotas = quotas.withColumn("n_shards", F.greatest(
        F.lit(1).cast("long"), F.ceil(F.col("source_size") / shard_words).cast("long")))

    def with_source(left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.withColumnRenamed("source", "_source")
        return left.join(right, left["source"].eqNullSafe(right["_source"])).drop("_source")

    order = _key(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    d = d.withColumn("order", order)
    d = with_source(d, quotas).withColumn(
        "shard", F.conv(F.substring("order", 25, 8), 16, 10).cast("long") % F.col("n_shards"))
    shards = d.groupBy("source", "source_quota", "shard").agg(F.sum("size").alias("shard_words"))
    shards = sainte_lague(shards.withColumn("w", F.col("shard_words").cast("double")), ["source", "source_quota"],
                          ["shard"], "w", "source_quota").select(
        F.col("source").alias("_source"), F.col("shard").alias("_shard"),
        F.ceil(F.col("shard_words") / block_words).cast("long").alias("blocks"), "quota")

    w = Window.partitionBy("source", "shard").orderBy("order", "doc_id", "size")
    d = d.withColumn("place", F.row_number().over(w)).withColumn("start", F.coalesce(
        F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    d = d.join(shards, d["source"].eqNullSafe(shards["_source"]) & (d["shard"] == shards["_shard"])) \
         .drop("_source", "_shard")
    d = d.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(
        F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)))))
    lo = F.greatest(F.col("start"), F.col("block") * block_words)
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    d = d.withColumn("first_word", lo - F.col("start")).withColumn("n_words", hi - lo)
    rank = F.dense_rank().over(Window.partitionBy("source", "shard").orderBy(
        F.when(F.col("block").isNotNull(), _key(seed, F.col("shard"), F.col("block"))).asc_nulls_last(),
        F.col("block").asc_nulls_last()))
    quota = F.least(F.col("quota"), F.col("blocks") * max_repeats)
    times = F.when(F.col("block").isNotNull(), F.floor(quota / F.col("blocks"))
                   + (rank <= quota % F.col("blocks")).cast("long"))
    return d.withColumn("times", F.coalesce(times, F.lit(0).cast("long"))).select(
        "doc_id", "source", "size", "source_size", "target", "shard", "place", "block", "first_word", "n_words",
        "times", *([] if name is None else ["name"]))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target (of its source)
    and taken, the words that the mix takes from it, repeats counted.  Options
    and odd rows as in :func:`block_choices`."""
    c = block_choices(docs, **options)
    return c.groupBy("source", "shard", "place", "doc_id", "size", "source_size", "target").agg(
        F.coalesce(F.sum(F.col("n_words") * F.col("times")), F.lit(0)).cast("long").alias("taken")
    ).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document comes back once
    for each pass over it, its text the words of the blocks taken in that pass
    (the whole text if all are).  A document of which nothing is taken is gone.
    Rows that repeat both id and text count as one document here (collapse them
    first if they should not); a null id is an id like any other."""
    name = F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")),
                       F.sha2(F.coalesce(F.col(text), F.lit("")), 256))

    def passes() -> DataFrame:
        c = block_choices(docs, doc_id=doc_id, text=text, name=name, **options).where("times > 0")
        c = c.withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
        c = c.groupBy("name", "pass").agg(
            F.sort_array(F.collect_set(F.struct("first_word", "n_words"))).alias("spans"), F.first("size").alias("size"))
        return c.withColumn("kept", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["n_words"])).select(
            "name", "spans", "size", "kept")

    d = packed_rows(docs, name=name).join(settled(docs.sparkSession, passes, "passes"), "name")
    whole, part = F.col("row")[text], F.col("kept") < F.col("size")
    d = d.withColumn("words", F.when(part, F.regexp_extract_all(whole, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))))
    cut = F.array_join(F.transform("spans", lambda s: F.array_join(
        F.slice("words", (s["first_word"] + 1).cast("int"), s["n_words"].cast("int")), "")), "")
    return unpacked_rows(d, docs.columns, **{text: F.when(part, cut).otherwise(whole)})
