"""Document fingerprints (operator 10), DataFrame functions only.

A text is a multiset of paragraphs: its lines, cut further at sentence ends and
after 120 characters.  Every paragraph is hashed to a wide vector and the
fingerprint is the sum of these vectors, each lane modulo a power of two.  So
order does not matter, and a paragraph is inserted or deleted by adding or
subtracting its vector (``insert``, ``delete``).

The vector has three parts:

* 8 lanes of 32 random bits, for equality;
* 128 lanes of one random bit, two lanes to a long.  With signs for bits, mean
  products of lanes estimate the inner products of the vectors of counts (a
  linear second-moment sketch), which give the likeness;
* the number of paragraphs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

PARAGRAPH = r"[^\n.!?]{0,120}[.!?\n]+|[^\n.!?]{1,120}"
STRONG = 8          # lanes modulo 2^32, for equality
SIGNS = 2           # hashes of 64 signs each
LOW = 0xFFFFFFFF
PAIR = 0x0000000100000001


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text, every character in exactly one; null has none."""
    return F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))


def _lanes(p: Column) -> list[Column]:
    """The paragraph's vector: 1 + STRONG + 32 * SIGNS longs."""
    lanes = [F.lit(1).cast("long")]
    for i in range(STRONG // 2):
        h = F.xxhash64(p, F.lit(f"equal{i}"))
        lanes += [h.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(h, 32)]
    for i in range(SIGNS):
        h = F.xxhash64(p, F.lit(f"sign{i}"))
        lanes += [F.shiftrightunsigned(h, k).bitwiseAND(F.lit(PAIR)) for k in range(32)]
    return lanes


N_LANES = 1 + STRONG + 32 * SIGNS


def _reduced(sums: list[Column]) -> Column:
    """Sums of lanes as one array, the equality lanes modulo 2^32.  A sign lane
    has 32 bits of its long, room for 2^31 paragraphs."""
    return F.array(*[F.coalesce(s, F.lit(0).cast("long")).bitwiseAND(F.lit(LOW)) if 0 < i <= STRONG
                     else F.coalesce(s, F.lit(0).cast("long")) for i, s in enumerate(sums)])


def vectors(rows: DataFrame, keys: list[str], text: str = "text", copies: Column | None = None) -> DataFrame:
    """(keys, vector): the summed vector of ``text`` for each key.

    Null and empty texts have the zero vector.  Rows that repeat a key must
    repeat its text, and ``copies`` says how many there are: their sum is
    divided by it."""
    p = rows.withColumn("_p", F.explode_outer(paragraphs(F.col(text))))
    lanes = [F.when(F.col("_p").isNotNull(), x) for x in _lanes(F.col("_p"))]
    sums = [F.sum(x) for x in lanes]
    if copies is not None:
        sums = [F.call_function("div", x, F.first(copies)) for x in sums]
    return p.groupBy(*keys).agg(_reduced(sums).alias("vector"))


def insert(vector: Column, other: Column) -> Column:
    """The fingerprint vector after the paragraphs of ``other`` are added."""
    return F.zip_with(F.zip_with(vector, other, lambda a, b: a + b),
                      F.sequence(F.lit(0), F.lit(N_LANES - 1)),
                      lambda x, i: F.when((i > 0) & (i <= STRONG), x.bitwiseAND(F.lit(LOW))).otherwise(x))


def delete(vector: Column, other: Column) -> Column:
    """The fingerprint vector after the paragraphs of ``other`` are taken out."""
    return F.zip_with(F.zip_with(vector, other, lambda a, b: a - b),
                      F.sequence(F.lit(0), F.lit(N_LANES - 1)),
                      lambda x, i: F.when((i > 0) & (i <= STRONG), x.bitwiseAND(F.lit(LOW))).otherwise(x))


def fingerprint(vector: Column) -> Column:
    """The vector as a hexadecimal string, 8 digits to an equality lane."""
    return F.array_join(F.transform(vector, lambda x: F.lower(F.hex(x))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two multisets of paragraphs from their vectors, 0 to 1:
    estimated x.y / (x.x + y.y - x.y) for their vectors of counts x and y, which
    is the Jaccard similarity if no paragraph repeats.  Exactly 1 for equal
    vectors (two empty texts too)."""
    def signed(x: Column, shift: int, n: Column) -> Column:
        return (F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(LOW)) * 2 - n).cast("double")

    n_a, n_b = a.getItem(0), b.getItem(0)
    lanes = F.zip_with(
        F.slice(a, 2 + STRONG, 32 * SIGNS), F.slice(b, 2 + STRONG, 32 * SIGNS),
        lambda x, y: F.struct(signed(x, 0, n_a).alias("p"), signed(x, 32, n_a).alias("q"),
                              signed(y, 0, n_b).alias("r"), signed(y, 32, n_b).alias("s")))
    zero = F.struct(F.lit(0.0).alias("ab"), F.lit(0.0).alias("aa"), F.lit(0.0).alias("bb"))
    sums = F.aggregate(lanes, zero, lambda t, v: F.struct(
        (t["ab"] + v["p"] * v["r"] + v["q"] * v["s"]).alias("ab"),
        (t["aa"] + v["p"] * v["p"] + v["q"] * v["q"]).alias("aa"),
        (t["bb"] + v["r"] * v["r"] + v["s"] * v["s"]).alias("bb")),
        lambda t: F.when(t["aa"] + t["bb"] - t["ab"] > 0, t["ab"] / (t["aa"] + t["bb"] - t["ab"])).otherwise(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), sums)))


def in_a_ring(keys: DataFrame, cols: list[str], also: str) -> DataFrame:
    """Adds ``prev``, the struct of ``cols`` and ``also`` of the row before in the
    order of ``cols``; the first row comes after the last.

    The keys are dealt out by range and written with the number of their range,
    so a window holds one range, and only the last key of each range meets in
    one task."""
    struct = F.struct(*cols, also)
    t = written(keys.repartitionByRange(*cols).withColumn("_range", F.spark_partition_id()), "ranges")
    last = t.groupBy("_range").agg(F.max(struct).alias("_last"))
    order = Window.orderBy("_range")
    wrap = F.last("_last").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last = last.select("_range", F.coalesce(F.lag("_last").over(order), wrap).alias("_before"))
    lag = F.lag(struct).over(Window.partitionBy("_range").orderBy(*cols))
    return t.withColumn("_lag", lag).join(last, "_range") \
            .withColumn("prev", F.coalesce("_lag", "_before")).drop("_range", "_lag", "_before")


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints every text and its edit, in which the last floor(n/4) of n
    code points give way to the first as many (or all) of the next document.

    Documents are in ascending order of (doc_id, SHA-256 of the text), a null
    doc_id after all others; after the last comes the first.  Null texts are
    empty.  Repeated rows (same id and text) are one document with one next
    one, and come back as often as they came in.  A lone document is its own
    next one.  An empty table gives an empty result.
    """
    base = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(0).cast("long")).alias("k"),
                       F.col(doc_id).isNull().alias("k_null"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.withColumn("h", F.sha2(F.col("text"), 256))
    key = ["k_null", "k", "h"]
    keys = base.withColumn("n", F.length("text").cast("long")).groupBy(*key).agg(
        F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    ring = written(in_a_ring(keys, key, "n"), "ring").withColumn("need", F.floor(F.col("n") / 4).cast("int"))

    to_prev = [F.col(f"prev.{c}").alias(c) for c in key]
    rows = base.join(ring, key)
    heads = rows.select(*to_prev, F.substring("text", F.lit(1), F.floor(F.col("prev.n") / 4).cast("int")).alias("head"))
    heads = heads.groupBy(*key).agg(F.max("head").alias("head"))  # equal for repeated rows
    rows = rows.join(heads, key)
    rows = rows.withColumn("edited", F.concat(
        F.substring("text", F.lit(1), (F.col("n") - F.col("need")).cast("int")), F.col("head")))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    both = rows.select(*key, "n", "copies", "prev", F.explode(F.array(
        F.struct(F.lit(0).alias("which"), F.lit("").alias("sha"), F.col("text").alias("text")),
        F.struct(F.lit(1).alias("which"), F.col("edited_sha256").alias("sha"), F.col("edited").alias("text")),
    )).alias("t")).select(*key, "n", "copies", "prev", "t.which", "t.sha", "t.text")
    v = vectors(both, [*key, "n", "copies", "prev", "which", "sha"], copies=F.col("copies"))
    v = v.groupBy(*key, "n", "copies", "prev").agg(
        F.max("sha").alias("edited_sha256"),
        F.max(F.when(F.col("which") == 0, F.col("vector"))).alias("vector"),
        F.max(F.when(F.col("which") == 1, F.col("vector"))).alias("edited_vector"))
    # rows lie by key already; only each vector moves, to the document before
    v = v.join(vectors(rows.select(*key, "copies", "prev", "text"), [*key, "prev"], copies=F.col("copies")).select(
        *to_prev, F.col("vector").alias("next_vector")), key)
    v = v.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return v.select(
        F.when(~F.col("k_null"), F.col("k")).alias("doc_id"), F.col("n").alias("n_chars"), "edited_sha256",
        fingerprint(F.col("vector")).alias("fingerprint"),
        fingerprint(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        likeness(F.col("vector"), F.col("next_vector")).alias("near_next"))
