"""Merkle manifest of a dataset with pointer-jumping proofs (operator 13), DataFrame functions only.

Every row is a leaf.  The leaves of a source, in order, are the bottom of a tree
whose nodes hash up to three consecutive nodes below them; the tops of the
sources are, in order, the bottom of one more tree, whose top is the root.

1. Places.  Rows are sorted by ranges, counted per range, and a running sum over
   the ranges gives each row its place, so a source of any size is ranked by as
   many tasks as it has ranges.
2. Trees.  Blocks of 27 nodes become three levels per shuffle.
3. Proofs.  A node holds its siblings (one segment) and points to its parent.
   A self-join replaces the pointer by the pointer of the node it leads to and
   puts that node's segments behind its own, so the distance doubles with every
   join.  Inner nodes jump until all have reached the root; a leaf, most of the
   nodes, then takes the finished path of its parent in one join.

A node at distance d has 3^d nodes below it at most, so while there are many
nodes to point to, none is hot; when there are few, they are a small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Children of a node, and levels that one shuffle builds.
ARITY, LEVELS = 3, 3
BLOCK = ARITY ** LEVELS
#: The number of the tree over the sources.
TOP = -1


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 of the fields one after the other, as bytes."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.unhex(F.lit("")), lambda a, b: F.concat(a, b))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``place``, the place of each row in the order, from 0.

    Each range of rows is sorted by itself and its rows are counted; what stands
    before a range is a running sum over one row per range."""
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "at", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("range", F.shiftright("at", 33))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = rows.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select(
        "range", F.coalesce(before, F.lit(0).cast("long")).alias("before"))
    return rows.join(sizes, "range").withColumn(
        "place", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("range", "at", "before")


def _levels(nodes: DataFrame, base: int) -> DataFrame:
    """Blocks of nodes (tree, size, idx, digest, tag) of level ``base``: their
    ``rows`` (level, idx, digest, left, right, last, alone, tag) on LEVELS levels, and
    ``up``, the digest on top of them.  ``left`` and ``right`` are the siblings in a
    node's run, ``last`` says that its parent is the top of the tree, ``alone``
    that the tree has but one leaf.  Tops have no row, but for lone leaves."""
    b = nodes.groupBy("tree", "size", F.floor(F.col("idx") / BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct((F.col("idx") % BLOCK).alias("k"), "digest", "tag"))).alias("members"))
    b = b.withColumn("l0", F.transform("members", lambda m: m["digest"]))
    none = F.lit(None).cast(dict(nodes.dtypes)["tag"])

    def above(here: Column) -> Column:
        """The hashes of the runs of a level."""
        runs = F.sequence(F.lit(0), F.floor((F.size(here) - 1) / ARITY).cast("int"))
        run = lambda r: F.array_join(F.transform(F.slice(here, r * ARITY + 1, F.lit(ARITY)), _hex), "")
        return F.transform(runs, lambda r: F.unhex(F.sha2(run(r), 256)))

    def own(j: int, here: Column) -> Column:
        """The rows of a level."""
        tag = (lambda i: F.col("members")[i]["tag"]) if j == 0 else (lambda i: none)
        return F.transform(here, lambda d, i: F.struct(
            F.lit(base + j).alias("level"), (F.col("block") * ARITY ** (LEVELS - j) + i).alias("idx"), d.alias("digest"),
            _joined(F.slice(here, i - i % ARITY + 1, i % ARITY)).alias("left"),
            _joined(F.slice(here, i + 2, F.lit(ARITY - 1) - i % ARITY)).alias("right"),
            (F.col("size") <= ARITY ** (j + 1)).alias("last"), (F.col("size") <= 1).alias("alone"), tag(i).alias("tag")))

    rows = []
    for j in range(LEVELS):
        here, many = F.col(f"l{j}"), F.col("size") > ARITY ** j
        b = b.withColumn(f"l{j + 1}", F.when(many, above(here)).otherwise(here))
        rows.append(own(j, here) if base + j == 0 else F.when(many, own(j, here)).otherwise(F.slice(own(j, here), 1, 0)))
    return b.select("tree", "size", "block", F.concat(*rows).alias("rows"), F.col(f"l{LEVELS}")[0].alias("up"))


def trees(nodes: DataFrame, largest: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """(rows, tops) of the trees over nodes (tree, size, idx, digest, tag): tables of
    the nodes below the tops, as in :func:`_levels`, and (tree, digest) of the
    tops.  ``largest`` is the size of the largest tree."""
    rows, base = [], 0
    while True:
        b = written(_levels(nodes, base), f"{name}-{base}")
        rows.append(b.select("tree", F.inline("rows")))
        if largest <= BLOCK:
            return rows, b.select("tree", F.col("up").alias("digest"))
        # a tree that has ended goes along as its one node
        nodes = b.select("tree", F.ceil(F.col("size") / BLOCK).cast("long").alias("size"), F.col("block").alias("idx"),
                         F.col("up").alias("digest"), F.lit(None).cast(dict(nodes.dtypes)["tag"]).alias("tag"))
        largest, base = -(-largest // BLOCK), base + LEVELS


def pointed(rows: DataFrame, over_sources: bool) -> DataFrame:
    """Tree rows as nodes that jump: ``up``, the key (tree, level, idx) of the parent
    or null below the root, and ``path``, the segments towards it, so far their own."""
    ends = F.col("last") | F.col("alone")
    key = lambda tree, level, idx: F.struct(
        tree.cast("long").alias("tree"), level.cast("int").alias("level"), idx.cast("long").alias("idx"))
    parent = key(F.col("tree"), F.col("level") + 1, F.floor(F.col("idx") / ARITY))
    top = F.lit(None).cast("struct<tree:bigint,level:int,idx:bigint>") if over_sources else key(
        F.lit(TOP), F.lit(0), F.col("tree"))
    path = F.array(F.struct("left", "right"))
    return rows.withColumn("up", F.when(ends, top).otherwise(parent)).withColumn(
        "path", F.when(F.col("alone"), F.slice(path, 1, 0)).otherwise(path)).withColumn(
        "node", key(F.col("tree"), F.col("level"), F.col("idx")))


def jump(nodes: DataFrame, distance: int) -> DataFrame:
    """Nodes (node, up, path) with their paths up to the root.

    A join follows each pointer and takes over the pointer and the segments
    found there, so what was 1, 2, 4, ... levels away is twice as far; after
    log2(``distance``) joins, the longest way to the root, none points anywhere."""
    step = 1
    while step < distance:
        # what is pointed to lies ``step`` levels above a node, or in the tree over the sources
        over = nodes.where((F.col("node.level") > step) | (F.col("node.tree") == TOP))
        over = written(over.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("path").alias("more")), "over")
        moved = nodes.where("up IS NOT NULL").join(over, "up").select(
            "node", F.col("next").alias("up"), F.concat("path", "more").alias("path"))
        nodes = written(nodes.where("up IS NULL").select("node", "up", "path").unionByName(moved), "jump")
        step *= 2
    return nodes


def height(n: int) -> int:
    """Levels above the leaves of a tree."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def manifest(docs: DataFrame, doc_id: str = "doc_id", source: str = "source",
             lang: str = "lang", n_chars: str = "n_chars", text: str = "text", altered: Column | None = None) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, path (array of (left, right), the
    siblings towards the root as bytes), proof_sha256 of the siblings, and
    folded_root and verified for the text ``altered`` in place of the own one
    (null or not given: the own one).

    Null fields are leaves of their own kind (``-``); null sources are one source
    and come first, null ids first in their source.  Repeated rows are leaves
    next to each other; rows that share an id are in order of their digest.  A
    single row is its own root with an empty proof.  Other columns are ignored
    and an empty table gives an empty result."""
    def digest(body: Column) -> Column:
        return leaf_digest(F.col(doc_id), F.col(source), F.col(lang), F.col(n_chars), body)

    other = F.lit(None).cast("binary") if altered is None else F.when(
        altered.isNotNull() & (altered != F.col(text)), digest(altered))
    leaves = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                                 digest(F.col(text)).alias("digest"), other.alias("other")).withColumn(
        "row", F.monotonically_increasing_id()), "leaves")
    leaves = numbered(leaves, [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.col("digest"), F.col("row")],
                      "leaf-places")
    sources = leaves.groupBy("source").agg(F.count(F.lit(1)).alias("size"), F.min("place").alias("first"))
    sources = written(numbered(sources, [F.col("first")], "source-places").select(
        F.col("source").alias("_source"), "size", "first", F.col("place").alias("tree")), "sources")
    n = sources.agg(F.max("size").alias("largest"), F.count(F.lit(1)).alias("sources")).first()
    largest, n_sources = n["largest"] or 0, n["sources"]

    bottom = leaves.join(sources, F.col("source").eqNullSafe(F.col("_source"))).select(
        "tree", "size", (F.col("place") - F.col("first")).alias("idx"), "digest",
        F.struct("doc_id", "other").alias("tag"))
    below, tops = trees(bottom, largest, "tree")
    roof = tops.select(F.lit(TOP).cast("long").alias("tree"), F.lit(n_sources).cast("long").alias("size"),
                       F.col("tree").alias("idx"), "digest", F.lit(None).cast("int").alias("tag"))
    above, root = trees(roof, n_sources, "roof")
    first = root.first()
    root_hex = F.lit(first["digest"].hex() if first else None).cast("string")

    inner = [pointed(r.where("level > 0"), False) for r in below] + [pointed(r, True) for r in above]
    inner = [r.select("node", "up", "path") for r in inner]
    nodes = inner[0]
    for r in inner[1:]:
        nodes = nodes.unionByName(r)
    paths = jump(written(nodes, "nodes"), height(largest) + height(n_sources) + 1)

    leaf = pointed(below[0].where("level = 0"), False).select(
        "tag.doc_id", "tag.other", "tree", "digest", "up", F.col("path").alias("own"))
    leaf = leaf.join(paths.select(F.col("node").alias("up"), "path"), "up").join(
        tops.select("tree", F.col("digest").alias("top")), "tree")
    path = F.concat("own", "path")
    siblings = F.array_join(F.transform(path, lambda s: F.concat(_hex(s["left"]), _hex(s["right"]))), "")
    folded = F.aggregate(path, _hex(F.coalesce("other", "digest")), lambda h, s: F.sha2(
        F.concat(_hex(s["left"]), h, _hex(s["right"])).cast("binary"), 256))
    return leaf.select("doc_id", _hex(F.col("digest")).alias("leaf"), _hex(F.col("top")).alias("subroot"),
                       root_hex.alias("root"), path.alias("path"), F.sha2(siblings, 256).alias("proof_sha256"),
                       folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def verified_manifest(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The manifest held against a copy of the rows in which the texts of every
    other document (2 divides the CRC-32 of the id) have lost their line feeds."""
    hit = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 2 == 0
    return manifest(docs, doc_id=doc_id, text=text, altered=F.when(hit, F.translate(F.col(text), "\n", ""))).drop("path")
