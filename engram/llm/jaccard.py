"""N-gram Jaccard join with several global token orders (operator 3).

Exact.  The tokens of a document are its distinct word n-grams (64-bit hashes).
Two sets of at least ``t`` Jaccard similarity share a token among the first
n - ceil(t n) + 1 of each, whatever the order of all tokens is; so candidates
must share such a prefix token under every one of several orders.  All orders
put the corpus's most frequent tokens last, by their count, and shuffle the rest
by hashes of their own.

The first order is joined for real: documents meet in the lists of its prefix
tokens, one list per token and class of sizes, as only sets of comparable size can
be similar.  A set near the upper end of its class is in the list of the next class
too.  Tokens shared by chance mostly belong to texts of other lengths, so their
lists end up with one row and are gone.  The prefixes under the other orders travel along as bit sets, and so
does the parity of the counts of tokens in some cells (sets that differ in few
tokens differ in no more parities).  Size, place of the token, the other
prefixes and parity are all necessary conditions; what passes them all is
verified on the whole sets.

Linked documents are wanted as components, so:

* equal sets are one class;
* first, lists are joined to neighbours only (all pairs in short lists), and
  what is verified gives components;
* then pairs of the long lists are tried, but only between components: first a
  few of each row, at last all.

A group of thousands of near copies costs about as many verified pairs as it
has members, and no link between different components is left out.  A long
list is cut into blocks, and pairs of blocks are tasks of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import _U, SpanHasher, _mix
from .common import packed_rows, settled, text_batches, unpacked_rows, written
from .graph import components

WORDS, THRESHOLD = 5, (4, 5)
#: Tokens that all orders put last: the most frequent ones.
FREQUENT = 1 << 17
#: A task counts tokens in portions of so many, and reports those seen this often.
PORTION, REPORTED = 1 << 22, 3
#: Lists up to this length have all pairs tried at once; in longer ones rows are first paired with the next few.
SHORT, NEIGHBOURS = 8, 2
#: A class of sizes spans so many steps of 1 / threshold.
CLASS = 4
#: Rows of a list in one block.
BLOCK = 4096
SETS, PARITY, WIDE = 128, 256, 1024   # bits
#: Bits of the filter for the documents whose whole sets are wanted (4 MB).
FILTER = 1 << 25
#: Bytes of text whose words are hashed together.
CHUNK = 1 << 18


# ------------------------------------------------------------------- tokens

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def shingle_sets(texts: list[str], words: int, hasher: SpanHasher) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text: of ``words`` words in a
    row, or of all if there are fewer.  Words are runs of anything but space,
    tab, LF, VT, FF and CR; A-Z count as a-z."""
    first = 0
    while first < len(texts):
        raw, size, stop = [], 0, first
        while stop < len(texts) and (not raw or size < CHUNK):
            raw.append(texts[stop].encode("utf-8", "replace"))
            size += len(raw[-1])
            stop += 1
        buffer = _LOWER[np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)]
        space = _SPACE[buffer]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        start, end = edge[0::2], edge[1::2]
        h = hasher(buffer, start, end)
        ends = np.cumsum([len(b) + 1 for b in raw])
        upto = np.searchsorted(start, ends)
        scale = _mix(np.arange(1, words + 1, dtype=_U) * _U(0xD6E8FEB86659FD93)) | _U(1)
        n = max(0, len(h) - words + 1)
        grams = np.full(n, words, dtype=_U)
        for j in range(words):
            grams += h[j:j + n] * scale[j]
        grams = _mix(grams)
        a = 0
        for b in upto.tolist():
            if b - a >= words:
                yield np.unique(grams[a:b - words + 1])
            elif b > a:
                yield _mix(np.array([sum((int(x) * int(s) for x, s in zip(h[a:b], scale, strict=False)), b - a)
                                     & 0xFFFFFFFFFFFFFFFF], dtype=_U))
            else:
                yield np.empty(0, dtype=_U)
            a = b
        first = stop


def prefix_size(n: int, threshold: tuple[int, int]) -> int:
    """n - ceil(t n) + 1 for t = threshold[0] / threshold[1]."""
    return n - -(-threshold[0] * n // threshold[1]) + 1


class Orders:
    """Several orders of all tokens; ``last`` (sorted) with their ``ranks`` come
    after all others."""

    def __init__(self, last: np.ndarray, ranks: np.ndarray) -> None:
        self.last, self.ranks = last, ranks

    def level(self, tokens: np.ndarray) -> np.ndarray:
        """0 for a token that is not among the last, else 1 + its rank."""
        if not len(self.last):
            return np.zeros(len(tokens), dtype=_U)
        at = np.minimum(np.searchsorted(self.last, tokens), len(self.last) - 1)
        return np.where(self.last[at] == tokens, self.ranks[at] + _U(1), _U(0))

    @staticmethod
    def prefix(tokens: np.ndarray, level: np.ndarray, order: int, size: int) -> np.ndarray:
        """The first ``size`` tokens of a (sorted) set under an order."""
        shuffled = _mix(tokens ^ _U(0x632BE59BD9B4E019 * (order + 1) & 0xFFFFFFFFFFFFFFFF)) >> _U(1)
        key = np.where(level > 0, _U(1 << 63) + level, shuffled)
        return tokens[np.argsort(key, kind="stable")[:size]]


def bit_row(tokens: np.ndarray, second: np.ndarray, third: np.ndarray) -> bytes:
    """Bit sets of the second and third prefix, and the parities of all tokens."""
    bits = np.zeros(2 * SETS + PARITY, dtype=bool)
    bits[((second >> _U(7)) % _U(SETS)).astype(np.int64)] = True
    bits[SETS + ((third >> _U(7)) % _U(SETS)).astype(np.int64)] = True
    bits[2 * SETS:] = np.bincount(((tokens >> _U(17)) % _U(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(bits).tobytes()


def parity_row(tokens: np.ndarray) -> bytes:
    """The parities of the counts of tokens in at least as many cells as there are
    tokens (a power of two, so that a longer row folds onto a shorter one)."""
    cells = max(WIDE, 1 << (len(tokens) - 1).bit_length())
    count = np.bincount(((tokens >> _U(13)) % _U(cells)).astype(np.int64), minlength=cells)
    return np.packbits((count & 1).astype(bool)).tobytes()


def folded(parity: bytes, cells: int) -> bytes:
    """A row of parities folded to fewer cells."""
    x = np.frombuffer(parity, dtype=np.uint8)
    while len(x) > cells // 8:
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return x.tobytes()


def parity_distance(a: bytes, b: bytes) -> int:
    """A lower bound on the number of tokens that are in one set alone."""
    cells = 8 * min(len(a), len(b))
    x, y = (np.frombuffer(folded(p, cells), dtype=np.uint8) for p in (a, b))
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


# ----------------------------------------------------------- pairs in lists

def list_pairs(key: np.ndarray, n: np.ndarray, pos: np.ndarray, bits: np.ndarray, block: np.ndarray,
               cross: np.ndarray, threshold: tuple[int, int], label: np.ndarray | None,
               reach: np.ndarray, most_each: int | None = None, below: np.ndarray | None = None
               ) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of the same list that may be similar enough, of those not
    more than ``reach[i]`` rows apart; i takes part in ``most_each`` pairs with
    later rows at most, if given.  Rows are sorted by (key, n).  ``cross`` lists
    only pair rows of different blocks, ``label`` (if given) must differ, and of two rows
    one at least must not be ``below`` (if given) the class of the list."""
    num, den = threshold
    half = SETS // 64
    out_i, out_j = [], []
    taken = np.zeros(len(key), dtype=np.int64)
    i = np.arange(len(key))
    d = 0
    while len(i):
        d += 1
        i = i[(i + d < len(key)) & (reach[i] >= d)]
        if most_each is not None:
            i = i[taken[i] < most_each]
        j = i + d
        go = (key[i] == key[j]) & (den * n[i] >= num * n[j])
        i, j = i[go], j[go]
        ok = ~cross[i] | (block[i] != block[j])
        if below is not None:
            ok &= ~(below[i] & below[j])
        if label is not None:
            ok &= label[i] != label[j]
        a, b = i[ok], j[ok]
        both = n[a] + n[b]
        least = -(-num * both // (num + den))                     # tokens that they must share
        ok = 1 + np.minimum(n[a] - pos[a], n[b] - pos[b]) - 1 >= least
        a, b, most = a[ok], b[ok], (both - 2 * least)[ok]
        if len(a):
            common = bits[a, :2 * half] & bits[b, :2 * half]
            ok = common[:, :half].any(axis=1) & common[:, half:].any(axis=1)
            apart = np.bitwise_count(bits[a, 2 * half:] ^ bits[b, 2 * half:]).sum(axis=1, dtype=np.int64)
            ok &= apart <= most
            a, b = a[ok], b[ok]
            taken[a] += 1
            out_i.append(a)
            out_j.append(b)
    empty = np.empty(0, dtype=np.int64)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (empty, empty)


def _pairs(lists: DataFrame, threshold: tuple[int, int], labelled: bool, most_each: int | None = None) -> DataFrame:
    """Distinct candidate pairs (a, b) of the list rows (token, bi, bj, block, n,
    pos, below, cid, bits, size and, if ``labelled``, label).  Without labels long lists
    only pair neighbours; with them rows of different labels, however far, but
    none with more than ``most_each`` later ones of its list."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(pdf: pd.DataFrame) -> pd.DataFrame:
            token, bi, bj = (pdf[c].to_numpy() for c in ("token", "bi", "bj"))
            new = np.ones(len(pdf), dtype=bool)
            new[1:] = (token[1:] != token[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])
            key = np.cumsum(new)
            n, pos, block, cid = (pdf[c].to_numpy() for c in ("n", "pos", "block", "cid"))
            bits = np.frombuffer(b"".join(pdf["bits"]), dtype=_U).reshape(len(pdf), -1)
            long = pdf["size"].to_numpy() > SHORT
            label = pdf["label"].to_numpy() if labelled else None
            reach = np.full(len(pdf), len(pdf)) if labelled else np.where(long, NEIGHBOURS, SHORT)
            i, j = list_pairs(key, n, pos, bits, block, bi != bj, threshold, label, reach, most_each,
                              pdf["below"].to_numpy())
            out = pd.DataFrame({"a": np.minimum(cid[i], cid[j]), "b": np.maximum(cid[i], cid[j])})
            return out.drop_duplicates()

        kept = None
        for pdf in batches:
            pdf = pdf if kept is None else pd.concat([kept, pdf], ignore_index=True)
            last = pdf.iloc[-1] if len(pdf) else None
            if last is None:
                continue
            same = ((pdf["token"] == last["token"]) & (pdf["bi"] == last["bi"]) & (pdf["bj"] == last["bj"])).to_numpy()
            cut = int(np.argmax(same))                           # the last list may go on
            kept = pdf.iloc[cut:]
            if cut:
                yield done(pdf.iloc[:cut])
        if kept is not None and len(kept):
            yield done(kept)

    cols = ["token", "bi", "bj", "block", "n", "pos", "below", "cid", "bits", "size"] + ["label"] * labelled
    dealt = lists.select(*cols).repartition("token", "bi", "bj").sortWithinPartitions("token", "bi", "bj", "n", "cid")
    return dealt.mapInPandas(run, "a long, b long").distinct()


# -------------------------------------------------------------------- Spark

def _runs(held: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of a sorted array that it has ``least`` times or more, with their counts."""
    head = held[: max(0, len(held) - least + 1)] == held[least - 1:]  # at least so many from here on
    head[1:] &= held[1: len(head)] != held[: max(0, len(head) - 1)]
    at = np.flatnonzero(head)
    return held[at], np.searchsorted(held, held[at], side="right") - at


def _frequent(docs: DataFrame, words: int) -> Orders:
    """Counts tokens over all documents and keeps the most frequent for the
    orders (at most FREQUENT, whatever the corpus).  A task reports the tokens
    that it has seen REPORTED times in a portion; rarer ones stay unranked."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, held, size = SpanHasher(), np.empty(PORTION, dtype=_U), 0

        def report() -> pd.DataFrame:
            held[:size].sort()                                   # in its place: a portion is held once
            token, count = _runs(held[:size], REPORTED)
            return pd.DataFrame({"token": token.view(np.int64), "n": count})

        for pdf in batches:
            for s in shingle_sets(pdf["text"].tolist(), words, hasher):
                at = 0
                while at < len(s):
                    some = s[at:at + PORTION - size]
                    held[size:size + len(some)] = some
                    size += len(some)
                    at += len(some)
                    if size == PORTION:
                        yield report()
                        size = 0
        if size:
            yield report()

    top = docs.select("text").mapInPandas(run, "token long, n long").groupBy("token").agg(
        F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT)
    with text_batches(docs.sparkSession):
        top = top.toPandas()
    token = top["token"].to_numpy(dtype=np.int64).view(_U)
    rank = np.arange(len(token), 0, -1, dtype=np.int64).astype(_U)       # the most frequent comes last of all
    order = np.argsort(token)
    return Orders(token[order], rank[order])


def _described(docs: DataFrame, words: int, threshold: tuple[int, int], orders: Orders) -> DataFrame:
    """(k, n, s1, s2, prefix, bits, parity) of each document: the size of its
    set, two hashes that name the set, the prefix under the first order, the bits
    that go along with each prefix token, and the longer row of parities."""
    shared = docs.sparkSession.sparkContext.broadcast(orders)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, order = SpanHasher(), shared.value
        for pdf in batches:
            rows = []
            for s in shingle_sets(pdf["text"].tolist(), words, hasher):
                if not len(s):
                    rows.append((0, 0, 0, [], b"", b"", b""))
                    continue
                level, size = order.level(s), prefix_size(len(s), threshold)
                p = [order.prefix(s, level, k, size) for k in range(3)]
                rows.append((len(s), int(_mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U).view(np.int64)),
                             int(_mix(s ^ _U(0x14057B7EF767814F)).sum(dtype=_U).view(np.int64)),
                             p[0].view(np.int64), bit_row(s, p[1], p[2]), parity := parity_row(s),
                             folded(parity, WIDE)))
            out = pd.DataFrame(rows, columns=["n", "s1", "s2", "prefix", "bits", "parity", "wide"])
            out.insert(0, "k", pdf["k"].to_numpy())
            yield out

    return docs.mapInPandas(
        run, "k string, n long, s1 long, s2 long, prefix array<long>, bits binary, parity binary, wide binary")


def _sets(docs: DataFrame, words: int, wanted: DataFrame) -> DataFrame:
    """(cid, grams): the whole sets of the classes in ``wanted`` (cid, k, s1, s2),
    once for each row that has the class's id and set.

    The texts are not shuffled: a bit set of fixed size (FILTER bits) tells the
    scan which documents may be wanted, and only sets of those go on.  Were it
    full, it would let all pass and still nothing be lost."""
    bit = lambda k: F.xxhash64(k).bitwiseAND(F.lit(FILTER - 1))
    held = wanted.select(bit("k").alias("bit")).groupBy(F.shiftright("bit", 5).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("bits")).toPandas()
    table = np.zeros(FILTER >> 5, dtype=np.int64)
    table[held["word"].to_numpy(dtype=np.int64)] = held["bits"].to_numpy(dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, bits = SpanHasher(), shared.value
        for pdf in batches:
            at = pdf["bit"].to_numpy()
            pdf = pdf[((bits[at >> 5] >> (at & 31)) & 1).astype(bool)]
            rows = [(int(_mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U).view(np.int64)),
                     int(_mix(s ^ _U(0x14057B7EF767814F)).sum(dtype=_U).view(np.int64)), s.view(np.int64))
                    for s in shingle_sets(pdf["text"].tolist(), words, hasher)]
            out = pd.DataFrame(rows, columns=["s1", "s2", "grams"])
            out.insert(0, "k", pdf["k"].to_numpy())
            yield out

    found = docs.select("k", bit("k").alias("bit"), "text").mapInPandas(
        run, "k string, s1 long, s2 long, grams array<long>")
    return found.join(wanted, ["k", "s1", "s2"]).select("cid", "grams")


def _close(pairs: DataFrame, classes: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose parities do not prove them too far apart, so that
    few whole sets are moved."""
    num, den = threshold

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = (pdf["na"] + pdf["nb"]).to_numpy()
            most = both - 2 * -(-num * both // (num + den))
            near = [parity_distance(x, y) for x, y in zip(pdf["pa"], pdf["pb"], strict=True)]
            yield pdf.loc[np.array(near, dtype=np.int64) <= most, ["a", "b"]]

    side = lambda c: classes.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"),
                                    F.col("parity").alias(f"p{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "pa", "pb").mapInPandas(
        run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The pairs whose sets are similar enough."""
    num, den = threshold
    left = sets.select(F.col("cid").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("cid").alias("b"), F.col("grams").alias("gb"))
    p = pairs.join(left, "a").join(right, "b")
    p = p.withColumn("both", F.size(F.array_intersect("ga", "gb")).cast("long"))
    union = F.size("ga") + F.size("gb") - F.col("both")
    return p.where(F.col("both") * den >= union * num).select("a", "b").distinct()


def classed(postings: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Postings (token, cid, n, pos) under a key of token and class of sizes, and
    again, marked ``below``, under the next class if sets of that may be similar."""
    step = CLASS * math.log(threshold[1] / threshold[0])
    at = F.ln("n") / step
    own = F.floor(at).cast("int")
    # the largest set that may be similar is 1 / threshold times as large
    top = F.floor(at + 1 / CLASS + 1e-9).cast("int")
    kind = F.explode(F.when(top > own, F.array(own, top)).otherwise(F.array(own)))
    p = postings.withColumn("own", own).select("token", "cid", "n", "pos", "own", kind.alias("class"))
    return p.select(F.xxhash64("token", "class").alias("token"), "cid", "n", "pos", (F.col("class") > F.col("own")).alias("below"))


def _lists(postings: DataFrame, bits: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Postings (token, cid, n, pos) in lists of at least two, with the bits; rows
    of long lists once for each pair of blocks that theirs is in."""
    postings = classed(postings, threshold)
    size = postings.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.bool_and("below").alias("idle"))
    p = written(postings.join(size.where("size > 1 AND NOT idle").drop("idle"), "token"), "postings")
    short = p.where(F.col("size") <= BLOCK).withColumns({c: F.lit(0).cast("long") for c in ("bi", "bj", "block")})
    place = F.row_number().over(Window.partitionBy("token").orderBy("n", "cid")) - 1
    long = p.where(F.col("size") > BLOCK).withColumn("block", F.floor(place / BLOCK))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / BLOCK)))
    long = long.withColumn("other", other).withColumn("bi", F.least("block", "other")).withColumn(
        "bj", F.greatest("block", "other")).drop("other")
    return short.unionByName(long).join(bits, "cid")


def similar_components(docs: DataFrame, words: int = WORDS, threshold: tuple[int, int] = THRESHOLD,
                       doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest doc_id that can
    be reached over links; documents link when the Jaccard similarity of their
    sets is at least threshold[0] / threshold[1].

    A set holds the distinct n-grams of ``words`` words, or the whole text as one
    if it has fewer.  Null texts and texts without words have none (size 0) and
    are linked with nothing.  Repeated rows are in one component (they have the
    same set), each gives a row; a null doc_id stays null and never names a
    component, unless all of it are null.  Other columns are ignored, an empty
    table gives an empty result."""
    # ids with a mark before them, so that a null one is a value too
    key = F.coalesce(F.concat(F.lit("i"), F.col(doc_id).cast("string")), F.lit("n"))
    base = docs.select(key.alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    described = written(_described(base, words, threshold, _frequent(base, words)), "described", texts=True)
    kind = docs.schema[doc_id].dataType
    own_id = F.when(F.col("k") != "n", F.expr("substring(k, 2)")).cast(kind)
    classes = described.where("n > 0").groupBy("s1", "s2", "n").agg(
        F.min(own_id).alias("id"), F.min("k").alias("k"),
        *[F.first(c).alias(c) for c in ("prefix", "bits", "parity", "wide")])
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    postings = classes.select("cid", "n", F.posexplode("prefix").alias("pos", "token"))
    lists = written(_lists(postings, classes.select("cid", "bits"), threshold), "lists")

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = written(_close(pairs, classes, threshold), "pairs")
        if pairs.isEmpty():
            return pairs
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(
            classes.select("cid", "k", "s1", "s2"), "cid")
        sets = written(_sets(base, words, wanted), "sets", texts=True)
        return written(_verified(pairs, sets, threshold), "links")

    links = linked(_pairs(lists, threshold, labelled=False))
    roots = written(components(links), "roots")
    # long lists, with a wider row of parities: first a few pairs of each row, then all that still lie apart
    long = lists.where(F.col("size") > SHORT).drop("bits")
    wide = classes.select("cid", F.concat(F.substring("bits", 1, 2 * SETS // 8), "wide").alias("bits"))
    now = None
    # a step that finds nothing leaves nothing to the next ones: the driver does not plan them
    for most_each in (4, None):
        if now is None:
            now = long.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn(
                "label", F.coalesce("root", "cid")).drop("root")
            mixed = written(now.groupBy("token").agg((F.min("label") != F.max("label")).alias("mixed")).where(
                "mixed").select("token"), "mixed")
            if mixed.isEmpty():
                break
            # bits are fetched for the rows that are left
            now = now.join(mixed, "token", "left_semi").join(wide, "cid")
        more = linked(_pairs(now, threshold, labelled=True, most_each=most_each))
        if more.isEmpty():
            continue
        # links within what is known are stars already
        known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = written(components(known.unionByName(more)), "roots")
        now = None

    named = classes.select("cid", "s1", "s2", "n", "id").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    named = named.withColumn("root", F.coalesce("root", "cid"))
    smallest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = named.join(smallest, "root").select("s1", "s2", "n", "component_id")
    rows = described.select(own_id.alias("doc_id"), "n", "s1", "s2")
    return rows.join(named, ["s1", "s2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_per_component(docs: DataFrame, words: int = WORDS, threshold: tuple[int, int] = THRESHOLD,
                      doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest
    id, one without an id only where no other has one.  Rows that share an id
    and differ in text are documents of their own; rows that repeat both are one."""
    # a name for each id and text, in the order of the ids, those without an id last
    place = F.lpad((F.col(doc_id).cast("decimal(20,0)") + F.lit(str(2 ** 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    of_text = F.coalesce(F.concat(F.hex(F.xxhash64(text)), F.lit("."), F.hex(F.xxhash64(text, F.lit(1)))), F.lit("-"))
    named = packed_rows(docs, name=F.concat(F.coalesce(place, F.lit("~")), F.lit(":"), of_text), text=F.col(text))
    # only the names that stay are kept as a table
    found = settled(docs.sparkSession, lambda: similar_components(named, words, threshold, doc_id="name").where(
        "doc_id = component_id").select(F.col("doc_id").alias("name")).distinct(), "kept-names")
    return unpacked_rows(named.join(found, "name", "left_semi").dropDuplicates(["name"]), docs.columns)
