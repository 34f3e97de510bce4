"""Removal of repeated passages by a common-prefix interval tree (operator 7).

Every string of ``length`` bytes that occurs more than once is found, wherever
its occurrences are, and all bytes that such strings cover are removed.

1. Anchors.  In every window of ``length`` bytes the k-gram with the smallest
   hash is the window's anchor (the leftmost of equals).  Equal windows have
   their anchor at the same place, so equal strings meet at equal anchors, of
   which there is about one in ``length``/2 bytes.
2. Candidates.  An anchor goes on only if the half window before or after it
   occurs elsewhere too: one hash of each is counted.
3. The suffixes that begin at the anchors, sorted, with the lengths of common
   prefixes of neighbours, are an enhanced suffix array.  A scan with a stack
   gives the tree of its prefix intervals.  In every interval the left contexts
   are tested: members that differ to the left end the extension, and what two
   members share to the left and right is a maximal repeat.  An interval holds
   all occurrences, not just neighbours.
4. What each anchor's surroundings share with any other becomes a byte range.

Texts that are equal as a whole are one text, and equal surroundings of an
anchor are one member of the array, so copies do not pile up in a task.  What
the tasks hand to each other are rows of bounded size (an anchor with fewer
than 2 * ``length`` bytes around it).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import _U, SpanHasher, _mix
from .common import packed_rows, settled, unpacked_rows, written

LENGTH = 400
GRAM = 24
#: Bytes of text that are hashed together.
BUFFER = 1 << 18
#: Distinct surroundings of one anchor that one task holds; beyond, see ``_windows``.
GROUP = 1 << 15


# ------------------------------------------------------------------ anchors

def _segments(raw: list[bytes], length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (text, from, to) of about BUFFER bytes.  Longer texts come in
    pieces that overlap by a window less a byte."""
    group, size = [], 0
    for i, b in enumerate(raw):
        at = 0
        while len(b) - at >= length:
            to = min(len(b), at + BUFFER)
            group.append((i, at, to))
            size += to - at
            if size >= BUFFER:
                yield group
                group, size = [], 0
            if to == len(b):
                break
            at = to - length + 1
    if group:
        yield group


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by minima of blocks from both ends."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.append(x, np.full(pad, np.iinfo(x.dtype).max, dtype=x.dtype)).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def anchors(raw: list[bytes], hasher: SpanHasher, length: int = LENGTH, gram: int = GRAM) -> Iterator[dict]:
    """The anchors of some texts: arrays text, pos, first and last (the starts
    of the windows that it is the anchor of), ahead and back (hashes of the half
    windows after and before it, 0 if the text ends there)."""
    half = length // 2
    for group in _segments(raw, length):
        buffer = np.frombuffer(b"".join(raw[i][a:b] for i, a, b in group), dtype=np.uint8)
        n = len(buffer)
        starts = np.arange(n - gram + 1)
        h = hasher(buffer, starts, starts + gram)
        # 40 bits of the hash, then the position: the leftmost of equals wins
        low = _smallest((h >> _U(24) << _U(24)) | starts.astype(_U), length - gram + 1)
        at = (low & _U((1 << 24) - 1)).astype(np.int64)
        sizes = np.array([b - a for _, a, b in group], dtype=np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        inside = np.zeros(n + 1, dtype=np.int32)
        inside[begins] += 1
        inside[ends - length + 1] -= 1
        window = np.flatnonzero(np.cumsum(inside)[:n] > 0)        # windows that lie in one text
        at = at[window]
        new = np.ones(len(at), dtype=bool)
        new[1:] = at[1:] != at[:-1]
        # the windows of an anchor follow each other: the leftmost minimum never moves back
        head = np.flatnonzero(new)
        pos, first = at[head], window[head]
        last = window[np.append(head[1:], len(window)) - 1]
        part = np.searchsorted(ends, pos, side="right")
        ahead = np.where(pos + half <= ends[part], hasher(buffer, pos, np.minimum(pos + half, n)), _U(0))
        back = np.where(pos - half >= begins[part], hasher(buffer, np.maximum(pos - half, 0), pos), _U(0))
        shift = np.array([a for _, a, _ in group], dtype=np.int64)[part] - begins[part]
        yield {"text": np.array([i for i, _, _ in group], dtype=np.int64)[part], "pos": pos + shift,
               "first": first + shift, "last": last + shift,
               # the two sides never meet each other
               "ahead": ahead.view(np.int64), "back": np.where(back > 0, _mix(back ^ _U(1)), back).view(np.int64)}


def packed(pos: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """An anchor's place in one number: position, and how far before and after
    it its windows begin (both less than 2^14)."""
    return (pos << 28) | ((pos - first) << 14) | (last - first)


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pos = place >> 28
    first = pos - ((place >> 14) & 0x3FFF)
    return pos, first, first + (place & 0x3FFF)


# ------------------------------------------------- enhanced suffix array

def _matrix(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings as rows of bytes, filled up with zeros, and their lengths."""
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), dtype=np.uint8).reshape(-1, width), sizes


def _common(m: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 8192) -> np.ndarray:
    """Lengths of the common prefixes of rows a and b."""
    out = np.empty(len(a), dtype=np.int64)
    for i in range(0, len(a), step):
        s = slice(i, i + step)
        differ = m[a[s]] != m[b[s]]
        out[s] = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])
    return np.minimum(out, np.minimum(sizes[a], sizes[b]))


def prefix_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """The common-prefix intervals (depth, first, last) of a suffix array, the
    inner ones before the outer; lcp[i] is that of suffixes i and i + 1."""
    stack: list[list[int]] = []
    for i, depth in enumerate([*lcp, 0]):
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i
        if depth and (not stack or stack[-1][0] < depth):
            stack.append([depth, first])


def repeats(group: np.ndarray, left: list[bytes], right: list[bytes], length: int = LENGTH) -> tuple:
    """For suffixes sorted by (group, right): how far to the left and right of
    its anchor each is covered by strings of ``length`` bytes that another member
    of its group has too; (0, 0) if by none.  ``left`` is read backwards."""
    n = len(group)
    reach_left, reach_right = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    if n < 2:
        return reach_left, reach_right
    width = length
    rm, rs = _matrix(right, width)
    lm, ls = _matrix(left, width)
    i = np.arange(n - 1)
    lcp = np.where(group[1:] == group[:-1], _common(rm, rs, i, i + 1), 0)
    rank = np.empty(n, dtype=np.int64)
    rank[sorted(range(n), key=left.__getitem__)] = np.arange(n)

    def mark(members: np.ndarray, shared: np.ndarray, depth: np.ndarray | int) -> None:
        ok = shared + depth >= length
        if ok.any():
            m = members[ok]
            np.maximum.at(reach_left, m, shared[ok])
            np.maximum.at(reach_right, m, np.broadcast_to(depth, shared.shape)[ok])

    pairs: list[tuple[int, int, int]] = []
    for depth, first, last in prefix_intervals(lcp.tolist()):
        if last == first + 1:
            pairs.append((depth, first, last))
            continue
        members = np.arange(first, last + 1)
        members = members[np.argsort(rank[first:last + 1])]
        near = _common(lm, ls, members[:-1], members[1:])
        shared = np.maximum(np.append(near, 0), np.append(0, near))
        mark(members, shared, depth)
    if pairs:
        depth, a, b = np.array(pairs, dtype=np.int64).T
        shared = _common(lm, ls, a, b)
        mark(a, shared, depth)
        mark(b, shared, depth)
    return reach_left, reach_right


# -------------------------------------------------------------------- Spark

def _candidates(docs: DataFrame, length: int) -> DataFrame:
    """(ha, hb, places): for each text the anchors that go on, packed."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = SpanHasher()
        for pdf in batches:
            raw = [t.encode("utf-8", "replace") for t in pdf["text"].tolist()]
            ha, hb = pdf["ha"].to_numpy(), pdf["hb"].to_numpy()
            for a in anchors(raw, hasher, length):
                place = packed(a["pos"], a["first"], a["last"])
                for side in ("ahead", "back"):
                    on = a[side] != 0
                    text = a["text"][on]
                    yield pd.DataFrame({"half": a[side][on], "ha": ha[text], "hb": hb[text], "place": place[on]})

    found = written(docs.select("ha", "hb", "text").where(F.octet_length("text") >= length).mapInPandas(
        run, "half long, ha long, hb long, place long"), "halves", texts=True)
    here = F.xxhash64("ha", "hb", "place")
    shared = found.groupBy("half").agg(F.min(here).alias("a"), F.max(here).alias("b")).where("a <> b").select("half")
    return found.join(shared, "half", "left_semi").groupBy("ha", "hb").agg(F.collect_set("place").alias("places"))


def _surroundings(texts: DataFrame, length: int) -> DataFrame:
    """(anchor, ctx, left, right, ha, hb, pos): the bytes before (backwards) and
    from each candidate, as far as its windows go; ctx names equal ones."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, size = [], 0
            for ha, hb, text, places in zip(pdf["ha"], pdf["hb"], pdf["text"], pdf["places"], strict=True):
                b = text.encode("utf-8", "replace")
                for pos, first, last in zip(*(x.tolist() for x in unpacked(np.sort(places))), strict=True):
                    left, right = b[first:pos][::-1], b[pos:last + length]
                    gram = hashlib.blake2b(right[:GRAM], digest_size=8).digest()
                    digest = hashlib.blake2b(len(left).to_bytes(4, "big") + left + right, digest_size=16).digest()
                    rows.append((int.from_bytes(gram, "big", signed=True), digest, left, right, ha, hb, pos))
                    size += len(left) + len(right)
                if size > 1 << 22:
                    yield pd.DataFrame(rows, columns=cols)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=cols)

    cols = ["anchor", "ctx", "left", "right", "ha", "hb", "pos"]
    return texts.mapInPandas(run, "anchor long, ctx binary, left binary, right binary, ha long, hb long, pos long")


def _tree(members: DataFrame, length: int) -> DataFrame:
    """(anchor, ctx, lo, hi) of the members (anchor, ctx, left, right, many)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(pdf: pd.DataFrame) -> pd.DataFrame:
            left, right = pdf["left"].tolist(), pdf["right"].tolist()
            lo, hi = repeats(pdf["anchor"].to_numpy(), left, right, length)
            whole = pdf["many"].to_numpy() & (pdf["left"].str.len() + pdf["right"].str.len() >= length).to_numpy()
            lo = np.where(whole, pdf["left"].str.len(), lo)
            hi = np.where(whole, pdf["right"].str.len(), hi)
            out = pd.DataFrame({"anchor": pdf["anchor"], "ctx": pdf["ctx"], "lo": lo, "hi": hi})
            return out[out["lo"] + out["hi"] > 0]

        kept = None
        for pdf in batches:
            pdf = pdf if kept is None else pd.concat([kept, pdf], ignore_index=True)
            anchor = pdf["anchor"].to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1])) if len(anchor) else 0   # the last group may go on
            kept = pdf.iloc[cut:]
            if cut:
                yield done(pdf.iloc[:cut])
        if kept is not None and len(kept):
            yield done(kept)

    dealt = members.repartition("anchor").sortWithinPartitions("anchor", "right", "left")
    return dealt.select("anchor", "ctx", "left", "right", "many").mapInPandas(
        run, "anchor long, ctx binary, lo long, hi long")


def _windows(members: DataFrame, length: int) -> DataFrame:
    """As ``_tree``, for anchors with more distinct surroundings than a task
    should hold: each window's hash is a row, and Spark counts them."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for anchor, ctx, left, right, many in pdf.itertuples(index=False):
                b = left[::-1] + right
                n = len(b) - length + 1
                if n > 0:
                    yield pd.DataFrame({
                        "anchor": anchor, "ctx": [ctx] * n, "back": len(left) - np.arange(n), "many": many,
                        "window": [hashlib.blake2b(b[i:i + length], digest_size=16).digest() for i in range(n)]})

    w = members.select("anchor", "ctx", "left", "right", "many").mapInPandas(
        run, "anchor long, ctx binary, back long, many boolean, window binary")
    shared = w.groupBy("anchor", "back", "window").agg(
        F.min("ctx").alias("a"), F.max("ctx").alias("b"), F.max("many").alias("many"))
    shared = shared.where("a <> b OR many").select("anchor", "back", "window")
    return w.join(shared, ["anchor", "back", "window"]).groupBy("anchor", "ctx").agg(
        F.max("back").alias("lo"), (F.lit(length) - F.min("back")).alias("hi"))


def _named(text: Column) -> dict[str, Column]:
    """Two numbers that name a text: hashes of its SHA-256."""
    sha = F.sha2(F.coalesce(text, F.lit("")), 256)
    return {"ha": F.xxhash64(sha), "hb": F.xxhash64(F.lit("b"), sha)}


def repeated_ranges(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    length: int = LENGTH, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(texts, ranges).  ``texts`` has a row for each distinct text: its name
    (ha, hb), n_bytes, copies.  ``ranges`` has ha, hb, text and spans, the
    sorted byte ranges (lo, hi) to remove, of the texts that occur once and have
    any."""
    base = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("k"),
                       F.coalesce(F.col(text), F.lit("")).alias("text")).withColumns(_named(F.col("text")))
    texts = written(base.groupBy("ha", "hb").agg(
        F.count(F.lit(1)).alias("copies"), F.min("k").alias("k"),
        F.max(F.octet_length("text")).cast("long").alias("n_bytes")), "texts")
    # each text once: copies have no partner under (ha, hb, k), so they spread over the tasks
    hits = _candidates(base, length).join(texts.select("ha", "hb", "k", "copies"), ["ha", "hb"])
    held = written(base.join(hits, ["ha", "hb", "k"]), "held")

    around = written(_surroundings(held.select("ha", "hb", "text", "places"), length), "surroundings", texts=True)
    here = F.xxhash64("ha", "hb", "pos")
    # a text with copies repeats as a whole
    whole = texts.where("copies > 1").select("ha", "hb", F.lit(True).alias("copied"))
    places = around.select("anchor", "ctx", "ha", "hb", "pos").join(whole, ["ha", "hb"], "left").groupBy(
        "anchor", "ctx").agg(((F.min(here) != F.max(here)) | F.coalesce(F.max("copied"), F.lit(False))).alias("many"))
    members = around.groupBy("anchor", "ctx").agg(F.first("left").alias("left"), F.first("right").alias("right"))
    members = written(members.join(places, ["anchor", "ctx"]), "members")
    large = members.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group).select("anchor")
    found = _tree(members.join(large, "anchor", "left_anti"), length).unionByName(
        _windows(members.join(large, "anchor", "left_semi"), length))
    spans = around.select("anchor", "ctx", "ha", "hb", "pos").join(found, ["anchor", "ctx"]).select(
        "ha", "hb", (F.col("pos") - F.col("lo")).alias("lo"), (F.col("pos") + F.col("hi")).alias("hi")).distinct()
    spans = spans.groupBy("ha", "hb").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    return texts, held.where("copies = 1").select("ha", "hb", "text").join(spans, ["ha", "hb"])


def _cut(ranges: DataFrame, with_text: bool) -> DataFrame:
    """Per text: its figures after the cut and, if asked for, what is left."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for ha, hb, text, spans in zip(pdf["ha"], pdf["hb"], pdf["text"], pdf["spans"], strict=True):
                b = text.encode("utf-8", "replace")
                parts, n_spans, removed, at = [], 0, 0, 0
                for s in spans:
                    lo, hi = s["lo"], s["hi"]
                    if n_spans and lo <= at:
                        removed += max(0, hi - at)
                        at = max(at, hi)
                        continue
                    parts.append(b[at:lo])
                    n_spans += 1
                    removed += hi - lo
                    at = hi
                parts.append(b[at:])
                left = b"".join(parts)
                rows.append((ha, hb, removed, n_spans, hashlib.sha256(left).hexdigest(),
                             left.decode("utf-8", "ignore") if with_text else None))
            yield pd.DataFrame(rows, columns=["ha", "hb", "n_removed", "n_spans", "kept_sha256", "kept"])

    return ranges.mapInPandas(
        run, "ha long, hb long, n_removed long, n_spans long, kept_sha256 string, kept string")


EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
                   group: int = GROUP) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and kept_sha256.

    Removes each byte covered by a string of ``length`` bytes that also starts
    anywhere else, in another document or the same.  Null texts are empty;
    texts shorter than ``length`` lose nothing; a text of at least ``length``
    bytes that another row repeats is removed whole, as is every such row.  A
    null doc_id stays null, other columns are ignored, an empty table gives an
    empty result."""
    texts, ranges = repeated_ranges(docs, doc_id, text, length, group)
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    result = texts.join(_cut(ranges, False).drop("kept"), ["ha", "hb"], "left").select(
        "ha", "hb", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(EMPTY_SHA)).otherwise(F.col("kept_sha256")).alias("cut_sha256"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("sha"),
                       *[c.alias(n) for n, c in _named(F.col(text)).items()])
    return rows.join(result, ["ha", "hb"]).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.coalesce("cut_sha256", "sha").alias("kept_sha256"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """The documents with what is left of their texts (whole characters only),
    all columns kept.  Documents of which nothing but white space is left, and
    had more, are gone; others all stay."""
    def cuts() -> DataFrame:
        texts, ranges = repeated_ranges(docs, doc_id, text, length)
        gone = texts.where((F.col("copies") > 1) & (F.col("n_bytes") >= length)).select("ha", "hb", F.lit("").alias("kept"))
        return _cut(ranges, True).select("ha", "hb", "kept").unionByName(gone)

    # only texts that change are kept as a table
    d = packed_rows(docs, **_named(F.col(text))).join(
        settled(docs.sparkSession, cuts, "cuts", texts=True), ["ha", "hb"], "left")
    d = d.where(F.col("kept").isNull() | (F.trim("kept") != ""))
    return unpacked_rows(d, docs.columns, **{text: F.coalesce("kept", F.col("row")[text])})
