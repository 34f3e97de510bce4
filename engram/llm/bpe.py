"""Byte-level BPE encoding and decoding with a two-tier lookup (operator 5).

A text is split into pre-tokens.  Tier one: a minimal perfect hash over the
vocabulary resolves every pre-token that is a token itself, for whole batches
of texts at once.  Tier two: the distinct pre-tokens that miss it are merged
pair by pair, lowest rank first, with a heap over linked bytes.

Work is per row (``mapInPandas``): no shuffle, some CHUNK_BYTES of text at a time,
and a lost task only repeats its own rows.  A longer text is taken in parts that
begin where a pre-token does, so the ids are those of the whole.  The tables are
built once on the driver and broadcast; their size is that of the vocabulary.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are split and looked up together.
CHUNK_BYTES = 1 << 18
#: Merged pre-tokens that a task remembers between batches.
REMEMBERED = 1 << 18
_U = np.uint64
_ROOT = _U(0x9E3779B97F4A7C15)          # odd, so it has an inverse modulo 2^64
_ROOT_INVERSE = _U(pow(int(_ROOT), -1, 1 << 64))


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file (base64, space, rank)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


# ---------------------------------------------------------------- hashing

def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(n: int, root: np.uint64) -> np.ndarray:
    p = np.full(n, root, dtype=_U)
    p[:1] = 1
    return np.multiply.accumulate(p)


class SpanHasher:
    """64-bit hashes of many byte spans of one buffer: prefix sums of
    (random value of the byte) * root^position, shifted back to position 0."""

    def __init__(self) -> None:
        self.values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=_U) | _U(1)
        self.up = self.down = np.empty(0, dtype=_U)

    def __call__(self, buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(buffer) + 1
        if len(self.up) < n:
            self.up, self.down = _powers(n, _ROOT), _powers(n, _ROOT_INVERSE)
        sums = np.zeros(n, dtype=_U)
        np.cumsum(self.values[buffer] * self.up[: n - 1], out=sums[1:])
        return _mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(_U))


class MinimalPerfectHash:
    """Hash and displace: keys fall into buckets; the buckets, largest first,
    each look for a pilot that sends their keys to slots still free.  n keys
    fill n slots.  ``find`` gives the slot's value where the slot holds that
    very 64-bit hash and length, else -1."""

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> None:
        n = len(hashes)
        if len(np.unique(hashes)) != n:
            raise ValueError("two tokens share a hash; choose other byte values")
        self.n, self.n_buckets = n, max(1, n // 3)
        bucket = (hashes % _U(self.n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.cumsum(np.bincount(bucket, minlength=self.n_buckets))
        groups = np.split(order, ends[:-1])
        self.pilots = np.zeros(self.n_buckets, dtype=_U)
        taken = np.zeros(n, dtype=bool)
        slots = np.empty(n, dtype=np.int64)
        few = 64
        for b in sorted(range(self.n_buckets), key=lambda b: -len(groups[b])):
            keys = groups[b]
            if not len(keys):
                break
            first = 0
            while True:
                pilots = np.arange(first, first + few, dtype=_U)
                at = (_mix(hashes[keys][None, :] ^ _mix(pilots[:, None] + _ROOT)) % _U(n)).astype(np.int64)
                fits = ~taken[at].any(axis=1)
                if len(keys) > 1 and fits.any():
                    s = np.sort(at, axis=1)
                    fits &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if fits.any():
                    k = int(np.argmax(fits))
                    self.pilots[b], slots[keys], taken[at[k]] = pilots[k], at[k], True
                    break
                first += few
                few = min(2 * few, 1 << 14)
            few = 64
        self.hashes, self.lengths, self.values = (np.empty(n, dtype=x.dtype) for x in (hashes, lengths, values))
        self.hashes[slots], self.lengths[slots], self.values[slots] = hashes, lengths, values

    def find(self, hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.full(len(hashes), -1, dtype=np.int64)
        pilot = self.pilots[(hashes % _U(self.n_buckets)).astype(np.int64)]
        at = (_mix(hashes ^ _mix(pilot + _ROOT)) % _U(self.n)).astype(np.int64)
        return np.where((self.hashes[at] == hashes) & (self.lengths[at] == lengths), self.values[at], -1)


# ---------------------------------------------------------- pre-tokenising

_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3
_CLASSES: np.ndarray | None = None


def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    global _CLASSES
    if _CLASSES is None:
        import regex
        table = np.zeros(0x110000, dtype=np.uint8)
        for first in range(0, 0x110000, 1 << 12):                 # some at a time, so that nothing large is left behind
            if 0xD800 <= first < 0xE000:
                continue
            text = "".join(map(chr, range(first, first + (1 << 12))))
            for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
                for m in regex.finditer(pattern, text):
                    table[first + m.start():first + m.end()] = kind
        _CLASSES = table
    return _CLASSES


def split_points(points: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each code point, by the rules of
    ``public_tokenizers.PATTERN``.  ``fresh`` marks the first code point of each
    text; texts never share a pre-token.

    Runs of letters, of numbers and of other signs are pre-tokens; a run takes
    the one blank (U+0020) before it along.  White space before anything else is
    one pre-token without its last character, which joins the run if it is a
    blank and stands alone if not.  An apostrophe that begins a run and is not
    led by a blank makes a pre-token with s, t, re, ve, m, ll or d after it.
    """
    n = len(points)
    kind = _classes()[points]
    begins = np.ones(n, dtype=bool)
    begins[1:] = (kind[1:] != kind[:-1]) | fresh[1:]           # of runs of one class
    ends_text = np.ones(n, dtype=bool)
    ends_text[:-1] = fresh[1:]
    space = kind == _SPACE
    last_space = space.copy()                                     # last of a run that is followed by something
    last_space[:-1] &= begins[1:]
    last_space &= ~ends_text
    start = begins | last_space
    blank_before = np.zeros(n, dtype=bool)
    blank_before[1:] = (last_space & (points == 0x20))[:-1]
    start &= ~(begins & blank_before & ~space)

    # contractions
    quote = np.flatnonzero((points == 0x27) & start)
    if len(quote):
        def at(k: int) -> np.ndarray:
            """Code points k after the quotes; 0 beyond the text."""
            i = quote + k
            inside = i < n
            i = np.minimum(i, n - 1)
            for j in range(1, k + 1):
                inside &= ~fresh[np.minimum(quote + j, n - 1)]
            return np.where(inside, points[i], 0)
        a, b = at(1), at(2)
        pair = lambda s: (a == ord(s[0])) & (b == ord(s[1]))
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ~one & (pair("re") | pair("ve") | pair("ll"))
        long = np.where(one, 2, np.where(two, 3, 0))
        q, w = quote[long > 0], long[long > 0]
        start[q + 1] = False
        start[q[w == 3] + 2] = False
        after = q + w
        after = after[after < n]
        # what follows begins anew, but for a run that takes a blank along or white space in a run
        new = (kind[after] == _LETTER) & (kind[after - 1] == _LETTER) & ~fresh[after]
        start[after[new]] = True
    return start


# ----------------------------------------------------------------- merging

def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: the pair of neighbours with the lowest rank
    (the leftmost of equals) is merged until no pair has a rank.  A heap holds
    the pairs; the parts are a linked list over the bytes.  O(n log n)."""
    n = len(piece)
    end = list(range(1, n + 1))                 # part that begins at i reaches to end[i]; 0: merged away
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i:i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        r, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue                            # one of the two parts has changed since
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            r = ranks.get(piece[i:end[stop]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        p = before[i]
        if p >= 0:
            r = ranks.get(piece[p:stop])
            if r is not None:
                heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class Encoder:
    """Vocabulary, perfect hash and memory of merged pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], tables: MinimalPerfectHash | None = None) -> None:
        self.ranks = ranks
        self.hasher = SpanHasher()
        if tables is None:
            tokens = list(ranks)
            lengths = np.array([len(t) for t in tokens], dtype=np.int64)
            ends = np.cumsum(lengths)
            tables = MinimalPerfectHash(
                self.hasher(np.frombuffer(b"".join(tokens), dtype=np.uint8), ends - lengths, ends),
                lengths, np.array(list(ranks.values()), dtype=np.int64))
        self.tables = tables
        self.tokens: list[bytes] = []
        self.merged: dict[int, list[int]] = {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and each text's number of ids."""
        raw = [t.encode("utf-8", "replace") for t in texts]
        whole = b"".join(raw)
        buffer = np.frombuffer(whole, dtype=np.uint8)
        if not len(buffer):
            return np.empty(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        points = np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        lead = np.flatnonzero((buffer & 0xC0) != 0x80)            # byte of each code point
        sizes = np.array([len(b) for b in raw], dtype=np.int64)
        firsts = (np.cumsum(sizes) - sizes)[sizes > 0]
        fresh = np.zeros(len(buffer), dtype=bool)
        fresh[firsts] = True
        start = lead[split_points(points, fresh[lead])]
        end = np.append(start[1:], len(buffer))
        hashes = self.hasher(buffer, start, end)
        ids = self.tables.find(hashes, end - start)
        counts = np.ones(len(ids), dtype=np.int64)
        miss = np.flatnonzero(ids < 0)
        if len(miss):
            unique, first, which = np.unique(hashes[miss], return_index=True, return_inverse=True)
            found = []
            for h, m in zip(unique.tolist(), miss[first].tolist(), strict=True):
                got = self.merged.get(h)
                if got is None:
                    if len(self.merged) >= REMEMBERED:
                        self.merged.clear()
                    got = self.merged[h] = merge(whole[start[m]:end[m]], self.ranks)
                found.append(got)
            length = np.array([len(f) for f in found], dtype=np.int64)
            offset = np.cumsum(length) - length
            flat = np.array([i for f in found for i in f], dtype=np.int64)
            counts[miss] = length[which]
            out = np.repeat(ids, counts)
            at = (np.cumsum(counts) - counts)[miss]
            n_miss = length[which]
            within = np.arange(n_miss.sum()) - np.repeat(np.cumsum(n_miss) - n_miss, n_miss)
            out[np.repeat(at, n_miss) + within] = flat[np.repeat(offset[which], n_miss) + within]
            ids = out
        # ids of each text: those of the pre-tokens that begin in it
        upto = np.append(0, np.cumsum(counts))
        ends = np.cumsum(sizes)
        per_text = upto[np.searchsorted(start, ends)] - upto[np.searchsorted(start, ends - sizes)]
        return ids, per_text

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids, one after the other."""
        if not self.tokens:
            self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
            for token, rank in self.ranks.items():
                self.tokens[rank] = token
        return b"".join(map(self.tokens.__getitem__, ids))


class Open:
    """What is known of a text whose parts are still coming."""

    def __init__(self, text: int) -> None:
        self.text, self.n, self.ids = text, 0, []
        self.decimal, self.decoded = hashlib.sha256(), hashlib.sha256()

    def add(self, ids: np.ndarray, decimal: list[str], encoder: Encoder, keep: bool) -> None:
        own = ids.tolist()
        if own:
            self.decimal.update(("," * (self.n > 0) + ",".join(map(decimal.__getitem__, own))).encode())
            self.decoded.update(encoder.decode(own))
            self.n += len(own)
            if keep:
                self.ids.append(ids.astype(np.int32))


def parts(text: str, limit: int = CHUNK_BYTES) -> Iterator[str]:
    """The text in parts of about ``limit`` characters that begin with a blank after
    a character that is no white space: a pre-token always begins there."""
    at = 0
    while len(text) - at > limit:
        to = text.find(" ", at + limit)
        while to > 0 and text[to - 1].isspace():
            to = text.find(" ", to + 1)
        if to < 0:
            break
        yield text[at:to]
        at = to
    yield text[at:]


def chunks(texts: list[str], limit: int = CHUNK_BYTES) -> Iterator[tuple[list[int], list[str]]]:
    """Texts of about ``limit`` characters together, with their numbers; a longer one
    comes in parts, one after the other."""
    which: list[int] = []
    some: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        for part in parts(t, limit) if len(t) > limit else (t,):
            which.append(i)
            some.append(part)
            size += len(part)
            if size >= limit:
                yield which, some
                which, some, size = [], [], 0
    if some:
        yield which, some


def encode_documents(docs: DataFrame, ranks_path: str, doc_id: str = "doc_id", text: str = "text",
                     with_ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Per row: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by
    commas), decoded_sha256 (of the decoded bytes) and, if ``with_ids``, the
    ids themselves.  Null and empty texts have no tokens and the hashes of the
    empty string; a null doc_id stays null; repeated rows each give a row; other
    columns are ignored; an empty table gives an empty result.  Text is never
    split but where the pattern splits it.  ``ranks_path`` is read on the driver.
    """
    spark = docs.sparkSession
    ranks = load_ranks(ranks_path)
    shared = spark.sparkContext.broadcast((ranks, Encoder(ranks).tables))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(*shared.value)
        decimal = list(map(str, range(max(encoder.ranks.values(), default=-1) + 1)))
        for pdf in batches:
            doc_ids, rows, size, open_ = pdf["doc_id"].tolist(), [], 0, None

            def frame(rows: list) -> pd.DataFrame:
                out = pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])
                return out if with_ids else out.drop(columns="ids")

            def ended(o: Open) -> tuple:
                ids = np.concatenate(o.ids) if len(o.ids) > 1 else o.ids[0] if o.ids else np.empty(0, dtype=np.int32)
                return doc_ids[o.text], o.n, o.decimal.hexdigest(), o.decoded.hexdigest(), ids

            for which, some in chunks(pdf["text"].tolist()):
                ids, counts = encoder.encode(some)
                at = 0
                for text, n in zip(which, counts.tolist(), strict=True):
                    if open_ is None or open_.text != text:
                        if open_ is not None:
                            rows.append(ended(open_))
                            size += open_.n
                        open_ = Open(text)
                    open_.add(ids[at:at + n], decimal, encoder, with_ids)
                    at += n
                if size > 1 << 16:
                    yield frame(rows)
                    rows, size = [], 0
            if open_ is not None:
                rows.append(ended(open_))
            if rows:
                yield frame(rows)

    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * with_ids
    kind = docs.schema[doc_id].dataType
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(kind))
