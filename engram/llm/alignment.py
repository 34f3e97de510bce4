"""Alignment of two tokenizers by pointer jumping (operator 11).

Both tokenizers encode the same bytes, so their tokens are two ways to cut one
line.  Every token points to the farthest-right token of the other kind that
overlaps it, or to itself if both kinds end where it does; squaring the pointers
(successor of the successor) converges to the last token of each component, whose
name is the label of the group.

Neither tokenizer can join what stands before and behind a cut between a
character that is no white space and a blank, so texts are lines of units (a
blank and what follows), groups never leave a unit, and a task encodes and
aligns each distinct unit once: all units that are new to it, with their hundreds of thousands
of tokens, lie on one line and are aligned by a few vectorised steps.

A link is a pair of tokens that overlap.  How many documents hold a pair of ids
linked is counted over the whole corpus:

1. A task writes, per batch of texts, the distinct pairs of the batch with the
   number of its texts that hold them, the pairs of its units and the units of its texts.
2. The pairs of the batches are summed to the corpus counts, and compared with
   the highest of their A id.
3. Each batch asks for the counts of its distinct pairs, one row each; sums over
   the links of its units, then over the units of its texts, are the results.

So a pair that is in every text is one row per batch, not one per text, and what
a batch gathers is bounded by its size.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, islice
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Characters in a batch of texts, and distinct units that a task remembers from batch to batch.
BATCH, REMEMBERED = 1 << 21, 3 << 16
#: Units that are encoded and aligned together.
LINE = 1 << 12
#: Links whose (text, pair) are sorted together.
LINKS = 1 << 19
#: Batches in a file, each a row of some MB.
FILE_BATCHES = 4
_MARK = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")


# --------------------------------------------------------------- tokenizers

def byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable characters
    of Latin-1 stand for themselves, the other bytes for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """Tokenizer A, from a ``tokenizers`` file: encodes space + text."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")     # one core per task
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        alphabet = byte_alphabet()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in alphabet for c in token)
            self.bytes[i] = bytes(alphabet[c] for c in token) if known else token.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of space + text."""
        return [e.ids for e in self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """Tokenizer B, from a ``sentencepiece`` model, which adds the space itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            byte = _BYTE.match(piece) if self.model.is_byte(i) else None
            self.bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace(_MARK, " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts, the space added by the model."""
        return self.model.encode(texts, num_threads=1)


_SPLIT = re.compile(r" (?:[^ ]|(?<=\s) )*")
_WIDE = re.compile(r"\s ")


def units(text: str) -> list[str]:
    """Space + text, cut before every blank that follows a character that is no
    white space, each unit without the blank that it begins with.  A lone
    blank at the end stays with the unit before it."""
    if _WIDE.search(text) or text[:1] == " ":
        out = [u[1:] for u in _SPLIT.findall(" " + text)]
    else:
        out = text.split(" ")
    if len(out) > 1 and not out[-1]:
        out.pop()
        out[-1] += " "
    return out


class Table:
    """The bytes and the decimal numbers of a vocabulary as arrays."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        width = len(str(len(tokens)))
        digits = np.frombuffer(b"".join(str(i).encode().ljust(width, b"\0") for i in range(len(tokens))), dtype=np.uint8)
        self.digits = digits.reshape(len(tokens), width)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens one after the other."""
        n = self.length[ids]
        shift = np.repeat(self.at[ids] - (np.cumsum(n) - n), n)
        return self.flat[shift + np.arange(len(shift))]


# ---------------------------------------------------------------- alignment

def components(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and B token, from 0, given where the tokens end.

    Tokens of one kind follow each other without gaps, and both kinds end
    together at last.  A token points to the farthest-right token that overlaps
    it, the one of the other kind that holds its last byte, unless that one ends
    no later: an A token then points to itself, a B token to the A token that ends
    with it.  Doubling the pointers until they rest leads to the last A token."""
    n = len(end_a)
    holder_b = np.searchsorted(end_b, end_a)                # the B token of A's last byte
    holder_a = np.searchsorted(end_a, end_b)
    alone = np.arange(n)
    succ = np.concatenate([np.where(end_b[holder_b] > end_a, n + holder_b, alone), holder_a])
    while True:
        farther = succ[succ]
        if (farther == succ).all():
            break
        succ = farther
    last = np.flatnonzero(succ[:n] == alone)                # terminal tokens, in order
    label = np.searchsorted(last, succ)
    return label[:n], label[n:]


def overlaps(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the A and B token of every link: two tokens that overlap share
    exactly one stretch between neighbouring cuts, so cuts and links are as many."""
    cuts = np.union1d(end_a, end_b)
    return np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)


def written_groups(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, digits_a: np.ndarray,
                   digits_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``;a1,a2|b1;a3|b2`` of all tokens as bytes (a ``;`` before every group), and
    where the text of each group ends."""
    n_groups = int(group_a[-1]) + 1
    in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    place_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]
    place_b = np.arange(len(b)) + np.cumsum(in_a)[group_b]
    width = max(digits_a.shape[1], digits_b.shape[1])
    text = np.zeros((len(a) + len(b), 1 + width), dtype=np.uint8)
    text[place_a, 1:1 + digits_a.shape[1]] = digits_a[a]
    text[place_b, 1:1 + digits_b.shape[1]] = digits_b[b]
    new_a, new_b = np.ones(len(a), dtype=bool), np.ones(len(b), dtype=bool)
    new_a[1:], new_b[1:] = group_a[1:] != group_a[:-1], group_b[1:] != group_b[:-1]
    text[place_a, 0] = np.where(new_a, ord(";"), ord(","))
    text[place_b, 0] = np.where(new_b, ord("|"), ord(","))
    there = text > 0
    last = np.append(place_a[new_a][1:], len(text)) - 1            # of each group
    return text[there], np.cumsum(there.sum(axis=1))[last]


class _Numbers(dict):
    """Numbers things in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class _Lists:
    """Growing lists of numbers, one after the other."""

    def __init__(self) -> None:
        self.size, self.flat = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def add(self, size: np.ndarray, flat: np.ndarray) -> None:
        self.size, self.flat = np.append(self.size, size), np.append(self.flat, flat)

    def of(self, which: np.ndarray) -> np.ndarray:
        """The lists ``which``, one after the other."""
        n = self.size[which]
        shift = np.repeat((np.cumsum(self.size) - self.size)[which] - (np.cumsum(n) - n), n)
        return self.flat[shift + np.arange(len(shift))]


class Aligner:
    """Both tokenizers, and the units that are known already."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.table_a, self.table_b = Table(self.a.bytes), Table(self.b.bytes)
        self.n_b = len(self.b.bytes)
        self.forget()

    def forget(self) -> None:
        self.number = _Numbers()
        self.groups: list[bytes] = []                   # a1,a2|b1;a3|b2 of each unit
        self.figures = np.empty((0, 4), dtype=np.int64)  # n_a, n_b, n_groups, n_links
        self.failed = np.empty(0, dtype=bool)
        self.pairs = _Lists()                           # of the links of each unit

    def learn(self) -> None:
        """Encodes and aligns the numbered units that are not known yet."""
        new = list(islice(self.number, len(self.groups), None))
        done = [self._line(new[i:i + LINE]) for i in range(0, len(new), LINE)]
        if done:
            figures, failed, sizes, flat = (np.concatenate(x) for x in zip(*done, strict=True))
            self.figures, self.failed = np.vstack([self.figures, figures]), np.append(self.failed, failed)
            self.pairs.add(sizes, flat)

    def _line(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Figures, failures, sizes and pairs of the links of some units."""
        raw = [(" " + u).encode("utf-8", "replace") for u in new]
        n, size = len(new), np.array([len(r) for r in raw], dtype=np.int64)
        whole, ends = np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum(size)
        bad = np.zeros(n, dtype=bool)
        sides = []
        for encoder, tokens in ((self.a, self.table_a), (self.b, self.table_b)):
            lists = encoder.encode(new)
            unit = np.repeat(np.arange(n), np.fromiter(map(len, lists), dtype=np.int64, count=n))
            ids = np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=len(unit))
            del lists
            # the bytes of units of the right length are compared with theirs, all at once
            bad |= np.bincount(unit, tokens.length[ids], n).astype(np.int64) != size
            on = ~bad[unit]
            own = np.repeat(~bad, size)
            differ = np.flatnonzero(own)[tokens.joined(ids[on]) != whole[own]]
            bad[np.searchsorted(ends, differ, side="right")] = True
            sides.append((ids, unit))
        figures, sizes, texts = np.zeros((n, 4), dtype=np.int64), np.zeros(n, dtype=np.int64), [b""] * n
        flat = np.empty(0, dtype=np.int64)
        if not bad.all():
            (a, unit_a), (b, unit_b) = ((ids[~bad[unit]], unit[~bad[unit]]) for ids, unit in sides)
            end_a, end_b = np.cumsum(self.table_a.length[a]), np.cumsum(self.table_b.length[b])
            group_a, group_b = components(end_a, end_b)
            link_a, link_b = overlaps(end_a, end_b)
            of_group = unit_a[np.append(np.flatnonzero(group_a[1:] != group_a[:-1]), len(a) - 1)]
            sizes = np.bincount(unit_a[link_a], minlength=n)
            figures = np.column_stack([np.bincount(x, minlength=n) for x in (unit_a, unit_b, of_group)] + [sizes])
            flat = a[link_a] * self.n_b + b[link_b]
            line, ends = written_groups(a, b, group_a, group_b, self.table_a.digits, self.table_b.digits)
            line, at = line.tobytes(), 0
            last = np.append(of_group[1:] != of_group[:-1], True)
            for k, to in zip(of_group[last].tolist(), ends[last].tolist(), strict=True):
                texts[k] = line[at + 1:to]             # without the ; before the first group
                at = to
        self.groups += texts
        return figures, bad, sizes, flat

    def batch(self, texts: list[str]) -> Batch:
        """Aligns the texts of a batch."""
        if len(self.number) > REMEMBERED:
            self.forget()
        known = self.number.__getitem__
        rows = [np.fromiter(map(known, units(t)), dtype=np.int64) if t else np.empty(0, dtype=np.int64) for t in texts]
        self.learn()
        n, size = len(texts), np.array([len(r) for r in rows], dtype=np.int64)
        unit = np.concatenate(rows) if rows else np.empty(0, dtype=np.int64)
        text = np.repeat(np.arange(n), size)
        failed = np.bincount(text[self.failed[unit]], minlength=n) > 0
        sha = ["" if f or not len(r) else hashlib.sha256(b";".join(map(self.groups.__getitem__, r.tolist()))).hexdigest()
               for r, f in zip(rows, failed.tolist(), strict=True)]
        here = ~failed[text]
        text, unit = text[here], unit[here]
        figures = [np.bincount(text, self.figures[unit, k], n).astype(np.int64) for k in range(4)]
        # each text's distinct units, and how often it has them; the units numbered anew
        used, unit = np.unique(unit, return_inverse=True)
        key, times = np.unique(text * max(1, len(used)) + unit, return_counts=True)
        text, unit = key // max(1, len(used)), key % max(1, len(used))
        pairs, which = np.unique(self.pairs.of(used), return_inverse=True)
        own = _Lists()
        own.add(self.pairs.size[used], which)
        # texts that hold a pair: some texts at a time, so that what is sorted together is bounded
        docs = np.zeros(len(pairs), dtype=np.int64)
        links = np.cumsum(own.size[unit])
        at = 0
        while at < len(unit):
            to = int(np.searchsorted(links, (links[at - 1] if at else 0) + LINKS, side="right"))
            to = int(np.searchsorted(text, text[min(max(to, at + 1), len(unit)) - 1], side="right"))   # whole texts
            part = slice(at, to)
            each = np.repeat(text[part], own.size[unit[part]]) * len(pairs) + own.of(unit[part])
            docs += np.bincount(np.unique(each) % len(pairs), minlength=len(pairs))
            at = to
        return Batch(figures, sha, pairs, docs, own.size, own.flat, np.bincount(text, minlength=n), unit, times)


class Batch(NamedTuple):
    """What a batch of texts has: per text the figures (n_a, n_b, n_groups,
    n_links) and the hash of its groups; the distinct pairs of linked ids and how many texts
    hold each; per unit how many links it has and the places of their pairs; per text
    how many distinct units it has, and of these the number and the times."""
    figures: list[np.ndarray]
    sha: list[str]
    pairs: np.ndarray
    docs: np.ndarray
    unit_size: np.ndarray
    unit_pairs: np.ndarray
    text_size: np.ndarray
    text_units: np.ndarray
    times: np.ndarray


# -------------------------------------------------------------------- Spark

_PACKED = ("unit_size", "unit_pairs", "text_size", "text_units", "times")


def _aligned(docs: DataFrame, path_a: str, path_b: str, size: int) -> DataFrame:
    """One row per batch, with the fields of :class:`Batch` (the last ones as bytes)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner(path_a, path_b)

        def done(ids: list, texts: list[str]) -> pd.DataFrame:
            b = aligner.batch(texts)
            out = {"ids": [ids], **{c: [x] for c, x in zip(("n_a", "n_b", "n_groups", "n_links"), b.figures, strict=True)},
                   "sha": [b.sha], "pairs": [b.pairs], "docs": [b.docs]}
            return pd.DataFrame(out | {c: [getattr(b, c).astype(np.uint32).tobytes()] for c in _PACKED})

        ids, texts, chars = [], [], 0
        for pdf in batches:
            for i, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids.append(i)
                texts.append(t)
                chars += len(t) + 16
                if chars >= size:
                    yield done(ids, texts)
                    ids, texts, chars = [], [], 0
        if ids:
            yield done(ids, texts)

    schema = ("ids array<string>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
              "sha array<string>, pairs array<long>, docs array<long>, " + ", ".join(f"{c} binary" for c in _PACKED))
    return docs.mapInPandas(run, schema).withColumn("batch", F.monotonically_increasing_id())


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text",
          batch: int = BATCH) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is a byte-level ``tokenizers`` file, which encodes space + text, B a
    ``sentencepiece`` model, which adds the space; both must be readable by every executor.
    ``groups_sha256`` hashes the groups ``a1,a2|b1;a3|b2,b3`` of decimal ids.  A
    pair's count is the number of rows that hold it linked; ``n_best`` counts the
    links whose count is the highest of their A id, ``count_sum`` sums over all links.

    Texts that are null or empty, and those that a tokenizer does not give back byte by byte,
    have no tokens: zeros and an empty ``groups_sha256``.  Repeated rows count as
    rows of their own; a null doc_id stays null; other columns are ignored; an
    empty table gives an empty result."""
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    aligned = written(_aligned(rows, path_a, path_b, batch), "aligned", texts=True, file_rows=FILE_BATCHES)
    n_b = len(Pieces(path_b).bytes)
    each = aligned.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select("p.pairs", "p.docs")
    counts = written(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("n")), "pair-counts")
    # an A id has no more pairs than B has ids
    highest = F.max("n").over(Window.partitionBy(F.floor(F.col("pair") / n_b)))
    counts = counts.select("pair", "n", (F.col("n") == highest).alias("best"))
    asked = aligned.select("batch", F.explode("pairs").alias("pair")).join(counts, "pair").select(
        F.col("batch").alias("asker"), "pair", "n", "best")

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({c: [] for c in columns})
        b = left.iloc[0]
        unit_size, unit_pairs, text_size, text_units, times = (
            np.frombuffer(b[c], dtype=np.uint32).astype(np.int64) for c in _PACKED)
        right = right.sort_values("pair")
        unit = np.repeat(np.arange(len(unit_size)), unit_size)
        row = np.repeat(np.arange(len(text_size)), text_size)
        out = {"doc_id": b["ids"], **{c: b[c] for c in ("n_a", "n_b", "n_groups", "n_links")}}
        for c, value in (("n_best", right["best"]), ("count_sum", right["n"])):
            of_pair = value.to_numpy(dtype=np.int64)
            upto = np.append(0, np.cumsum(of_pair[unit_pairs]))
            ends = np.cumsum(unit_size)
            of_unit = upto[ends] - upto[ends - unit_size]
            upto = np.append(0, np.cumsum(of_unit[text_units] * times))
            ends = np.cumsum(text_size)
            out[c] = upto[ends] - upto[ends - text_size]
        return pd.DataFrame(out | {"groups_sha256": b["sha"]})

    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    schema = "doc_id string, " + ", ".join(f"{c} long" for c in columns[1:-1]) + ", groups_sha256 string"
    out = aligned.drop("pairs", "docs").groupBy("batch").cogroup(asked.groupBy("asker")).applyInPandas(answer, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))
