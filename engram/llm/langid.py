"""Language identification by a convolutional network over bytes (operator 4).

Bytes are embedded, filters of several widths slide over a window of fixed
length, the largest answer of each filter in the window is kept, and a softmax
over these gives the language.  The network is written and trained in numpy, on
the driver, from a bounded sample of labelled texts; prediction covers every
window of every whole text, in batches, in a pandas UDF over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed_rows, unpacked_rows

#: Bytes in a window.
LENGTH = 64
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 16, 4
#: The sample that is learned from: texts of a language (up to 1000, so that Spark cuts the ranks before the
#: shuffle already), and windows of a text.
TEXTS_PER_LANGUAGE, WINDOWS_PER_TEXT = 1000, 4
EPOCHS, BATCH, STEP = 4, 128, 0.01
#: Windows that go through the network together.
WINDOWS_AT_ONCE = 512
UNDETERMINED = "und"


class ByteCNN:
    """Embedding, one layer of filters with max pooling, softmax."""

    def __init__(self, labels: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.p: dict[str, np.ndarray] = {"emb": rng.normal(0, 0.5, (256, EMBEDDING))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["out"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels)))
        self.p["bias"] = np.zeros(len(labels))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _columns(self, x: np.ndarray, w: int) -> np.ndarray:
        """(positions, windows, w * EMBEDDING) from (LENGTH, windows, EMBEDDING)."""
        n = LENGTH - w + 1
        return np.concatenate([x[j:j + n] for j in range(w)], axis=2)

    def _pooled(self, windows: np.ndarray) -> np.ndarray:
        x = self.p["emb"][windows]
        n = windows.shape[1]
        pooled = []
        for w in WIDTHS:
            y = self._columns(x, w).reshape(-1, w * EMBEDDING) @ self.p[f"w{w}"]
            pooled.append(y.reshape(-1, n * FILTERS).max(axis=0).reshape(n, FILTERS) + self.p[f"b{w}"])
        return np.maximum(np.concatenate(pooled, axis=1), 0)

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities (windows, labels) for bytes (LENGTH, windows)."""
        return self._softmax(self._pooled(windows))

    def _gradients(self, windows: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        x = self.p["emb"][windows]
        n = windows.shape[1]
        g: dict[str, np.ndarray] = {}
        cols, best, pooled = {}, {}, []
        for w in WIDTHS:
            cols[w] = self._columns(x, w)
            y = cols[w] @ self.p[f"w{w}"]
            best[w] = y.argmax(axis=0)                                   # (windows, FILTERS)
            pooled.append(np.take_along_axis(y, best[w][None], axis=0)[0] + self.p[f"b{w}"])
        raw = np.concatenate(pooled, axis=1)
        act = np.maximum(raw, 0)
        d = self._softmax(act)
        d[np.arange(n), target] -= 1
        d /= n
        g["out"], g["bias"] = act.T @ d, d.sum(axis=0)
        d = (d @ self.p["out"].T) * (raw > 0)
        emb = np.zeros((256, EMBEDDING), dtype=np.float32)
        for i, w in enumerate(WIDTHS):
            dw = d[:, i * FILTERS:(i + 1) * FILTERS]                     # (windows, FILTERS)
            patch = cols[w][best[w], np.arange(n)[:, None]]              # (windows, FILTERS, w * EMBEDDING)
            g[f"w{w}"] = np.einsum("nf,nfk->kf", dw, patch)
            g[f"b{w}"] = dw.sum(axis=0)
            back = dw[:, :, None] * self.p[f"w{w}"].T[None]              # (windows, FILTERS, w * EMBEDDING)
            for j in range(w):
                byte = windows[best[w] + j, np.arange(n)[:, None]].ravel()
                for e in range(EMBEDDING):
                    emb[:, e] += np.bincount(byte, back[:, :, j * EMBEDDING + e].ravel(), 256)
        g["emb"] = emb
        return g

    def fit(self, windows: np.ndarray, target: np.ndarray, seed: int = 11) -> ByteCNN:
        """Adam over EPOCHS passes in a seeded order; the same sample gives the
        same network."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(windows.shape[1])
            step = STEP * (1 - epoch / EPOCHS)
            for a in range(0, len(order), BATCH):
                at = order[a:a + BATCH]
                t += 1
                for k, g in self._gradients(windows[:, at], target[at]).items():
                    m[k] += 0.1 * (g - m[k])
                    v2[k] += 0.001 * (g * g - v2[k])
                    self.p[k] -= step * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v2[k] / (1 - 0.999 ** t)) + 1e-8)
        return self


def windows_of(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts one after the other, (LENGTH, windows), with
    each one's text and number of real bytes.  The last window of a text is
    filled up with zeros."""
    sizes = np.array([len(b) for b in raw], dtype=np.int64)
    n = -(-sizes // LENGTH)
    padded = np.zeros(int(n.sum()) * LENGTH, dtype=np.uint8)
    text = np.repeat(np.arange(len(raw)), n)
    at = (np.cumsum(n) - n) * LENGTH
    for i, b in enumerate(raw):
        if b:
            padded[at[i]:at[i] + len(b)] = np.frombuffer(b, dtype=np.uint8)
    within = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    real = np.minimum(LENGTH, sizes[text] - within * LENGTH)
    return np.ascontiguousarray(padded.reshape(-1, LENGTH).T), text, real


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: the CRC-32 of its id as text
    is divisible by 5.  A null id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> ByteCNN | None:
    """Learns from text and lang of the documents that are not held out.

    The sample: of each language the TEXTS_PER_LANGUAGE documents with the
    lowest hash of id and text, rows that repeat both taken as one, of each text
    up to WINDOWS_PER_TEXT windows, evenly spread over it.  None if there is no
    labelled text."""
    d = docs.where(~held_out(F.col(doc_id)) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    size = F.length(F.col(text))
    starts = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS_PER_TEXT - 1)),
                         lambda i: F.floor(i * F.greatest(size - LENGTH, F.lit(0)) / (WINDOWS_PER_TEXT - 1)))
    cut = F.transform(F.array_distinct(starts), lambda s: F.substring(
        F.col(text), (s + 1).cast("int"), F.lit(LENGTH)))
    d = d.select(F.col(lang).alias("lang"), F.xxhash64(doc_id, text).alias("h"), cut.alias("windows"))
    # only distinct hashes of id and text are ranked; a row per language then says how far the sample goes
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    last = d.select("lang", "h").distinct().withColumn("r", rank).where(F.col("r") <= TEXTS_PER_LANGUAGE).groupBy(
        "lang").agg(F.max("h").alias("last"))
    last = {r["lang"]: r["last"] for r in last.collect()}
    if not last:
        return None
    upto = F.create_map(*[F.lit(x) for pair in sorted(last.items()) for x in pair])
    # repeated rows are one row of the sample
    d = d.where(F.col("h") <= upto[F.col("lang")]).dropDuplicates(["lang", "h"])
    sample = sorted(d.select("lang", "h", "windows").collect())
    labels = sorted({r["lang"] for r in sample})
    raw = [w.encode("utf-8", "replace")[:LENGTH] for r in sample for w in r["windows"]]
    target = np.array([labels.index(r["lang"]) for r in sample for _ in r["windows"]])
    windows, text_no, _ = windows_of(raw)
    return ByteCNN(labels).fit(windows, target[text_no])


def language_of(docs: DataFrame, model: ByteCNN | None, text: str = "text") -> Column:
    """The language of a text as a struct (lang_pred, score): for rows of
    ``docs``, of which only the text goes to Python."""
    if model is None:
        return F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net = shared.value
        for texts in batches:
            raw = [b"" if t is None else t.encode("utf-8", "replace") for t in texts.tolist()]
            total = np.zeros((len(raw), len(net.labels)))
            for a, b in _groups(raw):
                windows, text_no, real = windows_of(raw[a:b])
                for i in range(0, len(text_no), WINDOWS_AT_ONCE):
                    s = slice(i, i + WINDOWS_AT_ONCE)
                    p = net.predict(windows[:, s]) * real[s, None]
                    for c in range(len(net.labels)):
                        total[a:b, c] += np.bincount(text_no[s], p[:, c], b - a)
            weight = total.sum(axis=1)
            best = total.argmax(axis=1)
            yield pd.DataFrame({
                "lang_pred": [net.labels[k] if w > 0 else UNDETERMINED for k, w in zip(best, weight, strict=True)],
                "score": np.where(weight > 0, total[np.arange(len(best)), best] / np.maximum(weight, 1e-9), 0.0)})

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return predicted(F.when(lettered, F.col(text)))


def predict(docs: DataFrame, model: ByteCNN | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred and score.

    Probabilities of a text are the mean over its windows, by their bytes; the
    prediction is the likeliest language (ties: the first by name) and score
    its probability.  Null and empty texts and texts without a letter are
    ``und`` with score 0; so is everything if there is no model.  Repeated rows
    are predicted alike; other columns are never looked at; an empty table gives
    an empty result."""
    found = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"),
                        language_of(docs, model, text).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def in_known_language(docs: DataFrame, least: float, doc_id: str = "doc_id", text: str = "text",
                      lang: str = "lang") -> DataFrame:
    """The rows whose text is in one of the languages learned from them: not
    those without letters, nor those whose best language scores below ``least``.
    All columns are kept."""
    model = train(docs, doc_id, text, lang)
    found = packed_rows(docs, found=language_of(docs, model, text))
    found = found.where((F.col("found.lang_pred") != UNDETERMINED) & (F.col("found.score") >= least))
    return unpacked_rows(found, docs.columns)


def _groups(raw: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together."""
    first, size = 0, 0
    for i, b in enumerate(raw):
        if size and size + len(b) > limit:
            yield first, i
            first, size = i, 0
        size += len(b)
    if first < len(raw):
        yield first, len(raw)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Trains on the documents that are not held out and predicts all."""
    return predict(docs, train(docs, doc_id, text, lang), doc_id, text)
