"""Toxic passages by maximum-scoring segments (operator 12).

1. Log-odds.  For every word, and every run of four letters of a word, the
   labelled documents that have it are counted (equal texts once).  Its weight is
   the logarithm of its odds in toxic documents against others, with a Dirichlet
   prior in proportion to how common it is in all of them, so rare features stay
   near 0.  Features whose weight stands out of its error are the model; a word
   scores by the one of its features that stands out most, any other word by the
   small negative weight of a word without any.
2. Segments.  One linear scan over the scores of a text's words (Ruzzo and Tompa)
   finds all its disjoint maximal-scoring segments.
3. Extreme values.  The best segment of an n-word text without toxic passages
   scores above x with probability 1 - exp(-K n exp(-lambda x)).  lambda is the
   root of E[exp(lambda score)] = 1 over the words of other documents, and K is
   fitted to their best segments.  A passage is significant where that chance
   is small; the surpluses lambda x - log(K n) of all segments of a text add up, and a
   logistic curve learned from the labels makes a probability of the sum.

The sample that is learned from is bounded: SAMPLE different texts of either
label.  Weights for the calibration come from the other half of the sample, so
that no document is judged by its own words.  Scoring covers all words of all
texts, row by row, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import _U, SpanHasher, _mix
from .common import written
from .jaccard import shingle_sets
from .langid import held_out

#: Letters of a part of a word.
PART = 4
#: Documents (of equal share) that the prior counts as.
PRIOR = 20.0
#: A feature stands out if its weight is so many standard errors from 0 and so many documents have it.
STANDS_OUT, LEAST_DOCS = 3.5, 4
#: Features that the model keeps at most, those that stand out most.
FEATURES = 1 << 16
#: Texts of either label that are learned from, about.
SAMPLE = 20000
#: Score of a word without a feature that stands out: a passage ends where many of these follow each other.
REST = -0.3
#: Texts of the sample that agree in one of so many smallest hashes of SHINGLE words are copies; one of them counts.
HASHES, SHINGLE = 4, 5
#: The share of other documents whose best segment sets K.
TAIL = 0.99
#: A passage is significant if its chance in a text without toxic passages is below this.
CHANCE = 0.01
#: Features that a task counts before it reports them, and words whose scores it remembers.
COUNTED, REMEMBERED = 1 << 20, 1 << 18
#: Characters of a text that are cut into words together.
PIECE = 1 << 20

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str, piece: int = PIECE) -> Iterator[list[str]]:
    """The words (runs of letters, in lower case) of a text, in lists of those of
    about ``piece`` characters; words are never cut."""
    at, n = 0, len(text)
    while at < n:
        to = min(n, at + piece)
        while to < n and text[to].isalpha() and text[to - 1].isalpha():
            to += 1
        yield _WORD.findall(text[at:to].lower())
        at = to


def features(word: str) -> list[str]:
    """The word, marked as one, and the runs of PART letters in it."""
    return ["=" + word, *{word[i:i + PART] for i in range(len(word) - PART + 1)}]


# ----------------------------------------------------------------- segments

def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, score), in order.

    Ruzzo and Tompa: segments are kept on a list with the sums before and behind
    them; a new one is joined to the nearest earlier one that begins lower, if
    that one ends lower than it does.  Steps between positive scores only add, so
    the scan runs over these alone.  Linear in the number of words."""
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    sums = np.append(0.0, np.cumsum(scores))
    first: list[int] = []
    end: list[int] = []
    left: list[float] = []
    right: list[float] = []
    lower: list[int] = []                           # the nearest earlier one that begins lower
    for i, a, b in zip(at.tolist(), sums[at].tolist(), sums[at + 1].tolist(), strict=True):
        start = i
        while True:
            j = len(first) - 1
            while j >= 0 and left[j] >= a:
                j = lower[j]
            if j < 0 or right[j] >= b:
                break
            start, a = first[j], left[j]
            del first[j:], end[j:], left[j:], right[j:], lower[j:]
        first.append(start)
        end.append(i + 1)
        left.append(a)
        right.append(b)
        lower.append(j)
    return [(f, e, r - x) for f, e, x, r in zip(first, end, left, right, strict=True)]


def karlin_lambda(score: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(lambda * score)) = 1: it exists where
    the mean is negative and some score positive; else 1."""
    if not len(score) or (share * score).sum() >= 0 or score.max() <= 0:
        return 1.0
    excess = lambda x: float((share * np.exp(np.minimum(x * score, 700.0))).sum()) - 1.0
    low, high = 0.0, 1.0
    while excess(high) < 0 and high < 64:
        low, high = high, 2 * high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


# -------------------------------------------------------------------- model

class Weights:
    """Weights of the features that stand out, with the number of standard errors."""

    def __init__(self, known: dict[str, tuple[float, float]]) -> None:
        self.known = known
        self.seen: dict[str, float] = {}

    def of(self, word: str) -> float:
        """The weight of the feature of a word that stands out most."""
        known = self.known
        own = known.get("=" + word)
        best, z = own if own else (REST, 0.0)
        for i in range(len(word) - PART + 1):
            f = known.get(word[i:i + PART])
            if f is not None and f[1] > z:
                best, z = f
        return best

    def scores(self, text: str) -> np.ndarray:
        """The scores of the words of a text.  A word right after itself says nothing new."""
        seen, parts = self.seen, []
        for some in words(text):
            if len(seen) > REMEMBERED:
                seen.clear()
            for w in set(some):
                if w not in seen:
                    seen[w] = self.of(w)
            own = np.fromiter(map(seen.__getitem__, some), dtype=np.float64, count=len(some))
            again = [i for i in range(1, len(some)) if some[i] == some[i - 1]] if own.max(initial=0.0) > 0 else []
            own[again] = np.minimum(own[again], REST)
            parts.append(own)
        return np.concatenate(parts) if parts else np.empty(0)


def log_odds(t: Column, o: Column, n_t: int, n_o: int) -> tuple[Column, Column]:
    """Log-odds ratios of features had by t of n_t and o of n_o documents, and in
    units of their standard error, with PRIOR more documents on either side that
    have them as often as all documents do."""
    prior = PRIOR * (t + o) / max(1, n_t + n_o)
    cells = [F.greatest(c, F.lit(1e-6)) for c in (t + prior, n_t - t + PRIOR - prior, o + prior, n_o - o + PRIOR - prior)]
    a, b, c, d = cells
    weight = F.ln(a) - F.ln(b) - F.ln(c) + F.ln(d)
    return weight, weight / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)


class Calibration:
    """lambda and K of the best segments, and the logistic curve."""

    def __init__(self, lam: float, k: float, slope: float, middle: float) -> None:
        self.lam, self.k, self.slope, self.middle = lam, k, slope, middle

    def surplus(self, score: float, n: int) -> float:
        """lambda x - log(K n): the logarithm of 1 / the expected number of such
        segments, which is one at least."""
        return self.lam * score - max(0.0, math.log(self.k * max(1, n)))

    def chance(self, score: float, n: int) -> float:
        """The chance of such a segment in a text of n words without toxic passages."""
        return -math.expm1(-math.exp(min(50.0, -self.surplus(score, n))))

    def total(self, segments: Iterable[tuple[int, int, float]], n: int) -> float:
        """The sum of the surpluses of all segments that have one."""
        return sum(x for _, _, s in segments if (x := self.surplus(s, n)) > 0)

    def probability(self, total: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.slope * (total - self.middle)))))


class Model:
    """Weights and calibration."""

    def __init__(self, weights: Weights, calibration: Calibration) -> None:
        self.weights, self.calibration = weights, calibration

    def passages(self, text: str) -> tuple[list[tuple[int, int, float, float]], float]:
        """Significant passages (first word, end, score, chance) of a text and the
        text's probability."""
        scores = self.weights.scores(text)
        n, c = len(scores), self.calibration
        segments = maximal_segments(scores)
        found = [(a, b, s, p) for a, b, s in segments if (p := c.chance(s, n)) < CHANCE]
        return found, c.probability(c.total(segments, n))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and middle of a logistic curve by Newton steps.  A surplus is a
    logarithm of odds already, so the slope is pulled towards 1, and the
    intercept weakly towards -1, so that separated labels have a curve too."""
    X = np.column_stack([x, np.ones(len(x))])
    pull, home = np.array([100.0, 0.5]), np.array([1.0, -1.0])

    def loss(w: np.ndarray) -> float:
        z = X @ w
        return float((np.logaddexp(0, z) - y * z).sum() + (pull * (w - home) ** 2).sum() / 2)

    w = home.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -60, 60)))
        g = X.T @ (p - y) + pull * (w - home)
        step = np.linalg.solve(X.T @ (X * (p * (1 - p))[:, None]) + np.diag(pull), g)
        now = loss(w)
        while np.abs(step).max() > 1e-9 and loss(w - step) > now:
            step /= 2
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    slope = max(w[0], 0.05)
    return float(slope), float(-w[1] / slope)


# -------------------------------------------------------------------- Spark

def _sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """(text, toxic, half) of about SAMPLE texts of either label at most, of the
    documents that are not held out; of copies and near copies one, toxic if any
    equal one is.  Only hashes of the whole table are joined and counted; a
    broadcast of so many then picks the texts."""
    own = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("toxic")).where("toxic in (0, 1)")
    d = docs.where(~held_out(F.col(doc_id)) & F.col(text).isNotNull()).select(
        F.col(doc_id).alias("id"), F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    keys = written(d.select("id", "key").join(own, "id").groupBy("key").agg(
        F.max("toxic").alias("toxic"), F.min("id").alias("id")), "labelled")
    sizes = {r["toxic"]: r["n"] for r in keys.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    dice = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 20))
    chosen = F.lit(False)
    for toxic, n in sizes.items():
        chosen = chosen | ((F.col("toxic") == toxic) & (dice < min(1 << 20, (SAMPLE << 20) // n)))
    picked = F.broadcast(keys.where(chosen).select("id", "key", "toxic"))
    texts = d.join(picked, ["id", "key"]).dropDuplicates(["id", "key"]).select("key", "text", "toxic")
    texts = written(texts, "sample")

    def smallest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = SpanHasher()
        for pdf in batches:
            keys = []
            for s in shingle_sets(pdf["text"].tolist(), SHINGLE, hasher):
                keys.append([int(_mix(s ^ _U(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)).min().view(np.int64))
                             for k in range(HASHES)] if len(s) else [])
            yield pd.DataFrame({"key": pdf["key"], "hashes": keys})

    # a text stays that has the smallest key of all that share one of its hashes
    hashes = written(texts.select("key", "text").mapInPandas(smallest, "key long, hashes array<long>"), "hashes")
    each = hashes.select("key", F.posexplode_outer("hashes").alias("k", "hash"))
    copies = each.where("hash IS NOT NULL").groupBy("k", "hash").agg(F.min("key").alias("least"))
    copies = each.join(copies, ["k", "hash"]).where("least < key").select("key").distinct()
    return written(texts.join(copies, "key", "left_anti").select(
        "text", "toxic", F.pmod("key", F.lit(2)).cast("int").alias("half")), "learned")


def _counts(sample: DataFrame) -> DataFrame:
    """(feature, t0, t1, o0, o1): texts with the feature, toxic or other, of either
    half.  A task counts its own texts first."""
    names = ("t0", "t1", "o0", "o1")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counted = [Counter() for _ in names]
        parts: dict[str, list[str]] = {}

        def report() -> pd.DataFrame:
            out = pd.DataFrame({"feature": list(set().union(*counted))})
            for name, c in zip(names, counted, strict=True):
                out[name] = [c[f] for f in out["feature"]]
                c.clear()
            return out

        for pdf in batches:
            for text, toxic, half in zip(pdf["text"], pdf["toxic"], pdf["half"], strict=True):
                distinct = set()
                for some in words(text):
                    distinct.update(some)
                if len(parts) > REMEMBERED:
                    parts.clear()
                own: set[str] = set()
                for w in distinct:
                    f = parts.get(w)
                    if f is None:
                        f = parts[w] = features(w)
                    own.update(f)
                counted[2 * (1 - toxic) + half].update(own)
                if sum(map(len, counted)) > COUNTED:
                    yield report()
        if any(counted):
            yield report()

    return sample.mapInPandas(run, "feature string, t0 long, t1 long, o0 long, o1 long").groupBy("feature").agg(
        *[F.sum(c).alias(c) for c in names])


def _weights(sample: DataFrame) -> list[Weights]:
    """Weights from all of the sample, from its half 0 and from its half 1."""
    n = {(r["toxic"], r["half"]): r["n"] for r in sample.groupBy("toxic", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    both = lambda side: [F.col(f"{side}0") + F.col(f"{side}1"), F.col(f"{side}0"), F.col(f"{side}1")]
    size = lambda toxic: [n.get((toxic, 0), 0) + n.get((toxic, 1), 0), n.get((toxic, 0), 0), n.get((toxic, 1), 0)]
    out, best = [], F.lit(0.0)
    for k, (t, o, n_t, n_o) in enumerate(zip(both("t"), both("o"), size(1), size(0), strict=True)):
        weight, z = log_odds(t, o, n_t, n_o)
        z = F.when(t + o >= LEAST_DOCS, F.abs(z)).otherwise(0.0)
        best = F.greatest(best, z)
        out += [weight.alias(f"w{k}"), z.alias(f"z{k}")]
    known = _counts(sample).select("feature", *out, best.alias("best")).where(F.col("best") >= STANDS_OUT)
    known = known.orderBy(F.desc("best"), "feature").limit(FEATURES).toPandas()
    result = []
    for k in range(3):
        own = known[known[f"z{k}"] >= STANDS_OUT]
        result.append(Weights(dict(zip(own["feature"], zip(own[f"w{k}"].tolist(), own[f"z{k}"].tolist(), strict=True), strict=True))))
    return result


def _calibrated(sample: DataFrame, halves: list[Weights]) -> Calibration:
    """lambda, K and the curve, from texts that are judged by the other half."""
    shared = sample.sparkSession.sparkContext.broadcast(halves)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, toxic, half in zip(pdf["text"], pdf["toxic"], pdf["half"], strict=True):
                scores = shared.value[1 - half].scores(text)
                bins, count = np.unique(np.round(scores * 20), return_counts=True)
                rows.append((toxic, len(scores), [s for _, _, s in maximal_segments(scores)], bins / 20, count))
            yield pd.DataFrame(rows, columns=["toxic", "n", "segments", "bins", "counts"])

    seen = written(sample.mapInPandas(
        run, "toxic int, n long, segments array<double>, bins array<double>, counts array<long>"), "segments")
    other = seen.where("toxic = 0 AND n > 0")
    bins = other.select(F.explode(F.arrays_zip("bins", "counts")).alias("b")).groupBy("b.bins").agg(
        F.sum("b.counts").alias("n")).toPandas()
    score, n = bins["bins"].to_numpy(), bins["n"].to_numpy(dtype=float)
    lam = karlin_lambda(score, n / max(1.0, n.sum()))
    best = F.coalesce(F.array_max("segments"), F.lit(0.0)) * lam - F.ln("n")
    tail = other.agg(F.percentile(best, F.lit(TAIL))).first()[0]
    if tail is None:
        tail = 0.0
    # 1 - exp(-K exp(-tail)) = 1 - TAIL
    k = math.exp(tail) * -math.log(TAIL)
    c = Calibration(lam, k, 1.0, 0.0)
    least = F.greatest(F.lit(0.0), F.ln(F.greatest("n", F.lit(1)) * k))
    total = F.aggregate("segments", F.lit(0.0), lambda a, x: a + F.greatest(x * lam - least, F.lit(0.0)))
    total = seen.select(total.alias("x"), "toxic").toPandas()
    c.slope, c.middle = logistic(total["x"].to_numpy(), total["toxic"].to_numpy(dtype=float))
    return c


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          label: str = "toxic") -> Model:
    """The model, from the labels of documents that are not held out.  Rows of
    ``labels`` without an id or with another label than 0 and 1 are ignored."""
    sample = _sample(docs, labels, doc_id, text, label)
    whole, *halves = _weights(sample)
    return Model(whole, _calibrated(sample, halves))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", spans: bool = False) -> DataFrame:
    """Per row: doc_id, held_out, score (the probability of label 1), predicted (1
    if that is 0.5 or more), n_passages and, if ``spans``, passages: an array of
    (start, end, score, chance) of each significant passage, in code points.

    Null and empty texts, and texts without letters, have no passage and the
    score of a text of one word without weight.  Repeated rows are scored alike; a
    null id stays null and counts as held out; other columns are never looked
    at; an empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                found, p = model.passages(text)
                own = []
                if spans and found:
                    at = [(m.start(), m.end()) for m in _WORD.finditer(text)]
                    own = [(at[a][0], at[b - 1][1], s, q) for a, b, s, q in found]
                rows.append((p, len(found), own))
            out = pd.DataFrame(rows, columns=["score", "n_passages", "passages"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            out.insert(1, "held_out", pdf["held_out"].to_numpy())
            yield out if spans else out.drop(columns="passages")

    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = "doc_id string, held_out boolean, score double, n_passages int"
    schema += ", passages array<struct<start: int, end: int, score: double, chance: double>>" * spans
    out = rows.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                      *out.columns[3:])


def detect(docs: DataFrame, labels: DataFrame, spans: bool = False) -> DataFrame:
    """Learns from the labels and scores all documents."""
    return score(docs, train(docs, labels), spans=spans)
