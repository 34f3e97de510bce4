"""Vector maths as native Column expressions (higher-order functions).

Vectors are stored as ``array<float>``; all arithmetic is done in double.
These expressions stay inside the JVM (no Python per row), and the per-row
norm is computed once per row so the per-pair work is a single dot product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


#: Components that are spread over columns at most.
MOST_PARTS = 256


def with_parts(df: DataFrame, vec: str, n: int, name: str) -> DataFrame:
    """The first ``n`` components of a vector as double columns name0, name1, ...,
    0 where it has none, in its place: sums over them are compiled, those of
    functions over arrays are not."""
    return df.select("*", *[F.coalesce(F.get(vec, F.lit(i)).cast("double"), F.lit(0.0)).alias(f"{name}{i}")
                            for i in range(n)]).drop(vec)


def dot_parts(n: int, a: str, b: str) -> Column:
    out = F.lit(0.0)
    for i in range(n):
        out = out + F.col(f"{a}{i}") * F.col(f"{b}{i}")
    return out


def euclidean_parts(n: int, a: str, b: str) -> Column:
    out = F.lit(0.0)
    for i in range(n):
        gap = F.col(f"{a}{i}") - F.col(f"{b}{i}")
        out = out + gap * gap
    return F.sqrt(out)


def norm(a) -> Column:
    a = _c(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_from_parts(dot_col: Column, norm_a: Column, norm_b: Column) -> Column:
    den = norm_a * norm_b
    return F.when(den > 0, dot_col / den)


def cosine_similarity(a, b) -> Column:
    """dot(a,b) / (|a| |b|); NULL for a zero vector."""
    return cosine_from_parts(dot(a, b), norm(a), norm(b))


def cosine_distance(a, b) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def euclidean_distance(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.sqrt(F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2),
        F.lit(0.0).cast("double"), lambda acc, x: acc + x))


def inner_product(a, b) -> Column:
    return dot(a, b)


def score_from_distance(d, mode: str = "cosine") -> Column:
    """Map a distance to a similarity score.

    cosine  : the value is already a cosine similarity, returned as is
    half    : clamp(1 - d/2, 0, 1) for cosine distance in [0, 2]
    inverse : 1 / (1 + max(0, d)) for unbounded distances
    """
    d = _c(d)
    if mode == "cosine":
        return d
    if mode == "half":
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - d / 2))
    if mode == "inverse":
        return F.lit(1.0) / (F.lit(1.0) + F.greatest(F.lit(0.0), d))
    raise ValueError(f"unknown score mode {mode!r}")


def unit(a) -> Column:
    """Vector scaled to unit length (zero vector stays zero)."""
    a = _c(a)
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(
        F.transform(a, lambda x: x.cast("double")))
