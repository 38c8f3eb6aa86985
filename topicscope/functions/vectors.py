"""Dense-vector column functions over ``array<float|double>`` columns.

All arithmetic is done in double precision with higher-order functions, so it
stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DISTANCES = ("cosine", "euclidean")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v: Column | str) -> Column:
    return _c(v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    prods = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def squared_norm(a: Column | str) -> Column:
    return F.aggregate(as_double(a), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x)


def norm(a: Column | str) -> Column:
    return F.sqrt(squared_norm(a))


def squared_euclidean(a: Column | str, b: Column | str) -> Column:
    diffs = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(diffs, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 when either vector has zero norm."""
    den = norm(a) * norm(b)
    return F.when(den == 0, F.lit(0.0)).otherwise(dot(a, b) / den)


def distance(a: Column | str, b: Column | str, kind: str = "cosine") -> Column:
    """``1 - cosine`` or Euclidean distance; other names raise."""
    if kind == "cosine":
        return F.lit(1.0) - cosine_similarity(a, b)
    if kind == "euclidean":
        return euclidean(a, b)
    raise ValueError(f"Invalid distance: {kind}")


def vector_literal(values) -> Column:
    """A constant ``array<double>`` column."""
    return F.array(*[F.lit(float(x)) for x in values]).cast("array<double>")


def scale(a: Column | str, factor: Column) -> Column:
    return F.transform(as_double(a), lambda x: x * factor)
