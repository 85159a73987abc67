"""Vector columns: arrays of numbers, as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product; null if either side is null or their lengths differ."""
    products = F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column | str, least: float = 1e-6) -> Column:
    """The vector over its norm, the norm taken as `least` at least."""
    v = _col(v)
    # The norm stands in an array, so that it is computed once, not for each element.
    return F.zip_with(doubles(v), F.array_repeat(norm(v), F.size(v)), lambda x, n: x / F.greatest(n, F.lit(least)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine in which a zero vector counts as one of norm 1."""
    nz = lambda n: F.when(n == 0, 1.0).otherwise(n)
    return dot(a, b) / (nz(norm(a)) * nz(norm(b)))


def drift(a: Column | str, b: Column | str) -> Column:
    return 1.0 - cosine(a, b)


def blend(a: Column | str, b: Column | str, alpha: Column | float) -> Column:
    """alpha * a + (1 - alpha) * b, element by element."""
    alpha = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return F.zip_with(doubles(a), doubles(b), lambda x, y: alpha * x + (1.0 - alpha) * y)


def shaped(v: Column | str, kind: Column | str) -> Column:
    """The embedding as a model takes it: `raw`, or of unit length; other kinds need a learned converter and are null."""
    k = _col(kind)
    return F.when(k == "raw", _col(v)).when(k == "unit", unit(v))
