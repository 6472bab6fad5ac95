"""Vector functions in double, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is below 1e-6."""
    return F.when((norm(a) < 1e-6) | (norm(b) < 1e-6), 0.0).otherwise(dot(a, b) / (norm(a) * norm(b)))


def l2_normalize(v: Column) -> Column:
    """A zero or non-finite norm leaves the vector as it is."""
    n = norm(v)
    return F.when((n > 0) & ~F.isnan(n) & (n != float("inf")), F.transform(v, lambda x: x.cast("double") / n)).otherwise(doubles(v))


def is_bad(v: Column, dim: int) -> Column:
    """Null, of another dimension, with a null or non-finite component, or of no length."""
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return v.isNull() | (F.size(v) != dim) | F.coalesce(odd, F.lit(True)) | (norm(v) < 1e-6)
