"""Vector arithmetic on array columns, in double precision, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Null where the lengths differ."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0, null where the lengths differ."""
    return scaled(a, b, norm(a), norm(b))


def scaled(a: Column, b: Column, na: Column, nb: Column) -> Column:
    """The cosine of vectors whose norms are known."""
    return F.when(F.size(a) != F.size(b), F.lit(None).cast("double")).when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    return let(norm(v), lambda n: F.when(n == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / n)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def band(score: Column, hi: float, lo: float) -> Column:
    """'auto' from hi, 'candidate' from lo, else 'none'; bounds count in; null and NaN are 'none'."""
    good = score.isNotNull() & ~F.isnan(score)
    return F.when(good & (score >= hi), "auto").when(good & (score >= lo), "candidate").otherwise("none")
