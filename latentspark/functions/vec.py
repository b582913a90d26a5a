"""Column builders for vectors held as ARRAY<DOUBLE>. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least norm that divides; below it a vector keeps its (near-zero) direction instead of blowing up.
TINY = 1e-12


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def sq_dist(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def unit(a: Column) -> Column:
    """a over its norm; a zero vector is left as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(TINY)) * F.greatest(norm(b), F.lit(TINY)))


def rounded(a: Column, places: int = 6) -> Column:
    return F.transform(a, lambda x: F.round(x, places))


def rounded(x: Column, places: int) -> Column:
    """F.round of a double by products, which for many cells takes a fraction of the time of its decimals; large numbers, NaN and infinities go by F.round."""
    scale = 10.0**places
    whole = F.floor(F.abs(x) * scale + 0.5)
    return F.when(F.abs(x) < 1e9, F.when(x < 0, -whole).otherwise(whole) / F.lit(scale)).otherwise(F.round(x, places))
