"""Column functions on ARRAY<DOUBLE> vectors. Null vectors give null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_vector(columns: Sequence[Column]) -> Column:
    return F.array(*[c.cast("double") for c in columns])


def scale(v: Column, k: Column | float) -> Column:
    return F.transform(v, lambda x: x * k)


def shift(v: Column, k: Column | float) -> Column:
    return F.transform(v, lambda x: x + k)


def divide(v: Column, k: Column | float) -> Column:
    """Null entries where ``k`` is 0."""
    return F.transform(v, lambda x: F.try_divide(x, F.lit(k) if not isinstance(k, Column) else k))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def all_below(a: Column, b: Column) -> Column:
    """Componentwise order: every entry of ``a`` is at most that of ``b``."""
    return F.forall(F.zip_with(a, b, lambda x, y: x <= y), lambda t: t)


def all_above(a: Column, b: Column) -> Column:
    return F.forall(F.zip_with(a, b, lambda x, y: x >= y), lambda t: t)


def cut(v: Column, begin: int, end: int) -> Column:
    """Entries ``begin`` (from 0) up to but without ``end``."""
    return F.slice(v, begin + 1, end - begin)


def take(v: Column, n: int) -> Column:
    return F.slice(v, 1, n)


def tail(v: Column) -> Column:
    return F.slice(v, F.lit(2), F.greatest(F.size(v) - 1, F.lit(0)))


def append(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def with_intercept(v: Column) -> Column:
    return F.concat(F.array(F.lit(1.0)), v)


def key(v: Column) -> Column:
    """The text form ``(a,b,...)``, under which a vector is sketched."""
    return F.concat(F.lit("("), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit(")"))


def parse_key(text: Column) -> Column:
    """The vector of a text form; anything that is not part of a number or a comma is dropped first."""
    return F.transform(F.split(F.regexp_replace(text, "[^-0-9,.E]", ""), ","), lambda x: x.try_cast("double"))


def minima(v: Column, n: int) -> Column:
    """Aggregate: componentwise minimum over rows of vectors of length ``n``."""
    return F.array(*[F.min(F.get(v, F.lit(i))) for i in range(n)])


def maxima(v: Column, n: int) -> Column:
    return F.array(*[F.max(F.get(v, F.lit(i))) for i in range(n)])
