"""Dense vector arithmetic on ``array<double>`` columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it inside a lambda over another array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column, b: Column, length: int | None = None) -> Column:
    """Inner product of two equally long arrays. Where their ``length`` is known and small, the sum
    is written out, in the same order; Spark compiles that, and interprets functions of arrays."""
    if length:
        return reduce(lambda total, i: total + a[i] * b[i], range(length), F.lit(0.0))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(v: Column | str) -> Column:
    """Scale to unit length; a zero vector stays zero."""
    v = F.col(v) if isinstance(v, str) else v
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return _bind(
        norm,
        lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n)),
    )


def scale(v: Column, factor: Column) -> Column:
    """Multiply every element by ``factor``."""
    return _bind(factor, lambda f: F.transform(v, lambda x: x * f))


def hashed_vector(key: Column, dim: int, low: float = -0.25, high: float = 0.25) -> Column:
    """A repeatable stand-in for a uniform random vector, seeded by ``key``."""
    steps = 1 << 30
    unit = lambda i: F.pmod(F.xxhash64(key, i), F.lit(steps)).cast("double") / steps
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: unit(i) * (high - low) + low)
