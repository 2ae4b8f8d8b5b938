"""Vector expressions on array<double> columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, also where use has it inside a lambda, which would compute it anew for every element."""
    return F.transform(F.array(value), use)[0]


def l2_normalize(a: Column | str) -> Column:
    """At unit length; a zero vector stays as it is."""
    column = F.col(a) if isinstance(a, str) else a
    return let(column, lambda v: let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """With norms of at least 1e-12, so that a zero vector gives 0."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))


def rounded(x: Column | str, digits: int) -> Column:
    """Rounded half away from zero, with the sign of x kept where that gives zero; Spark's round() makes 0.0 of a small negative x."""
    column = F.col(x) if isinstance(x, str) else x
    return F.round(F.abs(column), digits) * F.signum(column)
