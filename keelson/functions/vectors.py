"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a at length 1; null where its length is no more than 1e-12."""
    n = norm(a)
    return F.when(n > 1e-12, F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def clipped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def is_unit(a: Column, tolerance: float = 1e-5) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x)) & (F.abs(norm(a) - 1) <= tolerance)


def residual(a: Column, b: Column) -> Column:
    """unit(a - b), null where they are as good as equal."""
    return unit(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")))


def redundancy(old: Column, new: Column, valid: Column) -> Column:
    """Aggregate: the largest clipped similarity to what is taken, by the new state where both sides have one and else by the old; 0 where nothing is taken."""
    inside = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return F.coalesce(F.max(F.when(valid, inside(new)).otherwise(inside(old))), F.lit(0.0))


def recovered_projection(f: Column, gamma: Sequence[float], beta: Sequence[float], weight: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """struct(scale, vector) of a unit vector f = x / |x|, where x = gamma * z + beta and z sums to 0: x is f by the scale that makes that so, then weight x + bias at length 1.

    Null where the scale isn't positive or beyond what z, of a norm of sqrt(n) at most, allows.
    """
    n = len(gamma)
    array = lambda v: F.array(*(F.lit(float(x)) for x in v))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * y))
    x = F.transform(f, lambda v: v.cast("double"))
    scale = F.lit(sum(b / g for b, g in zip(beta, gamma, strict=True))) / dot(x, array([1 / g for g in gamma]))
    most = max(map(abs, gamma)) * n**0.5 + sum(b * b for b in beta) ** 0.5
    y = F.array(*(scale * dot(x, array(w)) + F.lit(float(b)) for w, b in zip(weight, bias, strict=True)))
    length = F.sqrt(dot(y, y))
    ok = (scale > 0) & (scale <= most * (1 + 1e-5)) & (length > 1e-12)
    return F.when(ok, F.struct(scale.alias("scale"), F.transform(y, lambda v: v / length).alias("vector")))
