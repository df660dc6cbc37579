"""Vector functions as Column expressions over arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, eps: float = 0.0) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + eps)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def arcosh(x: Column) -> Column:
    return F.log(x + F.sqrt(x * x - 1))


def poincare_distance(a: Column, b: Column, eps: float = 0.0) -> Column:
    """Distance in the unit ball; infinite for points outside of it."""
    inner = (1 - F.pow(norm(a), F.lit(2.0))) * (1 - F.pow(norm(b), F.lit(2.0)))
    x = 1 + 2 * squared_distance(a, b) / (inner + eps)
    return F.when(inner > 0, arcosh(F.greatest(x, F.lit(1.0)))).otherwise(F.lit(float("inf")))


def hybrid_score(n2v: tuple[Column, Column], waves: tuple[Column, Column], balls: tuple[Column, Column], gamma: float = 0.5, eta: float = 0.25) -> Column:
    """gamma cos(n2v) + eta (1 - d(balls)) + (1 - gamma - eta)(1 - cos(waves)); 0 where a vector is missing."""
    value = gamma * cosine(*n2v, eps=1e-9) + eta * (1 - poincare_distance(*balls, eps=1e-9)) + (1 - gamma - eta) * (1 - cosine(*waves, eps=1e-9))
    return F.coalesce(value, F.lit(0.0))


def quantized(a: Column) -> Column:
    """(``scale``, ``q``): eight-bit integers and the greatest magnitude, 1 for a zero vector."""
    most = F.aggregate(as_double(a), F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    scale = F.when(most == 0, F.lit(1.0)).otherwise(most)
    return F.struct(scale.alias("scale"), F.transform(as_double(a), lambda x: F.bround(x / scale * 127).cast("int")).alias("q"))


def dequantized(quant: Column) -> Column:
    return F.transform(quant["q"], lambda q: q * quant["scale"] / 127)


def pruned(a: Column, ratio: float) -> Column:
    """The ``ratio`` of greatest magnitudes, ties kept; others are 0."""
    keep = F.floor(F.size(a) * F.lit(ratio)).cast("int")
    order = F.sort_array(F.transform(as_double(a), lambda x: F.abs(x)), asc=False)
    least = F.when(keep > 0, F.element_at(order, F.greatest(keep, F.lit(1))))
    return F.transform(as_double(a), lambda x: F.when(F.abs(x) >= least, x).otherwise(F.lit(0.0)))


def clamped_to_ball(a: Column, delta: float = 1e-6) -> Column:
    n = norm(a)
    return F.when(n >= 1 - delta, F.transform(as_double(a), lambda x: x / n * (1 - delta))).otherwise(as_double(a))


def hyperbolic_radius(a: Column, curvature: float = 1.0) -> Column:
    root = curvature**0.5
    z = root * norm(a)
    return 2 / root * 0.5 * F.log((1 + z) / (1 - z))


def mobius_sum(a: Column, b: Column, curvature: float = 1.0) -> Column:
    ab, aa, bb = dot(a, b), dot(a, a), dot(b, b)
    below = 1 + 2 * curvature * ab + curvature * curvature * aa * bb
    return F.zip_with(as_double(a), as_double(b), lambda x, y: ((1 + 2 * curvature * ab + curvature * bb) * x + (1 - curvature * aa) * y) / below)


def literal(a: Column, digits: int = 6) -> Column:
    """``[v1,v2]`` as vector stores read it."""
    return F.concat(F.lit("["), F.array_join(F.transform(as_double(a), lambda x: F.format_number(x, digits)), ","), F.lit("]"))
