"""Column functions over arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column, least: float = 1e-12) -> Column:
    n = F.greatest(norm(v), F.lit(least))
    return F.transform(doubles(v), lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def linear(v: Column, weights: list[float], bias: float) -> Column:
    """A linear head: dot product plus bias."""
    return dot(v, F.array(*[F.lit(float(w)) for w in weights])) + bias


def axes(v: Column, directions: dict[str, list[float]]) -> dict[str, Column]:
    """The scores of named directions."""
    return {name: linear(v, d, 0.0) for name, d in directions.items()}


def hamming_similarity(a: Column, b: Column, bits: int = 64) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / bits


def shoelace(xs: Column, ys: Column) -> Column:
    """Area of a polygon from its corners in order."""
    n = F.size(xs)
    turn = lambda i: F.element_at(xs, i) * F.element_at(ys, i % n + 1) - F.element_at(xs, i % n + 1) * F.element_at(ys, i)
    return F.abs(F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda s, i: s + turn(i))) / 2


def iou(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Overlap of two boxes (left, top, right, bottom) over their union; 0 where both are empty."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    area = lambda x: F.greatest(x[2] - x[0], F.lit(0.0)) * F.greatest(x[3] - x[1], F.lit(0.0))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)
