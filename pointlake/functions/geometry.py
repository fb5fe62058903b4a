"""Geometry as Column expressions, planned inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")
Vector = tuple[Column, Column, Column]


def vec(*names: str) -> Vector:
    """Three columns by name."""
    return tuple(F.col(n) for n in names)  # type: ignore[return-value]


def dot(a: Vector, b: Vector) -> Column:
    return reduce(add, (p * q for p, q in zip(a, b)))


def sub(a: Vector, b: Vector) -> Vector:
    return tuple(p - q for p, q in zip(a, b))  # type: ignore[return-value]


def plus(a: Vector, b: Vector) -> Vector:
    return tuple(p + q for p, q in zip(a, b))  # type: ignore[return-value]


def scale(a: Vector, s: Column | float) -> Vector:
    return tuple(p * s for p in a)  # type: ignore[return-value]


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def divide(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 (also under ANSI rules)."""
    return F.try_divide(a, b)


def unit(a: Vector) -> Vector:
    """The vector at length 1; null parts where its length is 0."""
    n = norm(a)
    return tuple(divide(p, n) for p in a)  # type: ignore[return-value]


def usable(*names: str) -> Column:
    """Whether all columns are finite numbers."""
    return reduce(lambda a, b: a & b, (F.coalesce(F.abs(F.col(n)) < 1e300, F.lit(False)) for n in names))


def distance2(a: str = "a", b: str = "b") -> Column:
    """Squared distance between the points of two aliased tables."""
    d = [F.col(f"{a}.{c}") - F.col(f"{b}.{c}") for c in XYZ]
    return reduce(add, (q * q for q in d))
