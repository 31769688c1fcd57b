"""Expressions over arrays of doubles and over feature columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("array<double>")


def squared_distance(a: Column, b: Column) -> Column:
    """Sum of squared differences of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def squared_to(columns: Sequence[str], point: Sequence[float]) -> Column:
    """Squared distance of a row's columns from a fixed point: one generated expression."""
    terms = [(F.col(c) - F.lit(float(p))) * (F.col(c) - F.lit(float(p))) for c, p in zip(columns, point)]
    return sum(terms[1:], terms[0])


def vector_of(*columns: str) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def zeroless(column: Column, places: int = 6) -> Column:
    """Rounded, with -0.0 as 0.0, so that equal results print alike."""
    return F.round(column, places) + F.lit(0.0)
