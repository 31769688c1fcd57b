"""Scaling: three families with different rules for constant columns. Statistics of all columns come from one job."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.operators.stats import order_statistics
from pointweave.operators.tables import RID, features

MATRIX_OPERATIONS = ("normalize", "standardize", "minmax")
COLUMN_OPERATIONS = ("normalize", "standardize", "minmax", "log", "clip")


def _measured(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, float | None]]:
    kinds = {"n": F.count, "mean": F.avg, "pop": F.stddev_pop, "samp": F.stddev_samp, "low": F.min, "high": F.max, "norm": lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))}
    row = df.agg(*[f(c).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in kinds.items()]).first()
    return {c: {k: row[f"{k}_{i}"] for k in kinds} for i, c in enumerate(columns)}


def _replaced(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def scale_matrix(df: DataFrame, operation: str) -> DataFrame:
    """Family A, of all features: constant or zero columns become 0; standardize by the population's deviation.
    An unknown operation changes nothing."""
    if operation not in MATRIX_OPERATIONS:
        return df
    new = {}
    for c, m in _measured(df, features(df)).items():
        shift, by = {"normalize": (0.0, m["norm"]), "standardize": (m["mean"], m["pop"]), "minmax": (m["low"], (m["high"] or 0.0) - (m["low"] or 0.0))}[operation]
        new[c] = (F.col(c) - F.lit(shift)) / F.lit(by) if by else F.when(F.col(c).isNotNull(), F.lit(0.0))
    return _replaced(df, new)


def scale_columns(df: DataFrame, operation: str, columns: Sequence[str] | None = None, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Family B, of some columns: missing cells stay so and columns that can't be scaled stay as they are.

    standardize by the sample's deviation; log of what is 1e-10 at least; clip to the values at the low
    and high share of the sorted valid cells.
    """
    columns = list(columns or features(df))
    if operation == "log":
        return _replaced(df, {c: F.when(F.col(c).isNotNull(), F.log(F.greatest(F.col(c), F.lit(1e-10)))) for c in columns})
    measured, new = _measured(df, columns), {}
    if operation == "clip":
        ranks = [(c, math.floor(p * (measured[c]["n"] - 1))) for c in columns if measured[c]["n"] for p in (low, high)]
        values = iter(order_statistics(df, ranks))
        for c in columns:
            if measured[c]["n"]:
                a, b = next(values), next(values)
                new[c] = F.when(F.col(c) < a, F.lit(a)).when(F.col(c) > b, F.lit(b)).otherwise(F.col(c))
        return _replaced(df, new)
    for c, m in measured.items():
        if operation == "normalize" and m["norm"]:
            new[c] = F.col(c) / F.lit(m["norm"])
        elif operation == "standardize" and m["n"] >= 2 and m["samp"]:
            new[c] = (F.col(c) - F.lit(m["mean"])) / F.lit(m["samp"])
        elif operation == "minmax" and m["n"] and m["high"] > m["low"]:
            new[c] = (F.col(c) - F.lit(m["low"])) / F.lit(m["high"] - m["low"])
    return _replaced(df, new)


def z_scores(df: DataFrame) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Family C, for density-based grouping: population deviation, 1 where it is 1e-12 or less. Also (mean, divisor)
    of each feature, for scaling other rows alike."""
    scale = {c: (m["mean"] or 0.0, m["pop"] if m["pop"] and m["pop"] > 1e-12 else 1.0) for c, m in _measured(df, features(df)).items()}
    return apply_z(df, scale), scale


def apply_z(df: DataFrame, scale: dict[str, tuple[float, float]]) -> DataFrame:
    return df.select(RID, *[((F.col(c) - F.lit(m)) / F.lit(s)).alias(c) for c, (m, s) in scale.items()])
