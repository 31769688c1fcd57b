"""Filling or dropping missing cells."""

from __future__ import annotations

from collections.abc import Sequence
from enum import Enum

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.errors import InvalidInput
from pointweave.operators.stats import order_statistics
from pointweave.operators.tables import RID, drop_missing_rows, drop_sparse_columns, features


class Strategy(Enum):
    """The ways, with the names that are shown for them."""

    MEAN = "Mean"
    MEDIAN = "Median"
    MODE = "Mode"
    CONSTANT = "Constant"
    FORWARD_FILL = "Forward Fill"
    INTERPOLATE = "Linear Interpolation"
    DROP_ROWS = "Drop Rows"
    DROP_COLUMNS = "Drop Columns"


def fill(df: DataFrame, strategy: Strategy, columns: Sequence[str] | None = None, constant: float = 0.0, share: float = 0.4) -> DataFrame:
    """df with missing cells of the columns (all) handled; a column without valid cells stays as it is.

    The dropping strategies work on the whole table whatever columns are named.
    """
    columns = list(columns or features(df))
    match strategy:
        case Strategy.DROP_ROWS:
            return drop_missing_rows(df)
        case Strategy.DROP_COLUMNS:
            return drop_sparse_columns(df, share)
        case Strategy.CONSTANT:
            return df.fillna(float(constant), subset=columns)
        case Strategy.MEAN:
            row = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
            return _filled(df, {c: row[c] for c in columns})
        case Strategy.MEDIAN:
            row = df.agg(*[F.count(c).alias(c) for c in columns]).first()
            ranked = [(c, row[c] // 2) for c in columns if row[c]]  # the upper of two middle values
            return _filled(df, dict(zip([c for c, _ in ranked], order_statistics(df, ranked))))
        case Strategy.MODE:
            return _filled(df, modes(df, columns))
        case Strategy.FORWARD_FILL | Strategy.INTERPOLATE:
            return along_rows(df, columns, strategy is Strategy.INTERPOLATE)
    raise InvalidInput(f"unknown strategy {strategy}")


def _filled(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    return df.fillna({c: v for c, v in values.items() if v is not None})


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """The commonest value of each column, the least of equals; counts combine before the shuffle."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(columns)])).alias("x")).where("x.v IS NOT NULL")
    counts = long.groupBy("x.i", "x.v").agg(F.count("*").alias("n"))
    best = counts.groupBy("i").agg(F.max(F.struct("n", (-F.col("v")).alias("less"))).alias("b")).collect()
    return {columns[r["i"]]: -r["b"]["less"] + 0.0 for r in best}


def along_rows(df: DataFrame, columns: Sequence[str], interpolate: bool, rows_each: int = 1_000_000) -> DataFrame:
    """Forward fill, or linear interpolation by row number whose edges extend the nearest valid cell.

    Windows run within ranges of row numbers. What a range lacks comes from the last (and next) valid cell of
    the ranges around it: one row a range, ordered apart. So no task holds more than a range.
    """
    part = df.withColumn("_range", F.floor(F.col(RID) / rows_each))
    cell = {c: F.when(F.col(c).isNotNull(), F.struct(RID, F.col(c).alias("v"))) for c in columns}
    ends = part.groupBy("_range").agg(*[f(cell[c]).alias(f"_{k}{i}") for i, c in enumerate(columns) for k, f in (("first", F.min), ("last", F.max))])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    around = ends.select("_range", *[F.last(f"_last{i}", True).over(before).alias(f"_in{i}") for i in range(len(columns))], *[F.last(f"_first{i}", True).over(after).alias(f"_out{i}") for i in range(len(columns))])
    back = Window.partitionBy("_range").orderBy(RID).rowsBetween(Window.unboundedPreceding, 0)
    # backwards, as a frame that only grows is taken in one pass
    ahead = Window.partitionBy("_range").orderBy(F.desc(RID)).rowsBetween(Window.unboundedPreceding, 0)
    joined = part.join(around, "_range")
    new = {}
    for i, c in enumerate(columns):
        a = F.coalesce(F.last(cell[c], True).over(back), F.col(f"_in{i}"))
        if not interpolate:
            new[c] = F.coalesce(F.col(c), a.getField("v"))
            continue
        b = F.coalesce(F.last(cell[c], True).over(ahead), F.col(f"_out{i}"))
        share = (F.col(RID) - a.getField(RID)) / (b.getField(RID) - a.getField(RID))
        between = a.getField("v") + (b.getField("v") - a.getField("v")) * share
        new[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(a.isNull(), b.getField("v")).when(b.isNull(), a.getField("v")).otherwise(between)
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])
