"""The table behind a scatter plot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.operators.tables import RID, features


def plot_frame(df: DataFrame, labels: DataFrame | None = None, noise: bool = False) -> DataFrame:
    """(rid, x, y, z, label): up to three features, absent axes 0; labels (rid, cluster), noise shown as -1."""
    own = [F.col(c) for c in features(df)[:3]]
    axes = [*own, *[F.lit(0.0)] * (3 - len(own))]
    shaped = df.select(RID, *[a.alias(n) for a, n in zip(axes, "xyz")])
    if labels is None:
        return shaped.withColumn("label", F.lit(0))
    joined = shaped.join(labels.select(RID, "cluster"), RID, "left")
    label = F.when(F.col("cluster") == 0, -1).otherwise(F.col("cluster")) if noise else F.col("cluster")
    return joined.select(RID, "x", "y", "z", label.cast("int").alias("label"))


def axis_ranges(plot: DataFrame) -> DataFrame:
    """(axis, low, high)."""
    row = plot.agg(*[f(a).alias(f"{a}{k}") for a in "xyz" for k, f in (("low", F.min), ("high", F.max))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"{a}low").alias("low"), F.col(f"{a}high").alias("high")) for a in "xyz"])).alias("r")).select("r.*")
