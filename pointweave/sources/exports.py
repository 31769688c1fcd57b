"""Tables and models as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.operators.tables import RID, features


def label_lines(labels: DataFrame) -> DataFrame:
    """(id, cluster) as text columns."""
    return labels.select(F.col(RID).alias("id"), F.format_string("%.0f", F.col("cluster").cast("double")).alias("cluster"))


def centroid_lines(spark: SparkSession, centroids: Sequence[Sequence[float]]) -> DataFrame:
    """(c, f0, f1, ...): numbers with six decimals, in order."""
    width = len(centroids[0]) if len(centroids) else 0
    return spark.createDataFrame([(i, *[f"{v:.6f}" for v in c]) for i, c in enumerate(centroids)], ", ".join(["c int", *[f"f{j} string" for j in range(width)]]))


def table_lines(df: DataFrame) -> DataFrame:
    """(rid, features): numbers with six decimals, nothing for missing cells."""
    return df.select(RID, *[F.when(F.col(c).isNotNull(), F.format_string("%f", F.col(c))).alias(c) for c in features(df)])


def _write(lines: DataFrame, path: str, order: str, drop: bool, single: bool) -> None:
    ordered = lines.orderBy(order)
    kept = ordered.drop(order) if drop else ordered
    (kept.coalesce(1) if single else kept).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def export_labels(labels: DataFrame, path: str, single: bool = False) -> None:
    _write(label_lines(labels), path, "id", False, single)


def export_centroids(spark: SparkSession, centroids: Sequence[Sequence[float]], path: str) -> None:
    _write(centroid_lines(spark, centroids), path, "c", True, True)


def export_table(df: DataFrame, path: str, single: bool = False) -> None:
    _write(table_lines(df), path, RID, True, single)


def report(rows: int, columns: int, selected: Sequence[str], run: dict | None = None) -> str:
    """A few lines on a table and, if there was one, a run of a grouping on it."""
    lines = [f"Dataset: {rows} rows x {columns} cols", "Selected columns: " + " ".join(selected)]
    if run:
        lines.append(f"Algorithm: {run['algorithm']}  k: {run['k']}")
        lines.append(f"Inertia: {run['inertia']:.4f}")
        lines.append(f"Iterations: {run['iterations']}")
        lines.append(f"Silhouette: {run['silhouette']:.4f}")
        lines.append(f"Davies-Bouldin: {run['davies_bouldin']:.4f}")
    return "\n".join(lines) + "\n"
