"""Choosing the number of clusters."""

from __future__ import annotations

from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointweave.operators import metrics
from pointweave.operators.distances import assigned
from pointweave.operators.kmeans import KMeansConfig, fit
from pointweave.operators.tables import RID, stride

COLUMNS = "k int, inertia double, silhouette double, davies_bouldin double, calinski_harabasz double"


def elbow(points: DataFrame, min_k: int = 1, max_k: int = 15, max_iter: int = 100, config: KMeansConfig = KMeansConfig()) -> DataFrame:
    """(k, inertia) for k up to the number of rows less 1; none for fewer than two rows."""
    return _sweep(points, max(min_k, 1), max_k, max_iter, config, 2, False).select("k", "inertia")


def evaluate(points: DataFrame, min_k: int = 2, max_k: int = 15, max_iter: int = 100, config: KMeansConfig = KMeansConfig(), sample: int = 1000) -> DataFrame:
    """(k, inertia, silhouette, davies_bouldin, calinski_harabasz); quadratic metrics are of strided rows if there are more than sample."""
    return _sweep(points, max(min_k, 2), max_k, max_iter, config, 3, True, sample)


def _sweep(points: DataFrame, low: int, high: int, max_iter: int, config: KMeansConfig, least_rows: int, scored: bool, sample: int = 1000) -> DataFrame:
    spark = points.sparkSession
    points = points.select(RID, "x").persist(StorageLevel.MEMORY_AND_DISK)
    n, rows = points.count(), []
    if n >= least_rows:
        for k in range(low, min(high, n - 1) + 1):
            model = fit(points, replace(config, k=k, max_iter=max_iter))
            if scored:
                labelled = assigned(points, model.centroids).select(RID, "x", "cluster")
                some = stride(labelled, n, sample)
                rows.append((k, model.inertia, metrics.silhouette(some, k), metrics.davies_bouldin(some, model.centroids), metrics.calinski_harabasz(some, model.centroids)))
            else:
                rows.append((k, model.inertia, None, None, None))
    points.unpersist()
    return spark.createDataFrame(rows, COLUMNS)


def _first_k(results: DataFrame, best: Column) -> DataFrame:
    return results.agg(F.coalesce(F.min_by("k", F.struct(best, F.col("k"))), F.lit(2)).alias("k"))


def best_k_silhouette(results: DataFrame) -> DataFrame:
    """The k of the largest silhouette, the least of equals; 2 without results."""
    return _first_k(results, -F.col("silhouette"))


def best_k_davies_bouldin(results: DataFrame) -> DataFrame:
    return _first_k(results, F.col("davies_bouldin"))


def best_k_elbow(results: DataFrame) -> DataFrame:
    """The inner k of the largest second difference of inertia; the first k of fewer than three results."""
    order = Window.orderBy("k")
    bend = F.lag("inertia").over(order) + F.lead("inertia").over(order) - 2 * F.col("inertia")
    bent = results.select("k", bend.alias("bend"))
    return bent.agg(F.coalesce(F.min_by("k", F.when(F.col("bend").isNotNull(), F.struct(-F.col("bend"), F.col("k")))), F.min("k"), F.lit(2)).alias("k"))


def newest(runs: DataFrame, most: int = 20) -> DataFrame:
    """The latest runs of a log (run, ...)."""
    return runs.orderBy(F.desc("run")).limit(most)
