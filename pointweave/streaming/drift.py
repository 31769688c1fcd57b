"""Whether groups dissolve over time."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.operators import metrics


@dataclass(frozen=True)
class DriftMetrics:
    silhouette: float
    davies_bouldin: float
    calinski_harabasz: float
    stability: float
    drifting: bool


def falls(history: list[float], threshold: float) -> bool:
    """Whether the mean of the first half exceeds that of the second by more than the threshold; needs three entries."""
    if len(history) < 3:
        return False
    mid = len(history) // 2
    return float(np.mean(history[:mid]) - np.mean(history[mid:])) > threshold


@dataclass
class DriftDetector:
    threshold: float = 0.1
    window_size: int = 10
    history: list[DriftMetrics] = field(default_factory=list)

    def set_threshold(self, threshold: float) -> None:
        self.threshold = threshold

    def set_window_size(self, window_size: int) -> None:
        self.window_size = window_size
        self.history = self.history[-window_size:]

    def check(self, labelled: DataFrame, centroids: np.ndarray) -> DriftMetrics:
        """Metrics of labelled points (rid, x, cluster), and whether the silhouette has fallen."""
        k = len(centroids)
        return self.record(metrics.silhouette(labelled, k), metrics.davies_bouldin(labelled, centroids), metrics.calinski_harabasz(labelled, centroids), metrics.stability(labelled, k))

    def check_arrays(self, x: np.ndarray, labels: np.ndarray, centroids: np.ndarray) -> DriftMetrics:
        """The same of a few points that are at hand."""
        return self.record(*metrics.of_arrays(x, labels, centroids))

    def record(self, silhouette: float, davies_bouldin: float, calinski_harabasz: float, stability: float) -> DriftMetrics:
        past = [m.silhouette for m in self.history][max(0, len(self.history) - self.window_size + 1) :]
        now = DriftMetrics(silhouette, davies_bouldin, calinski_harabasz, stability, falls([*past, silhouette], self.threshold))
        self.history = [*self.history, now][-self.window_size :]
        return now

    def is_drifting(self) -> bool:
        return bool(self.history) and self.history[-1].drifting


def drift_flags(log: DataFrame, threshold: float = 0.1, window_size: int = 10) -> DataFrame:
    """(seq, silhouette, drifting) of a log (seq, silhouette): the detector's rule over each entry's window.

    A log has an entry a check, so it is small beside the data it tells of.
    """
    recent = F.collect_list("silhouette").over(Window.orderBy("seq").rowsBetween(-(window_size - 1), 0))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, v: x + v) / F.size(a)
    mid = F.floor(F.size("w") / 2).cast("int")
    fall = mean(F.slice("w", F.lit(1), mid)) - mean(F.slice("w", mid + 1, F.size("w") - mid))
    return log.withColumn("w", recent).select("seq", "silhouette", F.when(F.size("w") < 3, False).otherwise(fall > threshold).alias("drifting"))
