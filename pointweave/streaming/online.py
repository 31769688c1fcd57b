"""Online k-means with forgetting: by points in order, by batches in closed form, and as a stream."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pointweave.errors import check_forgetting, check_width, require
from pointweave.operators.distances import assigned, distances_to, rows_of
from pointweave.operators.kmeans import KMeansConfig, KMeansModel, fit, fit_arrays, in_order
from pointweave.operators.tables import RID
from pointweave.streaming.drift import DriftDetector


@dataclass(frozen=True)
class OnlineConfig:
    k: int = 8
    window_size: int = 1000
    forgetting_factor: float = 0.95
    auto_retrain: bool = True
    retrain_interval: int = 1000
    drift_history: int = 10
    drift_threshold: float = 0.1
    mode: str = "exact"  # or batched
    kmeans: KMeansConfig = field(default_factory=KMeansConfig)


def point_update(centroids: np.ndarray, counts: np.ndarray, x: np.ndarray, factor: float) -> int:
    """Moves the nearest centroid, in place: its count decays and grows by one, and it goes 1 / count of the way."""
    c = int(((centroids - x) ** 2).sum(axis=1).argmin())
    counts[c] = factor * counts[c] + 1
    centroids[c] += (x - centroids[c]) / counts[c]
    return c


def batched_update(centroids: np.ndarray, counts: np.ndarray, batch: DataFrame, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """A batch at once, points assigned by the centroids at its start.

    With m points of a cluster in order, the recurrence has the closed form S' = f^m S + sum f^(m-i) x_i and
    n' = f^m n + sum f^(m-i); exact where the assignments are those of the sequence, as for one cluster.
    """
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a range's points in order, from nothing: what comes later decays what came before
        first, sums, weight, n = None, np.zeros_like(centroids), np.zeros(k), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                first = batch.column(2)[0].as_py() if first is None else first
                x, own = rows_of(batch.column(0)), batch.column(1).to_numpy()
                here = np.bincount(own, minlength=k)
                after = np.empty(len(own))  # points of the same cluster that follow in this batch
                for c in np.flatnonzero(here):
                    after[own == c] = np.arange(here[c] - 1, -1, -1)
                w = factor**after
                sums, weight, n = sums * (factor**here)[:, None], weight * factor**here, n + here
                np.add.at(sums, own, x * w[:, None])
                np.add.at(weight, own, w)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([first] * len(at), pa.int64()), pa.array(at), pa.array(n[at]), pa.array(weight[at]), pa.array(sums[at].tolist(), pa.list_(pa.float64()))], names=["first", "cluster", "n", "w", "s"])

    # ranges of rids, sorted within; a task sends a row a cluster, ordered by its first rid
    ranged = assigned(batch, centroids).repartitionByRange(RID).sortWithinPartitions(RID).select("x", "cluster", RID)
    parts = ranged.mapInArrow(run, "first long, cluster long, n long, w double, s array<double>").orderBy("first").collect()
    total, mass, n = centroids * counts[:, None], counts.astype(float).copy(), np.zeros(k)
    found, weight = np.zeros_like(centroids), np.zeros(k)
    for r in parts:
        c, decay_ = r["cluster"], factor ** r["n"]
        found[c], weight[c] = decay_ * found[c] + np.array(r["s"]), decay_ * weight[c] + r["w"]
        n[c] += r["n"]
    decay = factor**n
    mass = decay * mass + weight
    moved = (decay[:, None] * total + found) / np.where(mass > 0, mass, 1)[:, None]
    return np.where((n > 0)[:, None], moved, centroids), np.where(n > 0, mass, counts)


@dataclass
class OnlineState:
    """What a sequence of points has left: centroids, counts, the last window_size points and the detector's history."""

    config: OnlineConfig
    centroids: np.ndarray | None = None
    counts: np.ndarray | None = None
    points_seen: int = 0
    window: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    detector: DriftDetector = field(default_factory=DriftDetector)
    retrained: int = 0

    def remember(self, x: np.ndarray) -> None:
        if self.config.window_size and len(x):
            kept = np.vstack((self.window, x)) if self.window.size else x
            self.window = kept[max(0, len(kept) - self.config.window_size) :]

    def see(self, part: np.ndarray) -> None:
        """Points in order: each moves a centroid, enters the window, and may be the one at which drift is checked."""
        check_width(part.shape[1], self.centroids.shape[1])
        config, lo = self.config, 0
        while lo < len(part):
            left = config.retrain_interval - self.points_seen % config.retrain_interval if config.auto_retrain else len(part)
            hi = min(len(part), lo + left)
            for x in part[lo:hi]:
                point_update(self.centroids, self.counts, x, config.forgetting_factor)
            self.remember(part[lo:hi])
            self.points_seen += hi - lo
            if config.auto_retrain and self.points_seen % config.retrain_interval == 0:
                self.check_drift_and_retrain()
            lo = hi

    def check_drift_and_retrain(self) -> bool:
        """Metrics of at most 100 strided points of the window; where the silhouette has fallen, a fit of the window."""
        if len(self.window) < 10:
            return False
        some = self.window[:: max(1, len(self.window) // 100)][:100]
        drifting = self.detector.check_arrays(some, distances_to(some, self.centroids).argmin(axis=1), self.centroids).drifting
        if not drifting or len(self.window) < self.config.k:
            return False
        self.centroids = fit_arrays(self.window, replace(self.config.kmeans, k=self.config.k))
        self.retrained += 1
        return True


class OnlineKMeans:
    """Online k-means; its state is k by d and a window, whatever came by."""

    def __init__(self, config: OnlineConfig = OnlineConfig()):
        check_forgetting(config.forgetting_factor)
        self.state = OnlineState(config, detector=DriftDetector(config.drift_threshold, config.drift_history))
        self.seen_batches: set[int] = set()

    config = property(lambda self: self.state.config)
    centroids = property(lambda self: self.state.centroids)
    counts = property(lambda self: self.state.counts)
    cluster_counts = property(lambda self: self.state.counts)
    points_seen = property(lambda self: self.state.points_seen)
    window = property(lambda self: self.state.window)
    detector = property(lambda self: self.state.detector)

    def set_window_size(self, size: int) -> None:
        self.state.config = replace(self.config, window_size=size)
        self.state.window = self.window[max(0, len(self.window) - size) :]

    def set_forgetting_factor(self, factor: float) -> None:
        check_forgetting(factor)
        self.state.config = replace(self.config, forgetting_factor=factor)

    def set_auto_retrain(self, on: bool) -> None:
        self.state.config = replace(self.config, auto_retrain=on)

    def set_retrain_interval(self, points: int) -> None:
        require(points > 0, "the interval has to be a point at least")
        self.state.config = replace(self.config, retrain_interval=points)

    def model(self) -> KMeansModel:
        return KMeansModel(self.centroids, self.counts)

    def predict(self, points: DataFrame) -> DataFrame:
        return self.model().predict(points)

    def window_inertia(self) -> float:
        """The sum of the window's distances, not squared, from their nearest centroids."""
        return float(np.sqrt(distances_to(self.window, self.centroids).min(axis=1)).sum()) if self.window.size else 0.0

    def check_drift_and_retrain(self) -> bool:
        return self.state.check_drift_and_retrain()

    def partial_fit(self, batch: DataFrame) -> None:
        """The first batch is fitted as a whole and doesn't enter the window; later ones update, in order of rid.

        Point by point, one task goes through the batch in order; its state comes back. In closed form the
        batch is summed by all tasks, for batches that are large.
        """
        state = self.state
        if state.centroids is None:
            model = fit(batch, replace(self.config.kmeans, k=self.config.k))
            state.centroids, state.counts = model.centroids.copy(), model.counts.astype(float)
            state.points_seen += int(model.counts.sum())
        elif self.config.mode == "batched":
            state.centroids, state.counts = batched_update(state.centroids, state.counts, batch, self.config.forgetting_factor)
            n = batch.count()
            recent = batch.orderBy(F.desc(RID)).limit(self.config.window_size).select("x").toArrow()
            state.remember(rows_of(recent.column("x"))[::-1])
            crossed = (state.points_seen + n) // self.config.retrain_interval > state.points_seen // self.config.retrain_interval
            state.points_seen += n
            if crossed and self.config.auto_retrain:
                state.check_drift_and_retrain()
        else:

            def run(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
                for part in parts:
                    state.see(part)
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], names=["state"])

            self.state = pickle.loads(in_order(batch, RID, run, "state binary").first()["state"])

    def partial_fit_point(self, x: np.ndarray) -> None:
        self.state.see(np.asarray(x, float)[None, :])

    def start(self, stream: DataFrame, checkpoint: str, on_batch: Callable[[OnlineKMeans, int], None] | None = None) -> StreamingQuery:
        """Updates from a stream of points (rid, x); a batch that comes again after a failure counts once."""

        def update(batch: DataFrame, batch_id: int) -> None:
            if batch_id in self.seen_batches or batch.isEmpty():
                return
            self.partial_fit(batch)
            self.seen_batches.add(batch_id)
            if on_batch is not None:
                on_batch(self, batch_id)

        return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decayed_mean(points: DataFrame, keys: list[str], value: str, order: str, factor: float) -> DataFrame:
    """(keys, n, mean) after all points of a key in order, from nothing: one cluster's closed form by key."""
    later = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order))) - 1
    weighted = points.select(*keys, value, F.pow(F.lit(factor), later).alias("w"))
    return weighted.groupBy(*keys).agg(F.sum("w").alias("n"), (F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("mean"))
