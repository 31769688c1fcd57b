"""K-means: batch, sequential and mini-batch. One job an iteration; centroids are in the plan, sums come back."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.errors import check_clusters, check_fitted, check_matrix, check_width, require
from pointweave.operators.distances import assigned, distances_to, rows_of
from pointweave.operators.tables import RID


@dataclass(frozen=True)
class KMeansConfig:
    k: int = 8
    max_iter: int = 300
    tol: float = 1e-4
    seed: int = 0
    init: str = "kmeans++"  # or first_k, maximin
    empty: str = "zero"  # or keep
    callback: Callable[[int, float], bool] | None = None  # true stops


@dataclass(frozen=True)
class KMeansModel:
    centroids: np.ndarray
    counts: np.ndarray
    n_iter: int = 0
    inertia: float = 0.0
    updates: int = 0
    history: list[float] = field(default_factory=list)

    @property
    def k(self) -> int:
        return len(self.centroids)

    def predict(self, points: DataFrame) -> DataFrame:
        """(rid, cluster)."""
        return assigned(points, self.centroids).select(RID, "cluster")


def partial_sums(points: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(sums, counts, inertia) by nearest centroid, in one job; each task sends k rows at most."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, inertia = np.zeros_like(centroids, float), np.zeros(k, np.int64), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                x = rows_of(batch.column(0))
                check_width(x.shape[1], centroids.shape[1])
                d2 = distances_to(x, centroids)
                best = d2.argmin(axis=1)
                counts += np.bincount(best, minlength=k)
                inertia += np.bincount(best, weights=d2[np.arange(len(x)), best], minlength=k)
                for j in range(x.shape[1]):
                    sums[:, j] += np.bincount(best, weights=x[:, j], minlength=k)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts[own]), pa.array(inertia[own]), pa.array(sums[own].tolist(), pa.list_(pa.float64()))], names=["c", "n", "d2", "s"])

    parts = points.select("x").mapInArrow(run, "c long, n long, d2 double, s array<double>")
    spread = parts.select("c", "n", "d2", F.posexplode("s").alias("at", "v")).groupBy("c", "at").agg(F.sum("n").alias("n"), F.sum("d2").alias("d2"), F.sum("v").alias("v")).collect()
    sums, counts, inertia = np.zeros_like(centroids, float), np.zeros(k, np.int64), 0.0
    for r in spread:
        sums[r["c"], r["at"]] = r["v"]
        counts[r["c"]] = r["n"]
        inertia += r["d2"] if r["at"] == 0 else 0.0
    return sums, counts, inertia


def updated(sums: np.ndarray, counts: np.ndarray, before: np.ndarray, empty: str) -> np.ndarray:
    """Means of members; an empty cluster becomes the zero vector, or stays."""
    means = sums / np.maximum(counts, 1)[:, None]
    return np.where(counts[:, None] > 0, means, before if empty == "keep" else 0.0)


def initial(points: DataFrame, config: KMeansConfig, rows: int) -> np.ndarray:
    """Starting centroids: the first k rows, farthest points in turn, or by chance in proportion to squared distance."""
    if config.init == "first_k":
        return np.array([r["x"] for r in points.orderBy(RID).limit(config.k).collect()], float)
    rng = np.random.default_rng(config.seed)
    if config.init == "maximin":
        first = points.orderBy(RID).limit(1).collect()[0]["x"]
    else:
        at = int(rng.integers(rows))
        first = points.orderBy(F.xxhash64(RID, F.lit(config.seed))).limit(at % 64 + 1).collect()[-1]["x"]
    centroids = np.array([first], float)
    while len(centroids) < config.k:
        found = assigned(points, centroids)
        if config.init == "maximin":
            row = found.orderBy(F.desc("d2"), RID).limit(1).collect()[0]
        else:
            # the largest of d2-weighted exponential keys is a draw in proportion to d2
            u = (F.pmod(F.xxhash64(RID, F.lit(config.seed), F.lit(len(centroids))), F.lit(1 << 52)) + 0.5) / float(1 << 52)
            row = found.withColumn("key", F.when(F.col("d2") > 0, F.log(u) / F.col("d2")).otherwise(F.lit(float("-inf")))).orderBy(F.desc("key"), RID).limit(1).collect()[0]
        centroids = np.vstack((centroids, row["x"]))
    return centroids


def fit(points: DataFrame, config: KMeansConfig = KMeansConfig(), start: np.ndarray | None = None) -> KMeansModel:
    """Lloyd's iterations over points (rid, x). From the third on, it stops if the inertia moved by less than tol of itself, or not at all."""
    points = points.select(RID, "x").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows, width = points.agg(F.count("*"), F.max(F.size("x"))).first()
        check_matrix(rows, width or 0)
        check_clusters(config.k, rows)
        centroids = initial(points, config, rows) if start is None else np.array(start, float)
        before, history, counts, n_iter = None, [], np.zeros(config.k, np.int64), config.max_iter
        for i in range(config.max_iter):
            sums, counts, inertia = partial_sums(points, centroids)
            history.append(inertia)
            centroids = updated(sums, counts, centroids, config.empty)
            stop = config.callback is not None and config.callback(i, inertia)
            if stop or (i >= 2 and before is not None and (abs(before - inertia) < config.tol * inertia or before == inertia)):
                n_iter = i
                break
            before = inertia
        return KMeansModel(centroids, counts, n_iter, history[-1] if history else 0.0, history=history)
    finally:
        points.unpersist()


def labels(points: DataFrame, model: KMeansModel | None) -> DataFrame:
    check_fitted(model)
    return model.predict(points)


def sizes(labelled: DataFrame) -> DataFrame:
    """(cluster, n)."""
    return labelled.groupBy("cluster").agg(F.count("*").alias("n"))


def in_order(batch: DataFrame, order: str, run: Callable[[Iterator[np.ndarray]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What run makes of a batch's points in order, given as arrays of rows.

    What a sequential rule learns depends on every point before, so one task reads them, sorted; it holds a
    few thousand points and k by d numbers at a time, and the driver gets what it has learned.
    """

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(rows_of(b.column(0)) for b in batches if b.num_rows)

    return batch.select(order, "x").repartition(1).sortWithinPartitions(order).select("x").mapInArrow(arrays, schema)


def partial_fit(model: KMeansModel | None, batch: DataFrame, config: KMeansConfig = KMeansConfig(), order: str = RID) -> KMeansModel:
    """Sequential update by a batch: the first call fits; later each point moves its nearest centroid, as it is by then,
    by 1 / sqrt(n_iter + 1) of the way."""
    if model is None:
        return fit(batch, config)
    before, rate = model, 1 / np.sqrt(model.n_iter + 1)

    def run(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        centroids, counts = before.centroids.copy(), before.counts.astype(np.int64)
        for part in parts:
            check_width(part.shape[1], centroids.shape[1])
            for x in part:
                c = int(((centroids - x) ** 2).sum(axis=1).argmin())
                centroids[c] += rate * (x - centroids[c])
                counts[c] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts), pa.array(centroids.tolist(), pa.list_(pa.float64()))], names=["c", "n", "m"])

    rows = in_order(batch, order, run, "c long, n long, m array<double>").collect()
    rows.sort(key=lambda r: r["c"])
    return replace(model, centroids=np.array([r["m"] for r in rows]), counts=np.array([r["n"] for r in rows]))


def fit_arrays(x: np.ndarray, config: KMeansConfig) -> np.ndarray:
    """Centroids of a few points that are at hand: Lloyd's iterations by the same rules, from points drawn in proportion to
    squared distance (or the first k)."""
    rng, k = np.random.default_rng(config.seed), min(config.k, len(x))
    centroids = x[:k].copy()
    if config.init != "first_k":
        centroids = x[[int(rng.integers(len(x)))]]
        while len(centroids) < k:
            d2 = distances_to(x, centroids).min(axis=1)
            at = int(d2.argmax()) if config.init == "maximin" or not d2.sum() else int(rng.choice(len(x), p=d2 / d2.sum()))
            centroids = np.vstack((centroids, x[at]))
    before = None
    for i in range(config.max_iter):
        d2 = distances_to(x, centroids)
        own = d2.argmin(axis=1)
        inertia, counts = float(d2[np.arange(len(x)), own].sum()), np.bincount(own, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        centroids = updated(sums, counts, centroids, config.empty)
        if i >= 2 and before is not None and (abs(before - inertia) < config.tol * inertia or before == inertia):
            break
        before = inertia
    return centroids


def mini_batch_update(model: KMeansModel, drawn: np.ndarray) -> KMeansModel:
    """One update by drawn points: nearest centroids are those at its start; the rate is 1 / (updates + 1), counted over all clusters."""
    centroids, u = model.centroids.copy(), model.updates
    nearest_at_start = distances_to(drawn, model.centroids).argmin(axis=1)
    for x, c in zip(drawn, nearest_at_start):
        u += 1
        centroids[c] += (x - centroids[c]) / u
    return replace(model, centroids=centroids, updates=u)


def draw(points: DataFrame, rows: int, size: int, seed: int) -> np.ndarray:
    """size points drawn with replacement, in the order of the draws; rids are 0 to rows - 1. size is the batch's, not the table's."""
    numbers = np.random.default_rng(seed).integers(rows, size=size).tolist()
    spark = points.sparkSession
    drawn = spark.createDataFrame(list(enumerate(numbers)), "draw long, rid long")
    rows = points.join(F.broadcast(drawn), RID).select("draw", "x").orderBy("draw").toArrow()
    return rows_of(rows.column("x"))


def mini_batch_partial_fit(model: KMeansModel | None, points: DataFrame, batch_size: int = 100, config: KMeansConfig = KMeansConfig(), seed: int = 0) -> KMeansModel:
    """The first call starts from points of the batch; each call draws batch_size rows with replacement."""
    require(batch_size > 0, "batch_size has to be more than 0")
    rows = points.count()
    check_clusters(config.k, rows)
    drawn = draw(points, rows, batch_size, seed)
    if model is None:
        model = KMeansModel(initial(points, config, rows), np.zeros(config.k, np.int64))
    return mini_batch_update(model, drawn)


def mini_batch_fit(points: DataFrame, batches: int = 50, batch_size: int = 100, config: KMeansConfig = KMeansConfig()) -> KMeansModel:
    """Mini-batch updates in a row. All draws meet the points in one join; batches times batch_size rows come back."""
    require(batches > 0 and batch_size > 0, "batches and batch_size have to be more than 0")
    rows = points.count()
    check_clusters(config.k, rows)
    drawn = draw(points, rows, batches * batch_size, config.seed)
    model = KMeansModel(initial(points, config, rows), np.zeros(config.k, np.int64))
    for at in range(0, len(drawn), batch_size):
        model = mini_batch_update(model, drawn[at : at + batch_size])
    return model


def algorithm_for(rows: int, asked: str = "kmeans", most: int = 50_000) -> str:
    """Batch k-means of more than `most` rows gives way to the online one."""
    return "online" if asked == "kmeans" and rows > most else asked


def fixed(centroids: Sequence[Sequence[float]]) -> KMeansModel:
    """A model of given centroids."""
    centroids = np.array(centroids, float)
    return KMeansModel(centroids, np.zeros(len(centroids), np.int64))
