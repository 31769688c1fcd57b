"""How good a grouping is: silhouette, Davies-Bouldin, Calinski-Harabasz, stability. Labelled points are (rid, x, cluster)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.functions.vectors import l2
from pointweave.operators.distances import distances_to, rows_of
from pointweave.operators.tables import RID


def cluster_sums(x: np.ndarray, y: np.ndarray, starts: np.ndarray, rows: int = 256, columns: int = 1024) -> np.ndarray:
    """Sums of the distances of each row of x from the rows of y in each cluster, which begin at `starts`.

    Squared distances come from products, in small blocks; those that rounding could have touched, of points near each
    other against their lengths, from differences, so equal points are at 0.
    """
    mean = y.mean(axis=0)
    a, b = x - mean, y - mean
    own, other = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    turned = np.ascontiguousarray(b.T) * -2
    out = np.zeros((len(x), len(starts)))
    for at in range(0, len(y), columns):
        to = min(len(y), at + columns)
        first = max(0, int(np.searchsorted(starts, at, "right")) - 1)
        inside = np.maximum(starts[first : int(np.searchsorted(starts, to, "left"))], at) - at
        most = other[at:to].max()
        for lo in range(0, len(x), rows):
            d = a[lo : lo + rows] @ turned[:, at:to]
            d += other[at:to]
            d += own[lo : lo + rows, None]
            i, j = np.divmod(np.flatnonzero(~(d > 1e-5 * (own[lo : lo + rows, None] + most))), to - at)
            for part in range(0, len(i), 65536):
                off = x[lo + i[part : part + 65536]] - y[at + j[part : part + 65536]]
                d[i[part : part + 65536], j[part : part + 65536]] = np.einsum("ij,ij->i", off, off)
            np.sqrt(d, out=d)
            out[lo : lo + rows, first : first + len(inside)] += np.add.reduceat(d, inside, axis=1)
    return out


def silhouettes(labelled: DataFrame, block_rows: int = 65_536, least_blocks: int = 8) -> DataFrame:
    """(rid, s) of each point: exact, so its work is quadratic.

    Blocks of points meet shards of them; a pair of these sends a sum a point and cluster, not its distances. Points are
    sent once a block, so there are few blocks: least_blocks, and more only beyond least_blocks * block_rows points. A
    point alone in its cluster has a = 0 and s = 1; without another cluster b is as large as can be.
    """
    rows = labelled.count()
    n = max(1, math.ceil(rows / block_rows), min(least_blocks, math.ceil(rows / 1024)))
    part = F.pmod(F.xxhash64(RID), F.lit(n)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asking = labelled.select(RID, "x", "cluster", part.alias("block")).withColumn("shard", every)
    others = labelled.select(F.col("x").alias("ox"), F.col("cluster").alias("cj"), part.alias("of_shard")).withColumn("of_block", every)

    def meet(own: pa.Table, against: pa.Table) -> pa.Table:
        if not own.num_rows or not against.num_rows:
            return pa.table({"rid": pa.array([], pa.int64()), "ci": pa.array([], pa.int32()), "cj": pa.array([], pa.int32()), "d": pa.array([], pa.float64()), "n": pa.array([], pa.int64())})
        labels = against.column("cj").to_numpy()
        order = np.argsort(labels, kind="stable")
        clusters, starts, counts = np.unique(labels[order], return_index=True, return_counts=True)
        x, k = rows_of(own.column("x")), len(clusters)
        sums = cluster_sums(x, rows_of(against.column("ox"))[order], starts)
        return pa.table({"rid": np.repeat(own.column("rid").to_numpy(), k), "ci": np.repeat(own.column("cluster").to_numpy(), k).astype(np.int32), "cj": np.tile(clusters, len(x)).astype(np.int32), "d": sums.ravel(), "n": np.tile(counts, len(x))})

    met = asking.groupBy("block", "shard").cogroup(others.groupBy("of_block", "of_shard")).applyInArrow(meet, "rid long, ci int, cj int, d double, n long")
    totals = met.groupBy(RID, "ci", "cj").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    own = F.col("ci") == F.col("cj")
    mean = F.when(own, F.try_divide("d", F.col("n") - 1)).otherwise(F.col("d") / F.col("n"))
    sides = totals.groupBy(RID).agg(F.max(F.when(own, mean)).alias("a"), F.min(F.when(~own, mean)).alias("b"))
    inner, outer = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(3.4028234663852886e38))
    widest = F.greatest(inner, outer)
    return sides.select(RID, F.when(widest > 0, (outer - inner) / widest).otherwise(0.0).alias("s"))


def silhouette(labelled: DataFrame, k: int) -> float:
    """The mean of s; 0 for one cluster or no rows."""
    return 0.0 if k <= 1 else float(silhouettes(labelled).agg(F.avg("s")).first()[0] or 0.0)


def spreads(labelled: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, n, spread, within): sizes, mean distances and summed squared distances from the given centroids."""
    fixed = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centroids])
    own = F.element_at(fixed, F.col("cluster") + 1)
    d = l2(F.col("x"), own)
    return labelled.groupBy("cluster").agg(F.count("*").alias("n"), F.avg(d).alias("spread"), F.sum(d * d).alias("within"))


def davies_bouldin(labelled: DataFrame, centroids: np.ndarray) -> float:
    """Mean over all centroids of the largest (s_i + s_j) / d_ij; a pair at no distance is skipped."""
    k = len(centroids)
    if k <= 1:
        return 0.0
    s = np.zeros(k)
    for r in spreads(labelled, centroids).collect():
        s[r["cluster"]] = r["spread"]
    d = np.sqrt(distances_to(centroids, centroids))
    ratio = np.divide(s[:, None] + s[None, :], d, out=np.zeros((k, k)), where=d > 0)
    return float(ratio.max(axis=1).mean())


def centres(labelled: DataFrame) -> dict[int, np.ndarray]:
    """Mean of each cluster; a task sends a sum a cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            if batch.num_rows:
                x, (own, which) = rows_of(batch.column(1)), np.unique(batch.column(0).to_numpy(), return_inverse=True)
                total, counts = np.zeros((len(own), x.shape[1])), np.bincount(which)
                np.add.at(total, which, x)
                for c, n, t in zip(own.tolist(), counts.tolist(), total):
                    before = sums.get(c, (0, np.zeros(x.shape[1])))
                    sums[c] = before[0] + n, before[1] + t
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([t.tolist() for _, t in sums.values()], pa.list_(pa.float64()))], names=["c", "n", "s"])

    found: dict[int, tuple[int, np.ndarray]] = {}
    for r in labelled.select(F.col("cluster").cast("int"), "x").mapInArrow(run, "c int, n long, s array<double>").groupBy("c").agg(F.sum("n").alias("n"), F.collect_list("s").alias("s")).collect():
        found[r["c"]] = r["n"], np.sum(r["s"], axis=0)
    return {c: total / n for c, (n, total) in found.items()}


def calinski_harabasz(labelled: DataFrame, centroids: np.ndarray) -> float:
    """(between / (k - 1)) / (within / (n - k)); 0 for one cluster, too few rows or no spread within."""
    k = len(centroids)
    rows = spreads(labelled, centroids).collect()
    n, within = sum(r["n"] for r in rows), sum(r["within"] for r in rows)
    if k <= 1 or n <= k or within == 0:
        return 0.0
    counts = np.zeros(k)
    for r in rows:
        counts[r["cluster"]] = r["n"]
    own = centres(labelled)
    mean = sum(counts[c] * m for c, m in own.items()) / n
    between = float((counts * ((centroids - mean) ** 2).sum(axis=1)).sum())
    return (between / (k - 1)) / (within / (n - k))


def entropy_of(share: Column) -> Column:
    return F.when(share > 0, -share * F.log2(share)).otherwise(0.0)


def stability(labelled: DataFrame, k: int) -> float:
    """Entropy of the clusters' shares over log2 k; 1 for one cluster."""
    if k <= 1:
        return 1.0
    counts = labelled.groupBy("cluster").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    return float(counts.agg(F.sum(entropy_of(F.col("n") / total))).first()[0]) / math.log2(k) if total else 0.0


def evaluate(labelled: DataFrame, exclude_noise: bool = False) -> dict[str, float]:
    """Metrics of a grouping by its own means. Noise (0) counts as a cluster unless it is excluded."""
    if exclude_noise:
        labelled = labelled.where("cluster > 0")
    means = centres(labelled)
    if not means:
        return {"k": 0, "silhouette": 0.0, "davies_bouldin": 0.0, "calinski_harabasz": 0.0, "stability": 1.0}
    number = {c: i for i, c in enumerate(sorted(means))}
    dense = labelled.withColumn("cluster", F.element_at(F.create_map(*[F.lit(v) for kv in number.items() for v in kv]), F.col("cluster")))
    matrix = np.array([means[c] for c in sorted(means)])
    k = len(matrix)
    return {"k": k, "silhouette": silhouette(dense, k), "davies_bouldin": davies_bouldin(dense, matrix), "calinski_harabasz": calinski_harabasz(dense, matrix), "stability": stability(dense, k)}


def of_arrays(x: np.ndarray, labels: np.ndarray, centroids: np.ndarray) -> tuple[float, float, float, float]:
    """(silhouette, Davies-Bouldin, Calinski-Harabasz, stability) of a few points that are at hand, by the same rules."""
    k, n = len(centroids), len(x)
    if k <= 1 or not n:
        return 0.0, 0.0, 0.0, 1.0 if k <= 1 else 0.0
    counts = np.bincount(labels, minlength=k)
    d = np.sqrt(distances_to(x, x))
    sums = np.stack([d[:, labels == c].sum(axis=1) for c in range(k)], axis=1)
    own = np.arange(n), labels
    inner = np.where(counts[labels] > 1, sums[own] / np.maximum(counts[labels] - 1, 1), 0.0)
    other = np.where(counts > 0, sums / np.maximum(counts, 1), np.inf)
    other[own] = np.inf
    outer = np.minimum(other.min(axis=1), 3.4028234663852886e38)
    widest = np.maximum(inner, outer)
    silhouette_ = float(np.where(widest > 0, (outer - inner) / np.where(widest > 0, widest, 1), 0.0).mean())
    off = np.sqrt(((x - centroids[labels]) ** 2).sum(axis=1))
    spread = np.bincount(labels, weights=off, minlength=k) / np.maximum(counts, 1)
    apart = np.sqrt(distances_to(centroids, centroids))
    ratio = np.divide(spread[:, None] + spread[None, :], apart, out=np.zeros((k, k)), where=apart > 0)
    within = float((off**2).sum())
    between = float((counts * ((centroids - x.mean(axis=0)) ** 2).sum(axis=1)).sum())
    share = counts[counts > 0] / n
    return silhouette_, float(ratio.max(axis=1).mean()), 0.0 if n <= k or within == 0 else (between / (k - 1)) / (within / (n - k)), float(-(share * np.log2(share)).sum() / math.log2(k))
