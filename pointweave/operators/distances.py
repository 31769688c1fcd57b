"""Distances and neighbours of points (rid, x: array of doubles)."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.errors import check_width, require
from pointweave.functions.vectors import l2, squared_distance, vector_of
from pointweave.operators.balls import NeighbourIndex, index, rows_of
from pointweave.operators.tables import RID, features, stride

__all__ = ["NeighbourIndex", "all_pairs", "assigned", "distance_matrix", "distances_to", "index", "near_counts", "near_places", "nearest", "nearest_centroid", "places_of", "range_pairs", "rows_of", "vectors"]


def vectors(df: DataFrame) -> DataFrame:
    """(rid, x) of a table of feature columns; rows with a missing cell are left out."""
    own = features(df)
    return df.dropna("any", subset=own).select(RID, vector_of(*own).alias("x"))


def distances_to(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows from centroids, from differences, so equal points are at 0."""
    out = np.empty((len(x), len(centroids)))
    for j, c in enumerate(centroids):
        d = x - c
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def assigned(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(rid, x, cluster, d2): the nearest centroid, the lowest of equals, and the squared distance. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = rows_of(batch.column(1))
                check_width(x.shape[1], centroids.shape[1])
                d2 = distances_to(x, centroids)
                best = d2.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best.astype(np.int32)), pa.array(d2[np.arange(len(x)), best])], names=["rid", "x", "cluster", "d2"])

    return points.select(RID, "x").mapInArrow(run, "rid long, x array<double>, cluster int, d2 double")


def distance_matrix(points: DataFrame, centroids: Sequence[Sequence[float]]) -> DataFrame:
    """(rid, c, dist): every point's distance from every centroid; the centroids are in the plan."""
    fixed = F.array(*[F.struct(F.lit(i).alias("c"), F.array(*[F.lit(float(v)) for v in c]).alias("p")) for i, c in enumerate(centroids)])
    return points.select(RID, "x", F.explode(fixed).alias("k")).select(RID, F.col("k.c").alias("c"), l2(F.col("x"), F.col("k.p")).alias("dist"))


def nearest_centroid(points: DataFrame, centroids: Sequence[Sequence[float]]) -> DataFrame:
    """(rid, cluster, dist) in one pass."""
    return assigned(points, np.array(centroids, float)).select(RID, "cluster", F.sqrt("d2").alias("dist"))


def all_pairs(points: DataFrame, most: int | None = None, block_rows: int = 1024) -> DataFrame:
    """(i, j, d2) for i < j; of evenly spaced rows if there are more than `most`. Quadratic by nature, so for samples: the
    blocks of points meet pair by pair in an equality join."""
    rows = points.count()
    if most is not None:
        points, rows = stride(points, rows, most), min(rows, most)
    n = max(1, math.ceil(rows / block_rows))
    own, every = F.pmod(F.xxhash64(RID), F.lit(n)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = points.select(F.col(RID).alias("i"), F.col("x").alias("xi"), own.alias("p")).withColumn("q", every)
    b = points.select(F.col(RID).alias("j"), F.col("x").alias("xj"), own.alias("q")).withColumn("p", every)
    return a.join(b, ["p", "q"]).where(F.col("i") < F.col("j")).select("i", "j", squared_distance(F.col("xi"), F.col("xj")).alias("d2"))


def places_of(points: DataFrame) -> DataFrame:
    """(x, rids): the rids at each place, so that a pair of places is looked at once however many points are there."""
    return points.groupBy("x").agg(F.collect_list(RID).alias("rids"))


def _cells(a: DataFrame, b: DataFrame, epsilon: float, width: int, deal: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rows of a in each cell (cell, share) where rows closer than epsilon can be, and rows of b in their own.

    Up to three coordinates place the rows in cells, of half a side up to two. Rows of a are dealt to `deal` shares a cell.
    """
    require(epsilon > 0, "epsilon has to be more than 0")
    used = min(width, 3)
    parts = 2 if used < 3 else 1
    side = epsilon / parts * (1 + 1e-9)  # so that rounding puts no near pair further apart
    shifts = [s for s in itertools.product(range(-parts, parts + 1), repeat=used) if sum(max(abs(k) - 1, 0) ** 2 for k in s) < parts * parts]
    cell = [F.floor(F.col("x")[k] / side) for k in range(used)]
    around = F.explode(F.array(*[F.struct(*[(c + k).alias(f"c{n}") for n, (c, k) in enumerate(zip(cell, s))]) for s in shifts]))
    own = a.withColumn("share", F.pmod(F.xxhash64("x"), F.lit(deal)).cast("int")).withColumn("cell", around)
    return own, b.withColumn("cell", F.struct(*[c.alias(f"c{n}") for n, c in enumerate(cell)])).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))))


def near_places(a: DataFrame, b: DataFrame, epsilon: float, width: int) -> DataFrame:
    """(all of a's columns but x, all of b's but x, d2) of rows closer than epsilon; no column but x is in both.

    An equality join on cells; coordinates are plain columns, so distances are compiled.
    """
    wide = width > 16
    at = lambda side: [F.col("x").alias(f"{side}x")] if wide else [F.col("x")[k].alias(f"{side}x{k}") for k in range(width)]
    rest_a, rest_b = [c for c in a.columns if c != "x"], [c for c in b.columns if c != "x"]
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own, other = _cells(a, b, epsilon, width)
    own = own.select(*rest_a, *at("a"), "share", "cell").repartition(tasks, "cell", "share")
    other = other.select(*rest_b, *at("b"), "share", "cell").repartition(tasks, "cell", "share")
    if wide:
        d2 = squared_distance(F.col("ax"), F.col("bx"))
    else:
        terms = [(F.col(f"ax{k}") - F.col(f"bx{k}")) * (F.col(f"ax{k}") - F.col(f"bx{k}")) for k in range(width)]
        d2 = sum(terms[1:], terms[0])
    return own.join(other, ["cell", "share"]).where(d2 < epsilon * epsilon).select(*rest_a, *rest_b, d2.alias("d2"))


def near_counts(points: DataFrame, epsilon: float, width: int) -> DataFrame:
    """(rids, n): the rids at each place, and how many points are closer than epsilon to it, those at the place included.

    A task counts a block of places against a cell, so counts travel, not pairs.
    """
    places = places_of(points)
    own, other = _cells(places.select(F.element_at("rids", 1).alias("i"), "x"), places.select("x", F.size("rids").cast("long").alias("weight")), epsilon, width)

    def count(some: pa.Table, around: pa.Table) -> pa.Table:
        if not some.num_rows or not around.num_rows:
            return pa.table({"i": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        x, y, weight = rows_of(some.column("x")), rows_of(around.column("x")), around.column("weight").to_numpy()
        n = np.zeros(len(x), np.int64)
        for lo in range(0, len(x), 64):
            for at in range(0, len(y), 4096):
                d2 = np.zeros((len(x[lo : lo + 64]), len(y[at : at + 4096])))
                for k in range(x.shape[1]):
                    d = x[lo : lo + 64, k, None] - y[None, at : at + 4096, k]
                    d *= d
                    d2 += d
                n[lo : lo + 64] += np.where(d2 < epsilon * epsilon, weight[at : at + 4096], 0).sum(axis=1)
        return pa.table({"i": some.column("i"), "n": n})

    met = own.groupBy("cell", "share").cogroup(other.groupBy("cell", "share")).applyInArrow(count, "i long, n long")
    counted = met.groupBy("i").agg(F.sum("n").alias("n"))
    return places.withColumn("i", F.element_at("rids", 1)).join(counted, "i").select("rids", "n")


def range_pairs(points: DataFrame, epsilon: float, width: int, both: DataFrame | None = None, shown: Callable[[Column], Column] | None = None) -> DataFrame:
    """(i, j, d2) of pairs closer than epsilon, a point and itself included; i from points, j from both (points).

    Points at one place are one row until their places have met, and d2 is what `shown` makes of it, once a pair of places.
    The pairs themselves are as many as they are.
    """
    own = places_of(points)
    other = own if both is None else places_of(both)
    met = near_places(own.withColumnRenamed("rids", "i"), other.withColumnRenamed("rids", "j"), epsilon, width)
    found = met.select("i", "j", (shown(F.col("d2")) if shown else F.col("d2")).alias("d2"))
    return found.select(F.explode("i").alias("i"), "j", "d2").select("i", F.explode("j").alias("j"), "d2")


def nearest(points: DataFrame | NeighbourIndex, queries: DataFrame, k: int) -> DataFrame:
    """(query, rank from 1, rid, dist): the k nearest points of each query, ties to lower rids.

    An index that is asked more than once is better built once, by index(points).
    """
    own = points if isinstance(points, NeighbourIndex) else index(points)
    return own.nearest(queries, k)
