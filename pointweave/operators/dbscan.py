"""Density-based grouping (DBSCAN), by joins and connected components."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.errors import check_dbscan, check_matrix
from pointweave.functions.vectors import squared_distance
from pointweave.operators.components import connected
from pointweave.operators.distances import NeighbourIndex, index, near_counts, near_places, nearest, vectors
from pointweave.operators.scaling import apply_z, z_scores
from pointweave.operators.tables import RID, features, numbered
from pointweave.session import cut


@dataclass(frozen=True)
class DBSCANModel:
    epsilon: float
    min_pts: int
    points: DataFrame  # (rid, x, cluster), scaled as they were grouped
    scale: dict | None = None

    @property
    def labels(self) -> DataFrame:
        """(rid, cluster): 1 and on by the least rid of a group's core points, 0 for noise."""
        return self.points.select(RID, "cluster")

    def n_clusters(self) -> int:
        return self.points.agg(F.max("cluster")).first()[0] or 0

    def n_noise(self) -> int:
        return self.points.where("cluster = 0").count()

    @cached_property
    def neighbours(self) -> NeighbourIndex:
        """An index of the points, built when first asked for."""
        return index(self.points.select(RID, "x"))

    def predict(self, table: DataFrame) -> DataFrame:
        """(rid, cluster) of other rows: the label of the nearest grouped point if it is within epsilon, else 0."""
        queries = vectors(apply_z(table, self.scale) if self.scale else table)
        found = nearest(self.neighbours, queries, 1)
        labelled = found.join(self.points.select(RID, "cluster"), RID)
        return labelled.select(F.col("query").alias(RID), F.when(F.col("dist") <= self.epsilon, F.col("cluster")).otherwise(0).cast("int").alias("cluster"))


def _distinct(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points at one place count as one with a weight, so that very many equal points don't meet in pairs."""
    at = points.groupBy("x").agg(F.min(RID).alias(RID), F.count("*").alias("weight"))
    return at, points.select(F.col(RID).alias("own"), "x")


def _cell(side: float, width: int) -> Column:
    return F.array(*[F.floor(F.col("x")[k] / side) for k in range(width)])


def _between_cells(crowd: DataFrame, epsilon: float, width: int, witnesses: int = 4) -> DataFrame:
    """(u, v) rids of points that connect crowded cells (cell, rid, x), whose points are all core: cells of points closer than epsilon.

    First a few witnesses of each cell and those of the cells around it are compared. Then, between cells that are in
    different components yet, the points that are closer than epsilon to the other cell's box.
    """
    near = [s for s in itertools.product(range(-2, 3), repeat=width) if s > (0,) * width]
    boxes = cut(crowd.groupBy("cell").agg(F.min(RID).alias("u"), F.min_by("x", F.xxhash64(RID)).alias("w0"), *[F.min_by("x", F.xxhash64(RID, F.lit(k))).alias(f"w{k}") for k in range(1, witnesses)], *[f(F.col("x")[k]).alias(f"{n}{k}") for k in range(width) for n, f in (("low", F.min), ("high", F.max))]))
    around = F.explode(F.array(*[F.array(*[(F.col("cell")[k] + F.lit(d)).cast("long") for k, d in enumerate(shift)]) for shift in near]))
    names = [c for c in boxes.columns if c != "cell"]
    other = boxes.select(F.col("cell").alias("to"), *[F.col(c).alias(f"other_{c}") for c in names])
    gap = lambda k: F.greatest(F.lit(0.0), F.col(f"other_low{k}") - F.col(f"high{k}"), F.col(f"low{k}") - F.col(f"other_high{k}"))
    apart = sum((gap(k) * gap(k) for k in range(1, width)), gap(0) * gap(0))
    pairs = cut(boxes.withColumn("to", around).join(other, "to").where(apart < epsilon * epsilon))
    closest = F.least(*[squared_distance(F.col(f"w{i}"), F.col(f"other_w{j}")) for i in range(witnesses) for j in range(witnesses)])
    linked = pairs.where(closest < epsilon * epsilon).select("u", F.col("other_u").alias("v"))
    roots = connected(linked)
    side = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    open_pairs = pairs.join(side("u"), "u", "left").join(side("other_u"), "other_u", "left")
    open_pairs = cut(open_pairs.where(F.coalesce("root_u", "u") != F.coalesce("root_other_u", "other_u")))
    if open_pairs.isEmpty():
        return linked
    reach = lambda p: sum((F.greatest(F.lit(0.0), F.col(f"{p}low{k}") - F.col("x")[k], F.col("x")[k] - F.col(f"{p}high{k}")) ** 2 for k in range(1, width)), F.greatest(F.lit(0.0), F.col(f"{p}low0") - F.col("x")[0], F.col("x")[0] - F.col(f"{p}high0")) ** 2)
    mine = crowd.join(open_pairs, "cell").where(reach("other_") < epsilon * epsilon).select("u", "other_u", F.col("x").alias("xi"))
    theirs = crowd.withColumnRenamed("cell", "to").join(open_pairs, "to").where(reach("") < epsilon * epsilon).select("u", "other_u", F.col("x").alias("xj"))
    met = mine.join(theirs, ["u", "other_u"]).where(squared_distance(F.col("xi"), F.col("xj")) < epsilon * epsilon)
    return linked.unionByName(met.select("u", F.col("other_u").alias("v")).distinct())


def fit(table: DataFrame, epsilon: float = 0.5, min_pts: int = 5, standardize: bool = False) -> DBSCANModel:
    """Groups the rows of a table: a core point has min_pts or more points, itself among them, closer than epsilon.

    Groups are the components of core points closer than epsilon; another point closer than epsilon to
    a core point joins the group of the lowest number; the rest is noise.

    Up to three features, points lie in cells of side epsilon / sqrt(features), so all of a cell are closer than
    epsilon. A cell of min_pts points is crowded: its points are core and connected, and need not meet one by one. Only
    points of other cells, fewer than min_pts in each, meet those around them; crowded cells are connected as cells.
    """
    check_dbscan(epsilon, min_pts)
    scale = None
    if standardize:
        table, scale = z_scores(table)
    width = len(features(table))
    places, members = _distinct(vectors(table))
    by_cell = width <= 3
    side = epsilon / math.sqrt(max(width, 1)) * (1 - 1e-9)
    places = cut(places.withColumn("cell", _cell(side, width) if by_cell else F.array(F.col(RID))))
    check_matrix(places.count(), width)
    crowded = places.groupBy("cell").agg(F.sum("weight").alias("n"), F.min(RID).alias("rep")).where(F.col("n") >= min_pts).select("cell", "rep")
    # a crowded cell's points are one node, named by the least of them
    places = cut(places.join(crowded, "cell", "left").select("*", F.col("rep").isNotNull().alias("crowded")).withColumn("rep", F.coalesce("rep", RID)))
    sparse = places.where("NOT crowded") if by_cell else places
    pairs = cut(near_places(sparse.select(F.col(RID).alias("i"), "x"), places.select(F.col(RID).alias("j"), "x"), epsilon, width).select("i", "j"))
    near = pairs.join(places.select(F.col(RID).alias("j"), "weight", F.col("rep").alias("node")), "j")
    counted = near.groupBy("i").agg(F.sum("weight").alias("n")).where(F.col("n") >= min_pts).select("i")
    core = cut(counted.unionByName(places.where("crowded").select(F.col(RID).alias("i"))).distinct())
    to_core = near.join(core.withColumnRenamed("i", "j"), "j")
    edges = to_core.join(core, "i").select(F.col("i").alias("u"), F.col("node").alias("v"))
    if by_cell:
        edges = edges.unionByName(_between_cells(places.where("crowded").select("cell", RID, "x"), epsilon, width))
    nodes = cut(core.join(places.select(F.col(RID).alias("i"), F.col("rep").alias("node")), "i"))
    roots = nodes.select("node").distinct().join(connected(cut(edges.where("u <> v").distinct())), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    numbers = numbered(roots.select("root").distinct().orderBy("root"), "cluster").select("root", (F.col("cluster") + 1).cast("int").alias("cluster"))
    groups = cut(roots.join(numbers, "root").select("node", "cluster"))
    grouped = nodes.join(groups, "node").select("i", "cluster")
    border = to_core.join(core, "i", "left_anti").join(groups, "node").groupBy("i").agg(F.min("cluster").alias("cluster"))
    by_place = places.join(grouped.unionByName(border).withColumnRenamed("i", RID), RID, "left").select("x", F.coalesce("cluster", F.lit(0)).alias("cluster"))
    labelled = members.join(by_place, "x").select(F.col("own").alias(RID), "x", "cluster")
    return DBSCANModel(epsilon, min_pts, cut(labelled), scale)


def core_points(table: DataFrame, epsilon: float, min_pts: int) -> DataFrame:
    """(rid, neighbours, core) of each row."""
    counted = near_counts(vectors(table), epsilon, len(features(table))).where("n > 0")
    return counted.select(F.explode("rids").alias(RID), F.col("n").alias("neighbours"), (F.col("n") >= min_pts).alias("core"))


def estimate_epsilon(table: DataFrame, rows: int, min_pts: int = 5, sample_size: int = 500, standardize: bool = False) -> DataFrame:
    """(epsilon): the mean distance of a sample's points from their min_pts-th nearest point, themselves the first.
    The sample is every (rows / sample_size)-th rid from 0; fewer than two rows give 0.5."""
    spark = table.sparkSession
    if rows < 2:
        return spark.createDataFrame([(0.5,)], "epsilon double")
    if standardize:
        table, _ = z_scores(table)
    points, step, k = vectors(table), max(rows // sample_size, 1), min(min_pts, rows - 1)
    sample = points.where((F.col(RID) % step == 0) & (F.col(RID) / step < min(sample_size, rows)))
    return nearest(points, sample, k).where(F.col("rank") == k).agg(F.avg("dist").alias("epsilon"))


def epsilon_sweep(table: DataFrame, epsilons: list[float], min_pts: int = 5, standardize: bool = False) -> DataFrame:
    """(epsilon, k, noise, score): score is k * (1 - noise / n), 0 for fewer than two groups."""
    if standardize:
        table, _ = z_scores(table)
    rows = []
    for e in epsilons:
        found = fit(table, e, min_pts).points.agg(F.max("cluster"), F.count_if(F.col("cluster") == 0), F.count("*")).first()
        k, noise, n = found[0] or 0, found[1], found[2]
        rows.append((float(e), int(k), int(noise), float(k * (1 - noise / n)) if k >= 2 else 0.0))
    return table.sparkSession.createDataFrame(rows, "epsilon double, k int, noise long, score double")
