"""Connected components of a table of edges, as rounds of joins; nothing is gathered on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.session import cut

#: So many edges, 16 bytes each, fit one task; more go through rounds of joins.
ONE_TASK = 500_000


class Forest:
    """Union-find over 0..n-1 whose unions take arrays of pairs; a root is the least of its tree."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def union(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


def _contracted(batches: Iterator[pa.RecordBatch], most: int = ONE_TASK) -> Iterator[pa.RecordBatch]:
    """Edges of a task as a star (node, least node of its tree); of more than `most`, as several."""
    held: list[np.ndarray] = []
    rows = 0

    def star() -> pa.RecordBatch:
        u, v = np.concatenate(held, axis=1)
        nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        forest = Forest(len(nodes))
        forest.union(at[: len(u)], at[len(u) :])
        moved = np.flatnonzero(forest.root != np.arange(len(nodes)))
        held[:] = [np.stack((nodes[moved], nodes[forest.root[moved]]))]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["u", "v"])

    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([c.to_numpy() for c in batch.columns]))
            rows += batch.num_rows
            if rows >= most:
                found = star()
                rows = found.num_rows
                if rows > most // 2:
                    yield found
                    held, rows = [], 0
    if held:
        yield star()


def _star(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").mapInArrow(_contracted, "u long, v long")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(lowest.withColumnRenamed("m", "v")).where("u <> v").distinct()


def connected(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) for every node that an edge (u, v) touches, but the roots; root: the smallest reachable node.

    Each task first reduces its edges to stars. If what is left fits one task (one_task edges), that task
    ends it; else large and small stars alternate until it does or nothing moves. Minima combine before they
    are shuffled, so a node with very many edges costs its task no more than any other; each round ends in
    a checkpoint.
    """
    now = cut(_star(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))))
    state = _state(now)
    while state[0] > one_task:
        now = cut(_small_star(_large_star(now)))
        before, state = state, _state(now)
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    whole = now.repartition(1).mapInArrow(lambda batches: _contracted(batches, 1 << 62), "u long, v long")
    return cut(whole).select(F.col("u").alias("node"), F.col("v").alias("root"))
