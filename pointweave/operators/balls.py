"""Points in shards of near ones, with a ball tree in each: what a bound rules out is neither sent nor looked at."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.errors import check_width
from pointweave.operators.tables import RID
from pointweave.session import cut


class BallTree:
    """Nodes hold a slice of the reordered points, its mean and the largest distance from it."""

    def __init__(self, points: np.ndarray, leaf: int = 128):
        self.order = np.arange(len(points))
        self.nodes: list[tuple[int, int, np.ndarray, float, int, int]] = []
        self._grow(points, 0, len(points), leaf)
        self.points = points[self.order]

    def _grow(self, points: np.ndarray, lo: int, hi: int, leaf: int) -> int:
        own = points[self.order[lo:hi]]
        centre = own.mean(axis=0)
        off = np.einsum("ij,ij->i", own - centre, own - centre)
        at = len(self.nodes)
        self.nodes.append((lo, hi, centre, math.sqrt(off.max()), -1, -1))
        if hi - lo > leaf and off.max() > 0:
            a = own[off.argmax()]
            b = own[np.einsum("ij,ij->i", own - a, own - a).argmax()]
            mid = (hi - lo) // 2
            self.order[lo:hi] = self.order[lo:hi][np.argpartition(own @ (a - b), mid)]
            kids = self._grow(points, lo, lo + mid, leaf), self._grow(points, lo + mid, hi, leaf)
            self.nodes[at] = (*self.nodes[at][:4], *kids)
        return at

    def nearest(self, ids: np.ndarray, queries: np.ndarray, limits: np.ndarray, k: int, group: int = 32) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query numbers, distances, ids): for each query its k nearest points no farther than its limit, nearest first,
        ties to lower ids. Where there are fewer, distances are infinite.

        Nodes come off a heap by the least distance that their ball leaves open to the queries searched together. Where the
        balls of the leaves would leave open much of the points, as they do in many dimensions, all are looked at by products.
        """
        leaves = [n for n in self.nodes if n[4] < 0]
        centres = np.array([n[2] for n in leaves])
        home = np.concatenate([squared(queries[lo : lo + 512], centres).argmin(axis=1) for lo in range(0, len(queries), 512)]) if len(queries) else np.zeros(0, int)
        by = np.argsort(home, kind="stable")
        if len(self.points) > 1024 and self._open_share(leaves, centres, home, queries, limits, k) > 0.1:
            yield from self._scan(ids, queries, limits, k)
            return
        for at in range(0, len(by), group):
            own = by[at : at + group]
            yield own, *self._search(ids, queries[own], limits[own], k)

    def _open_share(self, leaves: list, centres: np.ndarray, home: np.ndarray, queries: np.ndarray, limits: np.ndarray, k: int, asked: int = 64) -> float:
        """The share of points in leaves that some queries' kth distances in their own leaf leave open. It chooses the way, not the result."""
        some = np.linspace(0, len(queries) - 1, min(asked, len(queries))).astype(int)
        sizes, radii = np.array([n[1] - n[0] for n in leaves]), np.array([n[3] for n in leaves])
        share = 0.0
        for q in some:
            lo, hi = leaves[home[q]][:2]
            d = np.sqrt(squared(queries[q : q + 1], self.points[lo:hi])[0])
            within = min(limits[q], np.partition(d, k - 1)[k - 1] if k <= len(d) else np.inf)
            share += sizes[np.linalg.norm(centres - queries[q], axis=1) - radii <= within].sum() / len(self.points)
        return share / max(1, len(some))

    def _scan(self, ids: np.ndarray, queries: np.ndarray, limits: np.ndarray, k: int, rows: int = 256, columns: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All points, in blocks: products bound the squared distances from below, and those that may be near enough are
        taken from differences, as everywhere, so results and ties are the same."""
        width = self.points.shape[1]
        # about the mean, as lengths add to rounding; what one product of `width` terms can be off by, and more
        mean = self.points.mean(axis=0)
        points, asked = self.points - mean, queries - mean
        lengths, own_lengths = np.einsum("ij,ij->i", points, points), np.einsum("ij,ij->i", asked, asked)
        spans = (np.abs(self.points).max(initial=0) + np.abs(queries).max(axis=1, initial=0) + np.abs(mean).max(initial=0)) ** 2 * width
        slack = (width + 8) * 1e-15 * (2 * (own_lengths + lengths.max(initial=0)) + spans)
        transposed = np.ascontiguousarray(points.T) * -2
        names = ids[self.order]
        for lo in range(0, len(queries), rows):
            own = np.arange(lo, min(lo + rows, len(queries)))
            n = len(own)
            best, best_ids, kth = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max), limits[own].astype(float).copy()
            for at in range(0, len(points), columns):
                low = asked[own] @ transposed[:, at : at + columns]
                low += lengths[at : at + columns]
                most = kth**2 * (1 + 1e-12) - own_lengths[own] + slack[own]
                if not np.isfinite(most).all() and k <= low.shape[1]:
                    most = np.minimum(most, np.partition(low, k - 1, axis=1)[:, k - 1] + 2 * slack[own])
                hits = np.flatnonzero(~(low > most[:, None]))  # of one dimension, much faster than rows and columns
                if not len(hits):
                    continue
                row, column = np.divmod(hits, low.shape[1])
                d = np.empty(len(row))
                for part in range(0, len(row), 65536):
                    off = queries[own[row[part : part + 65536]]] - self.points[at + column[part : part + 65536]]
                    d[part : part + 65536] = np.sqrt(np.einsum("ijk,ijk->ij", off[None], off[None])[0])  # as in squared, to the last bit
                near = d <= kth[row]
                row, d, found = row[near], d[near], names[at + column[near]]
                # with the best so far, the first k of each row by distance and id
                there = np.flatnonzero(np.bincount(row, minlength=n))
                old = np.isfinite(best[there])
                row = np.concatenate((row, np.repeat(there, old.sum(axis=1))))
                d, found = np.concatenate((d, best[there][old])), np.concatenate((found, best_ids[there][old]))
                order = np.lexsort((found, d, row))
                row, d, found = row[order], d[order], found[order]
                first = np.searchsorted(row, row)
                rank = np.arange(len(row)) - first
                kept = rank < k
                best[row[kept], rank[kept]], best_ids[row[kept], rank[kept]] = d[kept], found[kept]
                kth = np.minimum(kth, best[:, -1])
            yield own, best, best_ids

    def _search(self, ids: np.ndarray, queries: np.ndarray, limits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(queries)
        best, best_ids, kth = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max), limits.astype(float).copy()

        def open_from(node: int, own: np.ndarray) -> np.ndarray:
            _, _, centre, radius, _, _ = self.nodes[node]
            return lowest_distance(queries[own], centre, radius)

        heap, pushed = [(0.0, 0, 0, np.arange(n))], 0
        while heap:
            _, _, node, own = heapq.heappop(heap)
            own = own[open_from(node, own) <= kth[own]]
            if not len(own):
                continue
            lo, hi, _, _, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    least = open_from(child, own)
                    if len(going := own[least <= kth[own]]):
                        pushed += 1
                        heapq.heappush(heap, (float(least.min()), pushed, child, going))
                continue
            for at in range(lo, hi, 512):
                to = min(hi, at + 512)
                found, d = ids[self.order[at:to]], np.sqrt(squared(queries[own], self.points[at:to]))
                d[d > kth[own][:, None]] = np.inf
                some = np.isfinite(d).any(axis=1)
                rows = own[some]
                if len(rows):
                    both = np.concatenate((best[rows], d[some]), axis=1)
                    names = np.concatenate((best_ids[rows], np.broadcast_to(found, (len(rows), to - at))), axis=1)
                    order = np.lexsort((names, both), axis=-1)[:, :k]
                    best[rows], best_ids[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
                    kth[rows] = np.minimum(limits[rows], best[rows, -1])
        return best, best_ids


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows of a from rows of b, from differences, so equal points are at 0."""
    out = np.empty((len(a), len(b)))
    step = max(1, 2_000_000 // max(1, b.size))
    for lo in range(0, len(a), step):
        d = a[lo : lo + step, None, :] - b[None, :, :]
        out[lo : lo + step] = np.einsum("ijk,ijk->ij", d, d)
    return out


def lowest_distance(queries: np.ndarray, centre: np.ndarray, radius: float) -> np.ndarray:
    """What a distance from a ball's points can be at least, rounding allowed for."""
    off = np.linalg.norm(queries - centre, axis=1)
    return off - radius - 1e-9 * (off + radius)


def rows_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Arrays of one length as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def own_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1) if len(centres) > 1 else np.zeros(len(x), np.int64)


def spread_centres(sample: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """n centres at most of a sample's distinct rows, by a few rounds of means. They place points and change no result."""
    x = np.unique(sample, axis=0)
    centres = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)]
    for _ in range(rounds if len(x) > n > 1 else 0):
        own = own_centre(x, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


@dataclass(frozen=True)
class NeighbourIndex:
    """Points (rid, x) in shards; for each centre its ball, and the numbers of its shards."""

    held: DataFrame  # (rid, x, shard)
    centres: np.ndarray
    radii: np.ndarray
    first: np.ndarray  # of each centre's first shard, and of all
    rows: int

    def nearest(self, queries: DataFrame, k: int, block_rows: int = 65_536) -> DataFrame:
        """(query, rank from 1, rid, dist): the k nearest points of each query (rid, x), ties to lower rids.

        A query goes to a shard of its nearest centre; with the kth distance there as its limit it goes on to the shards
        whose ball reaches within it. Queries go in blocks, and a shard is sent to the blocks that ask it, so large shards
        and blocks send little where balls rule out nothing.
        """
        centres, radii, first = self.centres, self.radii, self.first
        wide = "query long, q array<double>, block int, at int, lim double"

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    q, ids = rows_of(batch.column(1)), batch.column(0).to_numpy()
                    check_width(q.shape[1], centres.shape[1])
                    own = own_centre(q, centres)
                    at = first[own] + ids % np.maximum(first[own + 1] - first[own], 1)
                    columns = [batch.column(0), batch.column(1), pa.array(at.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(np.full(len(q), np.inf))]
                    yield pa.RecordBatch.from_arrays(columns, names=["query", "q", "block", "at", "lim"])

        asked = queries.select(RID, "x").mapInArrow(place, wide)
        shards, rows = int(first[-1]), queries.count()
        blocks = max(1, math.ceil(rows / block_rows), min(math.ceil(32 / max(1, shards)), math.ceil(rows / 2048)))
        home = cut(self._meet(asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")), k))

        def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["query", "q", "block", "lim", "shards"]
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    q, found = rows_of(part.column("q")), part.column("found")
                    lim = np.array([x[-1]["dist"] if len(x) == k else np.inf for x in found.to_pylist()])
                    off = np.sqrt(squared(q, centres))
                    least = off - radii[None, :] - 1e-9 * (off + np.maximum(radii, 0)[None, :])
                    row, centre = np.nonzero((least <= lim[:, None]) & (radii >= 0)[None, :])
                    sizes = first[centre + 1] - first[centre]
                    row = np.repeat(row, sizes)
                    shard = np.repeat(first[centre], sizes) + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    other = shard != part.column("at").to_numpy()[row]
                    row, shard = row[other], shard[other]
                    some, counts = np.unique(row, return_counts=True)
                    take = pa.array(some)
                    asks = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), pa.array(shard.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([part.column("query").take(take), part.column("q").take(take), part.column("block").take(take), pa.array(lim[some]), asks], names=names)

        found = home.select(F.col("query"), F.explode("found").alias("f")).select("query", F.col("f.rid").alias(RID), F.col("f.dist").alias("dist"))
        if int(first[-1]) > 1:
            asking = cut(home.mapInArrow(onward, "query long, q array<double>, block int, lim double, shards array<int>"))
            beyond = self._meet(asking.select("query", "q", "block", F.explode("shards").alias("at"), "lim"), k).select("query", F.explode("found").alias("f"))
            found = found.unionByName(beyond.select("query", F.col("f.rid").alias(RID), F.col("f.dist").alias("dist")))
        ranked = Window.partitionBy("query").orderBy("dist", RID)
        return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query", "rank", RID, "dist")

    def _meet(self, asked: DataFrame, k: int) -> DataFrame:
        """(query, q, block, at, found): the k nearest of the shard `at` within the limit of each query."""
        schema = "query long, q array<double>, block int, at int, found array<struct<rid:bigint,dist:double>>"
        wanted = asked.select(F.col("at").alias("shard"), F.col("block").alias("of_block")).distinct()

        def meet(points: pa.Table, asks: pa.Table) -> pa.Table:
            names = ["query", "q", "block", "at"]
            best, best_ids = np.full((asks.num_rows, k), np.inf), np.zeros((asks.num_rows, k), np.int64)
            if points.num_rows and asks.num_rows:
                ids = points.column(RID).to_numpy()
                for own, d, names_of in BallTree(rows_of(points.column("x"))).nearest(ids, rows_of(asks.column("q")), asks.column("lim").to_numpy(), k):
                    best[own], best_ids[own] = d, names_of
            there = np.isfinite(best)
            found = pa.StructArray.from_arrays([pa.array(best_ids[there]), pa.array(best[there])], names=["rid", "dist"])
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(there.sum(axis=1)))).astype(np.int32), found)
            return pa.table([*[asks.column(c) for c in names], lists], names=[*names, "found"])

        sent = self.held.join(wanted, "shard")
        return sent.groupBy("shard", "of_block").cogroup(asked.groupBy("at", "block")).applyInArrow(meet, schema)


def index(points: DataFrame, shard_rows: int = 65_536, most_centres: int = 256, sample: int = 4096) -> NeighbourIndex:
    """An index of points (rid, x), to be built once and asked often; kept in a checkpoint.

    Centres come from `sample` rows, taken by a hash of the rid; the driver holds a ball and a count for each.
    Points of one centre are parted by a hash, so that no shard has more than about shard_rows of them.
    """
    points = points.select(RID, "x")
    rows = points.count()
    chance = F.pmod(F.xxhash64(RID, F.lit("centre")), F.lit(1 << 30)) / float(1 << 30)
    some = points.where(chance <= min(1.0, sample / max(1, rows))).select("x").limit(2 * sample).toArrow().column("x") if rows else None
    if some is not None and not len(some):
        some = points.select("x").limit(1).toArrow().column("x")
    centres = spread_centres(rows_of(some), min(most_centres, math.ceil(rows / shard_rows))) if rows else np.zeros((1, 0))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = rows_of(batch.column(1))
                check_width(x.shape[1], centres.shape[1])
                own = own_centre(x, centres)
                off = np.linalg.norm(x - centres[own], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(off)], names=[RID, "x", "centre", "off"])

    placed = cut(points.mapInArrow(place, "rid long, x array<double>, centre int, off double"))
    shards, radii = np.zeros(len(centres), np.int64), np.full(len(centres), -np.inf)
    for r in placed.groupBy("centre").agg(F.count("*").alias("n"), F.max("off").alias("radius")).collect():
        shards[r["centre"]], radii[r["centre"]] = math.ceil(r["n"] / shard_rows), r["radius"]
    first = np.concatenate(([0], np.cumsum(shards)))
    pick = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("centre") + 1)
    shard = (pick(first[:-1]) + F.pmod(F.xxhash64(RID), F.greatest(F.lit(1), pick(shards)))).cast("int")
    return NeighbourIndex(placed.select(RID, "x", shard.alias("shard")), centres, radii, first, rows)
