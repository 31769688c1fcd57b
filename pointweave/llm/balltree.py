"""Exact top-k by inner product: a ball tree per shard of near vectors, searched best bound first.

Shards hold vectors near one centre. A query meets the shard it lies in; its kth score there is a floor,
and it goes on only to shards whose ball can hold a better one. Work and traffic follow the pairs of
shards and queries that no bound rules out.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.llm.common import cut
from pointweave.operators.balls import BallTree, own_centre, spread_centres

NO_ID = np.iinfo(np.int64).max
LEAST_LONG, MOST_LONG = -(2**63), 2**63 - 1


def _best(scores: np.ndarray, ids: np.ndarray, k: int, repeated: bool) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row's scores, ties to smaller ids; of an id that is there more than once, the best."""
    order = np.lexsort((ids, -scores), axis=-1)
    if repeated:
        seen = np.take_along_axis(ids, order, 1)
        by = np.argsort(seen, axis=1, kind="stable")
        sorted_ids = np.take_along_axis(seen, by, 1)
        again = np.zeros(ids.shape, bool)
        np.put_along_axis(again, by[:, 1:], sorted_ids[:, 1:] == sorted_ids[:, :-1], 1)
        again &= seen != NO_ID
        order = np.take_along_axis(order, np.argsort(again, axis=1, kind="stable"), 1)
        again.sort(axis=1)
        scores, ids = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
        return np.where(again, -np.inf, scores)[:, :k], np.where(again, NO_ID, ids)[:, :k]
    order = order[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def search(tree: BallTree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (scores, ids) of each query over the tree's points, ties to smaller ids; -inf where there are fewer.

    Nodes come off a heap by their inner-product upper bound q.c + |q| r, the largest over the
    queries searched together. A node is opened for the queries whose bound reaches their kth score
    so far (or their floor, a kth score known from elsewhere); the others skip it.
    """
    n = len(queries)
    best, best_ids, kth = np.full((n, k), -np.inf), np.full((n, k), NO_ID), floors.copy()
    norms = np.linalg.norm(queries, axis=1)
    repeated = len(np.unique(ids)) < len(ids)

    def bound(node: int, own: np.ndarray) -> np.ndarray:
        _, _, centre, radius, _, _ = tree.nodes[node]
        return reach(queries[own] @ centre, norms[own], float(np.linalg.norm(centre)), radius)

    everyone = np.arange(n)
    heap, pushed = [(-math.inf, 0, 0, everyone)], 0
    while heap:
        _, _, node, own = heapq.heappop(heap)
        own = own[bound(node, own) >= kth[own]]
        if not len(own):
            continue
        lo, hi, _, _, left, right = tree.nodes[node]
        if left >= 0:
            for child in (left, right):
                above = bound(child, own)
                if len(open_to := own[above >= kth[own]]):
                    pushed += 1
                    heapq.heappush(heap, (-above.max(), pushed, child, open_to))
            continue
        for at in range(lo, hi, 1024):
            to = min(hi, at + 1024)
            found = ids[tree.order[at:to]]
            scores = queries[own] @ tree.points[at:to].T
            scores[query_ids[own][:, None] == found[None, :]] = -np.inf
            some = scores.max(axis=1) >= kth[own]
            rows = own[some]
            if len(rows):
                both = np.concatenate((best[rows], scores[some]), axis=1)
                both_ids = np.concatenate((best_ids[rows], np.broadcast_to(found, (len(rows), to - at))), axis=1)
                both_ids[np.isneginf(both)] = NO_ID
                best[rows], best_ids[rows] = _best(both, both_ids, k, repeated)
                kth[rows] = np.maximum(floors[rows], best[rows, -1])
    return best, best_ids


def reach(dot: np.ndarray, norm: np.ndarray, of_centre: float | np.ndarray, radius: float | np.ndarray) -> np.ndarray:
    """What an inner product with a point of a ball can be at most, rounding allowed for."""
    above = dot + norm * radius
    return above + 1e-9 * (np.abs(above) + norm * (of_centre + radius)) + 1e-9


def _vectors(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), dim)


def answers(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, k: int, group: int = 64) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query, (scores, ids) of what may be among its k best, scores as whole numbers of 64 bits.

    Doubles are exact for vectors whose products can't reach 2^53 together; they go through the tree. With a larger
    one on either side whole numbers of any size are multiplied. Scores beyond 64 bits are the ends of that range.
    """
    dim = points.shape[1]
    most = math.isqrt(2**53 // max(1, dim)) - 1
    small, plain = (np.abs(x).max(axis=1, initial=0) <= most for x in (points, queries))
    out: list[tuple[list, list]] = [([], []) for _ in queries]
    at, asked = np.flatnonzero(small), np.flatnonzero(plain)
    if len(at) and len(asked):
        tree = BallTree(points[at])
        leaves = np.array([node[2] for node in tree.nodes if node[4] < 0])
        near = asked[np.argsort((queries[asked] @ leaves.T).argmax(axis=1), kind="stable")]
        for lo in range(0, len(near), group):  # queries that start at the same leaf are searched together
            own = near[lo : lo + group]
            scores, found = search(tree, ids[at], queries[own], query_ids[own], floors[own], k)
            keep = (scores > -np.inf) & (scores >= floors[own][:, None])
            for q, s, f, good in zip(own.tolist(), scores, found, keep):
                out[q][0].extend(s[good].astype(np.int64).tolist())
                out[q][1].extend(f[good].tolist())
    if not (small.all() and plain.all()):
        whole = lambda x: [[int(v) for v in r] for r in x.tolist()]
        for q in range(len(queries)):
            rest = np.arange(len(points)) if not plain[q] else np.flatnonzero(~small)
            asking = whole(queries[q : q + 1])[0]
            scored: dict[int, int] = dict(zip(out[q][1], out[q][0]))
            for lo in range(0, len(rest), 1024):
                part = rest[lo : lo + 1024]
                for i, v in zip(ids[part].tolist(), whole(points[part])):
                    if i != query_ids[q]:
                        s = max(LEAST_LONG, min(MOST_LONG, sum(a * b for a, b in zip(asking, v))))
                        scored[i] = max(s, scored.get(i, LEAST_LONG))
                if len(scored) > 4096:
                    scored = dict(sorted(scored.items(), key=lambda x: (-x[1], x[0]))[:k])
            first = sorted(scored.items(), key=lambda x: (-x[1], x[0]))[:k]
            out[q] = ([s for _, s in first], [i for i, _ in first])
    return [(np.array(s, np.int64), np.array(i, np.int64)) for s, i in out]


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int = 64) -> DataFrame:
    """(vec_id, q, dim): floor(scale * x) of each component as a double. Rows whose vector is null or holds
    a null or non-finite component, or whose id is null, are left out."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    scaled = F.transform("x", lambda v: v * F.lit(float(scale)))
    # from 2^52 on a double has no fraction, and beyond a long there is no floor
    floors = F.transform(scaled, lambda v: F.when(F.abs(v) < float(2**52), F.floor(v).cast("double")).otherwise(v))
    return (
        df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
        .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~bad)
        .select("vec_id", floors.alias("q"), F.size("x").alias("dim"))
    )


def _centres(vectors: DataFrame, dim: int, rows: int, n: int, sample: int = 4096) -> np.ndarray:
    """n centres: a few rounds of means over a sample of distinct vectors, taken by a hash. They place vectors and
    change no result."""
    chance = F.pmod(F.xxhash64("vec_id", "q"), F.lit(1 << 30)) / float(1 << 30)
    some = vectors.where((F.col("dim") == dim) & (chance <= min(1.0, sample / rows))).select("q").distinct().limit(2 * sample).toArrow()
    return spread_centres(_vectors(some.column("q"), dim) if some.num_rows else np.zeros((1, dim)), n)


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, query_mod: int = 20, shard_rows: int = 16384, block_rows: int = 8192, most_centres: int = 256) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): for ids divisible by query_mod, the k best other ids.

    An id is one item: equal rows count once, and of an id with several vectors the best score counts, on
    both sides. Vectors of different lengths never meet; empty ones have a score of 0 with each other.
    Scores beyond 64 bits are given as the ends of that range.

    Vectors lie in shards of about shard_rows: those nearest one of most_centres centres at most, parted by a
    hash. First a shard answers the queries that lie in it. A query then goes to the shards whose ball, centre
    and radius, can hold a score of its kth so far; those get it in blocks of about block_rows, and a shard is
    sent to the blocks that ask it. The driver holds a ball and a count for each centre.
    """
    raw = quantised(df, id_col, vector_col)
    # vectors of lengths beyond the eight commonest are placed by hash alone, without a bound
    lengths = raw.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % query_mod == 0).alias("asking"))
    usual = lengths.orderBy(F.desc("n"), "dim").limit(8).collect()
    total, asking = lengths.agg(F.sum("n"), F.sum("asking")).first()
    centres = {r["dim"]: _centres(raw, r["dim"], r["n"], min(most_centres, math.ceil(r["n"] / shard_rows))) for r in usual if r["dim"]}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            own, off = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in set(dims.tolist()) & centres.keys():
                at = np.flatnonzero(dims == dim)
                x = _vectors(batch.column("q").take(pa.array(at)), dim)
                own[at] = own_centre(x, centres[dim])
                off[at] = np.linalg.norm(x - centres[dim][own[at]], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(off)], names=["vec_id", "q", "dim", "centre", "off"])

    placed = cut(raw.distinct().mapInArrow(place, "vec_id long, q array<double>, dim int, centre int, off double"))
    shards_of = {d: np.ones(len(c), int) for d, c in centres.items()}
    radius = {d: np.full(len(c), -np.inf) for d, c in centres.items()}
    for r in placed.where(F.col("dim").isin(*centres)).groupBy("dim", "centre").agg(F.count("*").alias("n"), F.max("off").alias("radius")).collect() if centres else ():
        shards_of[r["dim"]][r["centre"]], radius[r["dim"]][r["centre"]] = math.ceil(r["n"] / shard_rows), r["radius"]
    numbers = {d: np.concatenate(([0], np.cumsum(n))) for d, n in shards_of.items()}  # of each centre's first shard
    rare = math.ceil((total or 0) / shard_rows) or 1
    shards, before = F.lit(rare), F.lit(0)
    for d in centres:
        pick = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("centre") + 1)
        shards, before = F.when(F.col("dim") == d, pick(shards_of[d])).otherwise(shards), F.when(F.col("dim") == d, pick(numbers[d][:-1])).otherwise(before)
    held = placed.select("vec_id", "q", "dim", (before + F.pmod(F.xxhash64("vec_id", "q"), shards)).cast("int").alias("shard"))
    each = max(1, int(block_rows / (shard_rows * max(asking or 0, 1) / max(total or 0, 1))))  # shards whose queries are a block

    schema = "query_id long, q array<double>, dim int, shard int, floor long, ids array<long>, scores array<long>"

    def first(points: pa.Table) -> pa.Table:
        dim = points.column("dim")[0].as_py()
        x, ids = _vectors(points.column("q"), dim), points.column("vec_id").to_numpy()
        asks = np.flatnonzero(ids % query_mod == 0)
        found = answers(x, ids, x[asks], ids[asks], np.full(len(asks), -np.inf), k)
        own = points.take(pa.array(asks, pa.int64()))
        floors = [int(s[-1]) if len(s) == k else None for s, _ in found]
        lists = [pa.array([v[i].tolist() for v in found], pa.list_(pa.int64())) for i in (1, 0)]
        return pa.table([*[own.column(c) for c in ("vec_id", "q", "dim", "shard")], pa.array(floors, pa.int64()), *lists], names=[x.split()[0] for x in schema.split(", ")])

    home = cut(held.groupBy("dim", "shard").applyInArrow(first, schema))
    wide = "query_id long, asked array<double>, of_dim int, in_block int, floor long, in_shard int"

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(batch: pa.RecordBatch, rows: list[np.ndarray], to: list[np.ndarray]) -> pa.RecordBatch:
            at = pa.array(np.concatenate(rows))
            block = pa.array((batch.column("shard").to_numpy() // each).astype(np.int32))
            columns = [batch.column(c).take(at) for c in ("query_id", "q", "dim")] + [block.take(at), batch.column("floor").take(at), pa.array(np.concatenate(to).astype(np.int32))]
            return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in wide.split(", ")])

        for batch in batches:
            rows, to, n = [], [], 0
            for at, (dim, own, floor) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("dim", "shard", "floor")))):
                if dim in centres:
                    q, lowest = _vectors(batch.column("q").slice(at, 1), dim)[0], -math.inf if floor is None else float(floor)
                    above = reach(centres[dim] @ q, np.linalg.norm(q), np.linalg.norm(centres[dim], axis=1), np.maximum(radius[dim], 0))
                    open_to = np.flatnonzero(~(above < lowest) & (radius[dim] >= 0))
                    found = np.concatenate([np.zeros(0, int), *[np.arange(numbers[dim][c], numbers[dim][c + 1]) for c in open_to]])
                else:
                    found = np.arange(rare)
                found = found[found != own]
                rows.append(np.full(len(found), at))
                to.append(found)
                n += len(found)
                if n >= 4096:
                    yield send(batch, rows, to)
                    rows, to, n = [], [], 0
            if n:
                yield send(batch, rows, to)

    asks = cut(home.select("query_id", "q", "dim", "shard", "floor").mapInArrow(onward, wide))
    wanted = asks.select(F.col("of_dim").alias("dim"), F.col("in_shard").alias("shard"), F.col("in_block").alias("block")).distinct()
    sent = held.join(wanted, ["dim", "shard"])

    def meet(points: pa.Table, queries: pa.Table) -> pa.Table:
        names, kinds = ("query_id", "vec_id", "score"), (pa.int64(),) * 3
        if not points.num_rows or not queries.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=list(names))
        dim = points.column("dim")[0].as_py()
        floors = np.array([-np.inf if f is None or abs(f) >= 2**53 else float(f) for f in queries.column("floor").to_pylist()])
        query_ids = queries.column("query_id").to_numpy()
        found = answers(_vectors(points.column("q"), dim), points.column("vec_id").to_numpy(), _vectors(queries.column("asked"), dim), query_ids, floors, k)
        return pa.table([pa.array(np.repeat(query_ids, [len(s) for s, _ in found])), pa.array(np.concatenate([i for _, i in found])), pa.array(np.concatenate([s for s, _ in found]))], names=list(names))

    beyond = sent.groupBy("dim", "shard", "block").cogroup(asks.groupBy("of_dim", "in_shard", "in_block")).applyInArrow(meet, "query_id long, vec_id long, score long")
    near = home.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("f")).select("query_id", F.col("f.ids").alias("vec_id"), F.col("f.scores").alias("score"))
    best = near.unionByName(beyond).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
