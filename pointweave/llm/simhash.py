"""SimHash fingerprints of word shingles, linked within a Hamming radius through vantage-point shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import cut, hot_join, parts, small
from pointweave.operators.components import Forest, connected

#: A-Z to a-z in UTF-8 bytes; other letters stay as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64 majority bits over the XXH64 of every word shingle, repeats included.

    Fewer words than a shingle needs: the whole sequence is one shingle. No words (or null): 0.
    """
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()  # bytes: splits at 20, 09-0D
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist())], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    set_in = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 4096):
        part = hashes[lo : lo + 4096].astype("<u8")
        set_in += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.nonzero(2 * set_in > len(hashes))[0].tolist())


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp long) for each row; the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def hamming(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Differing bits; of unsigned numbers, as bitwise_count takes the absolute value of signed ones."""
    return np.bitwise_count(a ^ b).astype(np.int64)


def link_within(points: np.ndarray, radius: int, forest: Forest, leaf: int = 256) -> None:
    """Unions every pair of points at distance <= radius, by a vantage-point tree over the points.

    A node's vantage point is one of its members; its median distance m splits the members. By the
    triangle inequality two linked points differ by at most radius in that distance, so the near
    child also searches with the members of [m, m + radius] and no other pair across the split can
    link. Where the members' distances are too close to split, pairs are compared in blocks.
    """
    stack = [np.arange(len(points))]
    while stack:
        own = stack.pop()
        if len(own) > leaf:
            d = hamming(points[own], points[own[len(own) // 2]])
            tied = own[2 * d <= radius]  # any two of these are within the radius of each other
            forest.union(tied, np.full(len(tied), tied[0]))
            m = int(np.median(d))
            near, far = own[d < m + radius], own[d >= m]
            if max(len(near), len(far)) < 0.9 * len(own):
                stack += [near, far]
                continue
        for lo in range(0, len(own), 512):
            rows = own[lo : lo + 512]
            i, j = np.nonzero(np.bitwise_count(points[rows][:, None] ^ points[own[lo:]][None, :]) <= radius)
            forest.union(rows[i], own[lo:][j])


def vantage(level: int) -> int:
    """The fixed vantage point of a level: odd multiples of the golden-ratio constant of 64-bit hashing."""
    return ((2 * level + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1)


def _levels(n: int, leaf: int) -> int:
    """Levels after which a shard has about leaf members, if a level keeps 0.61 of its members a side."""
    return max(0, int(np.ceil(np.log(max(1, n) / leaf) / np.log(1 / 0.61))))


def links(points: DataFrame, radius: int = 2, leaf: int | None = None, block: int = 1024) -> DataFrame:
    """(u, v) edges of a spanning forest of all pairs of points (fp, node) within the radius; fps are distinct.

    Level l splits all points at the median distance to vantage point l; its code gets a 1 at or
    beyond the median. A point closer than the median by radius or less also goes to the other
    side, so each linked pair meets in a shard. A level copies about a fifth of its points, so there are as
    few as the tasks allow: leaf, a shard's size, is up to 65,536 where there are points enough for several
    shards a task. A shard of more than two leaves is dealt out as pairs of blocks, so a task holds two
    blocks of about `block` points however many lie close together.
    """
    n = points.count()
    leaf = leaf or max(2048, min(65_536, n // (4 * parts(points.sparkSession, 0, 1))))
    levels = _levels(n, leaf)
    signed = [int(np.uint64(vantage(k)).view(np.int64)) for k in range(levels)]
    medians = list(points.agg(*(F.percentile_approx(F.bit_count(F.col("fp").bitwiseXOR(F.lit(v))), 0.5) for v in signed)).first()) if n and levels else []

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            own, code = np.arange(len(fps)), np.zeros(len(fps), np.int64)
            for k, m in enumerate(medians):
                d = hamming(fps[own], np.uint64(vantage(k)))
                both = (d < m) & (d >= m - radius)
                own, code = np.concatenate((own, own[both])), np.concatenate((2 * code + (d >= m), 2 * code[both] + 1))
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(fps[own].view(np.int64)), batch.column(1).take(pa.array(own))], names=["shard", "fp", "node"])

    members = points.select("fp", "node").mapInArrow(shard, "shard long, fp long, node long")
    crowded = small(cut(members.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > 2 * leaf).select("shard", F.ceil(F.col("n") / block).cast("int").alias("blocks"))))
    own = F.pmod(F.hash("fp"), F.col("blocks"))
    dealt = (
        members.join(crowded, "shard", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("shard", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp", "node")
        .repartition("shard", "a", "b")
    )

    def join(group: pa.Table) -> pa.Table:
        fps, nodes = group.column("fp").to_numpy().view(np.uint64), group.column("node").to_numpy()
        forest = Forest(len(fps))
        link_within(fps, radius, forest)
        moved = np.nonzero(forest.root != np.arange(len(fps)))[0]
        return pa.table({"u": nodes[moved], "v": nodes[forest.root[moved]]})

    return dealt.groupBy("shard", "a", "b").applyInArrow(join, "u long, v long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """(id, fp, component): the smallest id reachable over links between fingerprints, itself included.

    Copies meet in one fingerprint before any search. Null and wordless texts have fingerprint 0 and
    link like any other; repeated rows have a row each. Rows without an id take no part in links; they show
    their fingerprint's component, null if no row with an id has it.
    """
    rows = cut(fingerprints(df, id_col, text_col, words, seed))
    points = cut(rows.groupBy("fp").agg(F.min("id").alias("node"), F.count("*").alias("n")))
    roots = connected(cut(links(points.where("node IS NOT NULL"), radius)))
    classes = cut(points.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component"), "n"))
    return hot_join(rows, classes, "fp", rows.count()).select("id", "fp", "component")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 2) -> DataFrame:
    """df without the rows whose fingerprints link, through others too, to a row of a smaller id; rows without an id stay."""
    found = near_duplicates(df, id_col, text_col, words, radius=radius)
    return df.join(small(cut(found.where("id <> component").select(F.col("id").alias(id_col)).distinct())), id_col, "left_anti")
