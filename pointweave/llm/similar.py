"""Texts whose sets of word shingles are alike: every pair of at least a Jaccard similarity.

Candidates are documents that the vantage-point search finds close, and documents that share a shingle
of both sets' prefixes; the latter misses no pair. What candidates connect is a family. A family's texts
meet in one task, or in pairs of blocks if there are many, and whole sets are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.llm import simhash
from pointweave.llm.common import cut, hot_join, mixed, small
from pointweave.llm.notes import bucket_of, low4, notes_of, pack, runs, unpack
from pointweave.operators.components import Forest, connected

#: Odd multipliers, one for each word of a shingle.
ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63)]


class Words(dict):
    """XXH64 of words, kept up to a number of them."""

    def __init__(self, keep: int = 50_000):
        self.keep = keep

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word, 42)
        if len(self) < self.keep:
            self[word] = found
        return found


def all_shingles(text: str | None, words: int, known: Words) -> np.ndarray:
    """A 64-bit hash of each word shingle, in order; of fewer words than a shingle needs, one of them all; none of no words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(simhash.LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    width = min(words, len(own))
    n = len(own) - width + 1
    with np.errstate(over="ignore"):
        total = np.full(n, np.uint64(width))
        for k in range(width):
            total += own[k : k + n] * (ODD[k % 5] + np.uint64(2 * (k // 5)))
    return mixed(total)


def shingles(text: str | None, words: int = 5, known: Words | None = None) -> np.ndarray:
    """The distinct hashes of the word shingles, sorted."""
    return np.unique(all_shingles(text, words, Words(0) if known is None else known))


def point_of(shingled: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingled.tobytes(), 0)).view(np.int64))


def needed(n: int, least: float) -> int:
    """Members that a set of n shares with any set at least so similar."""
    return math.ceil(least * n - 1e-9)


def named(texts: DataFrame, words: int) -> DataFrame:
    """(id, point, fp) of rows (id, text): each row's set's name and fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            points, fps = [], []
            for text in batch.column(1):
                each = all_shingles(text.as_py(), words, known)
                points.append(point_of(np.unique(each)))
                fps.append(simhash.majority(each) if len(each) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(points, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["id", "point", "fp"])

    return texts.mapInArrow(run, "id long, point long, fp long")


def prefix(shingled: np.ndarray, rows: np.ndarray, least: float) -> np.ndarray:
    """The rarest of a set's shingles that others have too; rows says how many rows hold each.

    Two sets at least so similar share a shingle of both prefixes, whatever the order of shingles, as long as it is one
    order for all: here by those numbers, then by hash. What one row alone has takes its place but meets nothing.
    """
    head = np.argsort(rows, kind="stable")[: len(shingled) - needed(len(shingled), least) + 1]
    return shingled[head[rows[head] > 1]]


def _chains(h: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by h, whether a row continues its predecessor's h)."""
    by = np.lexsort((node, h))
    return by, np.concatenate(([False], h[by][1:] == h[by][:-1]))[: len(by)]


def meetings(texts: DataFrame, words: int, least: float, block_bytes: int = 4_000_000, bucket_bytes: int = 4_000_000) -> DataFrame:
    """(u, v): edges that connect all points of rows (id, text) whose prefixes share a shingle.

    Blocks of texts tell buckets the shingles they hold, four bytes each, and are told of each how many rows hold it: all
    of them, so prefixes are of rare shingles at any size. Then a task connects its own entries of a shingle and sends
    one of each; the tasks' ones meet, sorted, and each is connected with the one before it. So a very common
    shingle is no large group anywhere.
    """
    spark = texts.sparkSession
    texts = texts.where("id IS NOT NULL").withColumn("tag", F.xxhash64("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    floor = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks, buckets = (max(floor, math.ceil(total / n)) for n in (block_bytes, bucket_bytes))
    base = texts.select(F.pmod(F.xxhash64("id", "tag"), F.lit(blocks)).alias("block"), "text").repartition(blocks, "block")
    note = "block long, bucket long, data binary"

    def held(column: pa.ChunkedArray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[np.ndarray]]:
        """(sets, distinct shingles, rows that hold each, places of these by bucket) of a block."""
        known = Words()
        sets = [shingles(t.as_py(), words, known) for t in column]
        found, rows = np.unique(np.concatenate(sets), return_counts=True)
        bucket = bucket_of(found, buckets)
        return sets, found, rows, runs(bucket, np.argsort(bucket, kind="stable"))

    def announce(group: pa.Table) -> pa.Table:
        _, found, rows, by = held(group.column("text"))
        number = group.column("block")[0].as_py()
        return notes_of([(number, int(bucket_of(found[at[:1]], buckets)[0]), pack(low4(found[at]), np.minimum(rows[at], 255).astype(np.uint8))) for at in by])

    def count(blobs: pa.Table) -> pa.Table:
        told = [(b, unpack(d, "<u4", "u1")) for b, d in zip(blobs.column("block").to_pylist(), blobs.column("data").to_pylist())]
        keys, rows = (np.concatenate([x[k] for _, x in told]) for k in (0, 1))
        _, at = np.unique(keys, return_inverse=True)
        sums = np.minimum(np.bincount(at, weights=rows), 255).astype(np.uint8)[at]
        bucket = blobs.column("bucket")[0].as_py()
        parts = np.split(sums, np.cumsum([len(x[0]) for _, x in told])[:-1])
        return notes_of([(b, bucket, pack(x)) for (b, _), x in zip(told, parts) if (x > 1).any()])

    answers = base.groupBy("block").applyInArrow(announce, note).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(count, note)
    answers = answers.select(F.col("block").alias("of"), "bucket", "data").repartition(blocks, "of")

    def meet(group: pa.Table, notes: pa.Table) -> pa.Table:
        entries = []
        if group.num_rows:
            sets, found, _, by = held(group.column("text"))
            rows, told = np.ones(len(found), np.uint8), dict(zip(notes.column("bucket").to_pylist(), notes.column("data").to_pylist()))
            for at in by:
                if (data := told.get(int(bucket_of(found[at[:1]], buckets)[0]))) is not None:
                    rows[at] = unpack(data, "u1")[0]
            entries = [(prefix(s, rows[np.searchsorted(found, s)], least).view(np.int64), np.int64(point_of(s))) for s in sets]
        return pa.Table.from_batches([_combined(entries)])

    return _met(base.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(meet, ENTRY))


#: An entry (h, node), or an edge (node, other) that a task has found among its own.
ENTRY = "h long, node long, other long"


def _combined(held: list[tuple[np.ndarray, np.int64]]) -> pa.RecordBatch:
    """Entries of one task: one of each h, and edges to connect the others with it."""
    h = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in held)])
    node = np.repeat(np.array([n for _, n in held], np.int64), [len(x) for x, _ in held])
    by, again = _chains(h, node)
    node = node[by]
    before = np.concatenate(([0], node[:-1]))[: len(node)].astype(np.int64)
    keep = ~again | (before != node)
    return pa.RecordBatch.from_arrays([pa.array(h[by][keep]), pa.array(node[keep]), pa.array(before[keep], mask=~again[keep])], names=["h", "node", "other"])


def _met(entries: DataFrame) -> DataFrame:
    """(u, v): the edges among entries, and those that connect equal h."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None
        for batch in batches:
            if batch.num_rows:
                h, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                said = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
                other = batch.column(2).fill_null(0).to_numpy()
                u, v = [node[said]], [other[said]]
                plain = np.flatnonzero(~said)
                if len(plain):
                    hs, ns = h[plain], node[plain]
                    before_h, before_n = (np.concatenate(([x], y[:-1])) for x, y in zip(last or (0, 0), (hs, ns)))
                    same = before_h == hs
                    same[0] &= last is not None
                    u.append(ns[same])
                    v.append(before_n[same])
                    last = int(hs[-1]), int(ns[-1])
                u, v = np.concatenate(u), np.concatenate(v)
                apart = u != v
                yield pa.RecordBatch.from_arrays([pa.array(u[apart]), pa.array(v[apart])], names=["u", "v"])

    return entries.repartition("h").sortWithinPartitions("h").mapInArrow(met, "u long, v long")


class Family:
    """Sets of shingles, asked for those similar enough to one of them."""

    def __init__(self, sets: list[np.ndarray], least: float):
        self.least = least
        self.n = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.starts = np.cumsum(self.n) - self.n
        self.names, self.flat = np.unique(flat, return_inverse=True)
        self.marks = np.zeros(len(self.names) + 1, np.int64)

    def take(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The members of some sets side by side: (sets, members, where each set starts)."""
        sizes = self.n[some]
        starts = np.cumsum(sizes) - sizes
        return some, self.flat[np.repeat(self.starts[some] - starts, sizes) + np.arange(sizes.sum())], starts

    def near(self, members: np.ndarray, among: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Whether each of the sets `among` is similar enough to the set of these members (places in names)."""
        some, flat, starts = among
        full = self.n[some] > 0
        both = np.zeros(len(some), np.int64)
        if full.any():
            self.marks[members] = 1
            both[full] = np.add.reduceat(self.marks[flat], starts[full])
            self.marks[members] = 0
        size = len(members) + self.n[some] - both
        return (both >= (self.least - 1e-9) * size) & (size > 0)

    def members(self, k: int) -> np.ndarray:
        return self.flat[self.starts[k] : self.starts[k] + self.n[k]]

    def components(self) -> np.ndarray:
        """For each set the first one that it is linked to: breadth first, each reached set asks those not reached yet."""
        m = len(self.n)
        root, waiting = np.full(m, -1), self.take(np.arange(m))
        alive = np.ones(m, bool)  # of waiting
        for first in range(m):
            if root[first] >= 0:
                continue
            root[first], queue = first, [first]
            while queue:
                k = queue.pop()
                alive &= root[waiting[0]] < 0
                if alive.sum() < len(alive) // 2:
                    waiting = self.take(waiting[0][alive])
                    alive = np.ones(len(waiting[0]), bool)
                if not alive.any():
                    break
                found = waiting[0][alive & self.near(self.members(k), waiting)]
                root[found] = first
                queue += found.tolist()
        return root


def family_links(families: DataFrame, words: int, least: float, most_rows: int = 4096, most_bytes: int = 8_000_000, vantages: int = 16) -> DataFrame:
    """(u, v): edges that connect all nodes of a family (family, node, text) whose sets are similar enough.

    A family of most_rows and most_bytes at most is compared in one task. A larger one is dealt to blocks: each is
    compared within itself and with the family's vantage sets, which all blocks share. Then the members outside of the
    family's largest component are compared with all others, in pairs of blocks, but where the distances to a vantage
    set differ by more than 1 - least: 1 - Jaccard is a metric, so the triangle inequality rules such pairs out.
    """
    families = cut(families.select("family", "text", F.octet_length("text").alias("bytes"), F.xxhash64("text").alias("key")))
    sizes = families.groupBy("family").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / most_rows), F.ceil(F.col("bytes") / most_bytes)).cast("int")
    sizes = cut(sizes.select("family", blocks.alias("blocks")))
    dealt = families.drop("bytes").join(small(sizes), "family").withColumn("block", F.pmod(F.col("key"), F.col("blocks")).cast("int"))

    def sets_of(texts: pa.ChunkedArray) -> tuple[list[np.ndarray], np.ndarray]:
        known = Words()
        sets = [shingles(t.as_py(), words, known) for t in texts]
        return sets, np.array([point_of(s) for s in sets], np.int64)

    def within(group: pa.Table) -> pa.Table:
        sets, nodes = sets_of(group.column("text"))
        root = Family(sets, least).components()
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"u": nodes[moved], "v": nodes[root[moved]]})

    links = dealt.select("family", "block", "text").groupBy("family", "block").applyInArrow(within, "u long, v long")
    if not sizes.where("blocks > 1").limit(1).count():
        return links
    links = cut(links)

    # vantage sets: those of the smallest hashes of each large family
    crowd = dealt.where("blocks > 1")
    order = Window.partitionBy("family").orderBy(F.xxhash64("key", F.lit("vantage")), "key")
    chosen = crowd.select("family", "key", "blocks").withColumn("at", F.row_number().over(order)).where(F.col("at") <= vantages)
    views = cut(chosen.join(crowd.select("family", "key", "text"), ["family", "key"]))
    shown = views.select(F.col("family").alias("of"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at_block"), "at", F.col("text").alias("view_text"))

    def look(group: pa.Table, views: pa.Table) -> pa.Table:
        views, m = views.sort_by("at"), group.num_rows
        (sets, nodes), (seen, view_nodes) = sets_of(group.column("text")), sets_of(views.column("view_text"))
        own, far = Family([*sets, *seen], least), np.zeros((m, views.num_rows))
        everyone = own.take(np.arange(m))
        for k in range(views.num_rows if m else 0):
            members = own.members(m + k)
            own.marks[members] = 1
            both = np.add.reduceat(np.concatenate((own.marks[everyone[1]], [0])), everyone[2]) * (own.n[:m] > 0)
            own.marks[members] = 0
            far[:, k] = 1 - both / np.maximum(1, len(members) + own.n[:m] - both)
        columns = [group.column(c) for c in ("family", "key", "block", "blocks")]
        return pa.table([*columns, pa.array(nodes), pa.array(far.tolist(), pa.list_(pa.float64())), pa.array([view_nodes.tolist()] * m, pa.list_(pa.int64()))], names=["family", "key", "block", "blocks", "node", "far", "views"])

    schema = "family long, key long, block int, blocks int, node long, far array<double>, views array<long>"
    seen = cut(crowd.select("family", "block", "blocks", "key", "text").groupBy("family", "block").cogroup(shown.groupBy("of", "at_block")).applyInArrow(look, schema))
    close = seen.select("node", F.explode(F.arrays_zip("far", "views")).alias("f")).where(F.col("f.far") <= 1 - least + 1e-9).select(F.col("node").alias("u"), F.col("f.views").alias("v"))
    links = cut(links.unionByName(close.where("u <> v")))

    rooted = cut(seen.join(connected(links), "node", "left").withColumn("root", F.coalesce("root", "node")).drop("views"))
    main = rooted.groupBy("family", "root").agg(F.count("*").alias("n")).groupBy("family").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    marked = cut(rooted.join(small(cut(main)), "family").withColumn("left", F.col("root") != F.col("main")).drop("main"))
    counts = marked.where("left").groupBy("family").agg(F.ceil(F.count("*") / most_rows).cast("int").alias("asks"))
    asking = marked.join(small(cut(counts)), "family")
    texts = crowd.select("family", "key", "text")
    asks = asking.where("left").select("family", F.pmod(F.xxhash64("key", F.lit(1)), F.col("asks")).cast("int").alias("ask"), "key", "node", "root", "far", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(texts, ["family", "key"])
    others = asking.select("family", "key", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("at_ask"), F.col("block").alias("at_block"), F.col("node").alias("node2"), F.col("root").alias("root2"), F.col("far").alias("far2")).join(texts, ["family", "key"])
    others = others.select(F.col("family").alias("of"), "at_ask", "at_block", "node2", "root2", "far2", F.col("text").alias("text2"))

    def compare(asks: pa.Table, others: pa.Table) -> pa.Table:
        m, empty = asks.num_rows, pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        if not m or not others.num_rows:
            return empty
        own = Family([*sets_of(asks.column("text"))[0], *sets_of(others.column("text2"))[0]], least)
        far, far2 = (np.array(t.column(c).to_pylist()) for t, c in ((asks, "far"), (others, "far2")))
        nodes, nodes2 = np.concatenate((asks.column("node").to_numpy(), others.column("node2").to_numpy())), others.column("node2").to_numpy()
        roots, at = np.unique(np.concatenate((asks.column("root").to_numpy(), others.column("root2").to_numpy())), return_inverse=True)
        forest = Forest(len(roots))
        u, v = [], []
        for k in range(m):
            reach = np.abs(far2 - far[k]).max(axis=1) <= 1 - least + 1e-9
            some = np.flatnonzero(reach & (forest.root[at[m:]] != forest.root[at[k]]))
            if len(some):
                found = some[own.near(own.members(k), own.take(some + m))]
                u += [nodes[k]] * len(found)
                v += nodes2[found].tolist()
                forest.union(np.full(len(found), at[k]), at[m + found])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    more = asks.groupBy("family", "ask", "block").cogroup(others.groupBy("of", "at_ask", "at_block")).applyInArrow(compare, "u long, v long")
    return links.unionByName(more)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, radius: int = 2, most_rows: int = 4096) -> DataFrame:
    """(id, component): the smallest id reachable over pairs of texts whose sets of word shingles have at least this Jaccard similarity.

    Words are as in fingerprints. Equal sets meet before any search, so do null and wordless texts; repeated rows
    have a row each. Shingles and sets are told apart by 64-bit hashes. Rows without an id take no part in links;
    they show their set's component, null if no row with an id has it. Only texts of families are moved.
    """
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = cut(named(texts, words))
    points = cut(rows.groupBy("point").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.min("fp").alias("fp")))
    held = points.where("least IS NOT NULL")
    close = cut(simhash.links(cut(held.groupBy("fp").agg(F.min("point").alias("node"))), radius))
    edges = cut(close.unionByName(meetings(texts, words, least)))
    family = connected(edges)
    members = cut(family.select(F.col("node").alias("point"), F.col("root").alias("family")).unionByName(family.select(F.col("root").alias("point"), F.col("root").alias("family")).distinct()))
    # one document of each set: its row is the one whose id and set are these
    chosen = small(cut(members.join(held.select("point", "least"), "point").select(F.col("point").alias("of"), "least", "family")))
    there = cut(rows.join(chosen, (F.col("id") == F.col("least")) & (F.col("point") == F.col("of"))).select("id", "family").distinct())
    moved = texts.join(small(there), "id").select("family", "text")
    roots = connected(cut(family_links(moved, words, least, most_rows)))
    both = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    lowest = cut(both.join(points.drop("n"), F.col("node") == F.col("point")).groupBy("root").agg(F.min("least").alias("lowest"), F.count("*").alias("n")))
    linked = hot_join(both, lowest, "root", both.count()).select("node", "lowest")
    classes = cut(points.join(linked, F.col("node") == F.col("point"), "left").select("point", F.coalesce("lowest", "least").alias("component"), "n"))
    return hot_join(rows.select("id", "point"), classes, "point", rows.count()).select("id", "component")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """df without the rows that link, through others too, to a row of a smaller id; rows without an id stay."""
    found = near_duplicates(df, id_col, text_col, words, least)
    return df.join(small(cut(found.where("id <> component").select(F.col("id").alias(id_col)).distinct())), id_col, "left_anti")
