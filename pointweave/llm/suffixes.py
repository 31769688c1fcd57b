"""Removal of repeated byte strings: exact classes of equal strings from a Burrows-Wheeler transform.

Whatever two documents share of at least `least` bytes holds the same anchor: each window of that many bytes
names the least of its gram hashes, a function of the window alone. A context is an anchor with windows that
name it, one after the other. Blocks of texts tell buckets the hashes of their anchors; anchors found in one
document only are done. The contexts of the others go to their anchor's bucket as bytes. There equal contexts
are one, and a suffix sort, its transform and backward extension tell which windows of different contexts of an
anchor are equal. So every equality is one of bytes: hashes only choose where strings meet. Texts stay in
their blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import cut, free_names, hot_join, mixed, text_or_empty
from pointweave.llm.notes import bucket_of, low4, notes_of, pack, runs, spread, two, unpack, untwo

GRAM = 25
#: So many windows of a text are hashed at once; the low bits of a key hold a place among them.
CHUNK = 1 << 20
PLACE = np.uint64(2 * CHUNK - 1)
NONE = np.iinfo(np.int64).max
#: Odd multipliers of the rolling gram hash.
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the 25 bytes from each place on; sums over 1, 2, 4, 8 and 16 bytes double up to 16 + 8 + 1."""
    with np.errstate(over="ignore"):
        one = (b.astype(np.uint64) + np.uint64(1)) * ODD[0]
        two = one[:-1] * ODD[1] + one[1:]
        four = two[:-2] * ODD[2] + two[2:]
        eight = four[:-4] * ODD[3] + four[4:]
        sixteen = eight[:-8] * ODD[4] + eight[8:]
        n = len(b) - GRAM + 1
        return mixed((sixteen[:n] * ODD[1] + eight[16 : 16 + n]) * ODD[2] + one[24 : 24 + n])


def string_hashes(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, least: int) -> np.ndarray:
    """Hashes of the strings from window first to window last, from those of the grams they are covered by."""
    with np.errstate(over="ignore"):
        out = (last - first).astype(np.uint64)
        for window in (first, last):
            for k in (*range(0, least - GRAM, GRAM), least - GRAM):
                out = out * ODD[3] + hashes[window + k]
    return mixed(out)


def window_hashes(b: np.ndarray, starts: np.ndarray, least: int, at_once: int = 16_384) -> np.ndarray:
    """Hashes of the windows of `least` bytes from given places on, a few at a time."""
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(least, ODD[0], np.uint64))
        parts = [np.zeros(0, np.uint64)]
        for lo in range(0, len(starts), at_once):
            rows = b[starts[lo : lo + at_once, None] + np.arange(least)]
            parts.append(mixed((rows.astype(np.uint64) + np.uint64(1)) @ power))
    return np.concatenate(parts)


def anchors(b: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(gram hash, context's hash, first window, last window) of each anchor of a text, in order; none of a shorter one.

    A long text is taken in parts; a context ends where a part does.
    """
    parts = [(np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2]
    for lo in range(0, len(b) - least + 1, CHUNK):
        hashes = gram_hashes(b[lo : lo + CHUNK + least - 1])
        keys = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
        width, reach = least - GRAM + 1, 1
        while 2 * reach <= width:
            keys = np.minimum(keys[:-reach], keys[reach:])
            reach *= 2
        if width > reach:
            keys = np.minimum(keys[: len(keys) - (width - reach)], keys[width - reach :])
        at = (keys & PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.concatenate((first[1:], [len(at)])) - 1
        parts.append((hashes[at[first]], string_hashes(hashes, first, last, least), first + lo, last + lo))
    return tuple(np.concatenate(x) for x in zip(*parts))


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of a text of small whole numbers, sorted by what follows, to depth symbols at least; by doubling."""
    size = int(text.max()) + 1
    rank, h = text.astype(np.int64), 1
    packed = max(1, int(62 // max(1, math.ceil(math.log2(size + 1)))))
    padded = np.concatenate((rank, np.zeros(packed, np.int64)))
    key = np.zeros(len(text), np.int64)
    for k in range(packed):
        key = key * size + padded[k : k + len(text)]
    h = packed
    while True:
        order = np.argsort(key)
        if h >= depth:
            return order
        fresh = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1]))) + 1
        if fresh[-1] == len(text):
            return order
        rank = np.empty(len(text), np.int64)
        rank[order] = fresh
        ahead = np.concatenate((rank[h:], np.zeros(min(h, len(text)), np.int64)))[: len(text)]
        key = rank * (int(fresh[-1]) + 1) + ahead
        h *= 2


def equal_prefix_classes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, class of each row): rows are of one class if their first depth symbols are equal.

    The text ends in 0; classes of rows with a 0 among those symbols mean nothing.

    The rows whose suffixes begin with a string w are an interval. Backward extension turns the interval
    of w into those of cw for each symbol c before its suffixes. Breadth first, all intervals of strings
    of length l give those of length l + 1: a row starts one if its symbol hasn't preceded its interval
    before. So common prefixes come out by increasing length, the ones of length l as the boundaries new
    at l + 1, and the expansion stops at depth: beyond it nothing is told apart.
    """
    order = suffix_order(text, depth)
    before = text[order - 1]  # the transform; the first suffix is preceded by the last symbol, a 0
    rows = np.argsort(before, kind="stable")  # row by row, the rows that the extensions lead to
    symbol = before[rows]
    turn = symbol[1:] != symbol[:-1]
    heads = text[order]
    starts = np.concatenate(([True], heads[1:] != heads[:-1]))
    for _ in range(depth - 1):
        interval = np.cumsum(starts, dtype=np.int32)[rows]
        longer = np.concatenate(([True], turn | (interval[1:] != interval[:-1])))
        if np.array_equal(longer, starts):
            break
        starts = longer
    return order, np.cumsum(starts) - 1


def window_minima(contexts: list[bytes], owners: np.ndarray, least: int) -> list[np.ndarray]:
    """For each context, the least owner of each of its windows among all contexts that hold an equal one."""
    lengths = np.array([len(c) for c in contexts])
    raw = np.frombuffer(b"".join(contexts), np.uint8)
    code = np.zeros(256, np.uint8)
    used = np.flatnonzero(np.bincount(raw, minlength=256))
    wide = len(used) > 254
    text = np.zeros(len(raw) + len(contexts), np.uint16 if wide else np.uint8)
    starts = np.cumsum(lengths + 1) - lengths - 1
    row = np.repeat(np.arange(len(contexts)), lengths)
    at = np.arange(len(raw)) + row
    if wide:
        text[at] = raw.astype(np.uint16) + 1
    else:
        code[used] = np.arange(1, len(used) + 1)
        text[at] = code[raw]
    owner = np.full(len(text), NONE)
    windows = lengths - least + 1
    inside = np.repeat(starts, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    owner[inside] = np.repeat(owners, windows)
    order, classes = equal_prefix_classes(text, least)
    lowest = np.minimum.reduceat(owner[order], np.flatnonzero(np.concatenate(([True], classes[1:] != classes[:-1]))))
    found = np.empty(len(text), np.int64)
    found[order] = lowest[classes]
    return np.split(found[inside], np.cumsum(windows)[:-1])


class Block:
    """A block's texts in order of ids, side by side. Copies of another document's text take no part in the search."""

    def __init__(self, texts: pa.Table, copies: set[tuple[int, int]], least: int):
        self.least = least
        ids, tags = texts.column("doc_id").to_pylist(), texts.column("tag").to_pylist()
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], tags[i]))
        self.ids = np.array([ids[i] for i in self.order], np.int64)
        self.copy = np.array([(ids[i], tags[i]) in copies for i in self.order], bool)
        column = texts.column("text").combine_chunks().take(pa.array(self.order, pa.int64())).cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        self.sizes = np.diff(offsets)
        self.starts = offsets[:-1] - offsets[0]
        self.flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]

    def search(self) -> None:
        """Finds the anchors: their hashes, contexts and documents, and the distinct hashes with what is to be said of them."""
        found, docs = [], []
        for d in np.flatnonzero(~self.copy).tolist():
            at = int(self.starts[d])
            h, c, first, last = anchors(self.flat[at : at + self.sizes[d]], self.least)
            found.append((h, c, first + at, (last - first).astype(np.int32)))
            docs.append(np.full(len(h), d, np.int32))
        empty = (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64), np.zeros(0, np.int32))
        self.hash, self.context, self.first, self.width = (np.concatenate(x) for x in zip(empty, *found))
        self.doc = np.concatenate([np.zeros(0, np.int32), *docs])
        del found, docs
        doc_id = self.ids[self.doc]
        by = np.argsort(self.hash, kind="stable")
        new = np.concatenate(([True], self.hash[by][1:] != self.hash[by][:-1]))[: len(by)]
        at = np.flatnonzero(new)
        self.names = self.hash[by[at]]
        self.of = np.empty(len(by), np.int32)
        self.of[by] = np.cumsum(new) - 1
        ends = np.append(at[1:], len(by))[: len(at)] - 1
        several = doc_id[by[ends]] != doc_id[by[at]]  # occurrences are in order of ids
        with np.errstate(over="ignore"):
            _, one = np.unique(mixed(self.hash * ODD[0] ^ self.context), return_index=True)
        contexts = np.bincount(self.of[one], minlength=len(self.names))
        self.said = (np.minimum(contexts, 127) | (several.astype(np.int64) << 7)).astype(np.uint8)

    def units(self, code: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
        """(start, length, hash, document) of the strings to be told to buckets: contexts of shared anchors, and the single
        windows of crowded ones."""
        whole, single = (np.flatnonzero(code[self.of] == k) for k in (SHARED, CROWDED))
        parts = [(self.first[whole], self.width[whole].astype(np.int64) + self.least, self.hash[whole], self.context[whole], self.doc[whole])]
        if len(single):
            windows = self.width[single].astype(np.int64) + 1
            start = spread(self.first[single], windows)
            h = window_hashes(self.flat, start, self.least)
            parts.append((start, np.full(len(start), self.least), h, h, np.repeat(self.doc[single], windows)))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def grouped(self, start: np.ndarray, length: np.ndarray, h: np.ndarray, context: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group of each unit, first unit of each group): units of one group have equal hashes and equal bytes."""
        with np.errstate(over="ignore"):
            key = mixed(h * ODD[0] ^ mixed(context + length.astype(np.uint64)))
        by = np.lexsort((start, doc, key))  # documents are in order of ids, so a group's first unit is of its least one
        new = np.concatenate(([True], key[by][1:] != key[by][:-1]))[: len(by)]
        while True:
            first = by[np.flatnonzero(new)]
            group = np.cumsum(new) - 1
            # bytes against those of the group's first unit, a few units at a time
            other = np.zeros(len(by), bool)
            for lo in range(0, len(by), 8_192):
                own, rep = by[lo : lo + 8_192], first[group[lo : lo + 8_192]]
                size = length[own]
                differ = (length[rep] != size) | (h[rep] != h[own])
                size = np.where(differ, 0, size)
                apart = self.flat[spread(start[own], size)] != self.flat[spread(start[rep], size)]
                differ |= np.bincount(np.repeat(np.arange(len(own)), size), weights=apart, minlength=len(own)) > 0
                other[lo : lo + 8_192] = differ
            if not other.any():
                break
            # equal hashes of other bytes: those units are groups of their own, told apart once more
            key = key.copy()
            key[by[other]] = mixed(key[by[other]] + ODD[1])
            by = np.lexsort((start, doc, key))
            new = np.concatenate(([True], key[by][1:] != key[by][:-1]))
        out = np.empty(len(by), np.int64)
        out[by] = group
        return out, first


#: What a bucket says of an anchor: in one document only, in several, in so many contexts that its windows go one by one.
ALONE, SHARED, CROWDED = 0, 1, 2
#: Buckets of notes that blocks get apart from answers: copies, and what they have sent themselves.
COPIES, OWN = -1, -2

def _copies(notes: pa.Table) -> set[tuple[int, int]]:
    """Documents that a block is told to be copies."""
    return {(k["id"], k["tag"]) for b, keys in zip(notes.column("bucket").to_pylist(), notes.column("copies").to_pylist()) if b == COPIES for k in keys}


def _told(notes: pa.Table) -> Iterator[tuple[int, bytes]]:
    """(bucket, data) of the notes but copies."""
    return ((b, d) for b, d in zip(notes.column("bucket").to_pylist(), notes.column("data").to_pylist()) if b != COPIES)


def shared_codes(blobs: pa.Table, most: int) -> list[tuple[int, int, bytes]]:
    """Notes to blocks on the anchors they have told a bucket of, in the order of their telling."""
    found = [(b, unpack(d, "<u4", "u1")) for b, d in zip(blobs.column("block").to_pylist(), blobs.column("data").to_pylist())]
    bucket = blobs.column("bucket")[0].as_py()
    key, said = (np.concatenate([x[k] for _, x in found]) for k in (0, 1))
    by = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[by][1:] != key[by][:-1]))
    at = np.flatnonzero(new)
    contexts = np.add.reduceat((said[by] & 127).astype(np.int64), at)
    shared = (np.diff(np.append(at, len(by))) > 1) | (np.maximum.reduceat(said[by] >> 7, at) > 0)
    code = np.empty(len(by), np.uint8)
    code[by] = np.where(shared, np.where(contexts > most, CROWDED, SHARED), ALONE).astype(np.uint8)[np.cumsum(new) - 1]
    ends = np.cumsum([len(x[0]) for _, x in found])
    return [(b, bucket, pack(c)) for (b, _), c in zip(found, np.split(code, ends[:-1])) if c.any()]


def least_owners(blobs: pa.Table, least: int, batch_bytes: int) -> list[tuple[int, int, bytes]]:
    """Notes to blocks on the least document of each window of the strings they have sent, where that tells them something."""
    bucket = blobs.column("bucket")[0].as_py()
    heads = []
    number: dict[bytes, int] = {}
    context: list[int] = []
    keys: list[int] = []
    for block, data in zip(blobs.column("block").to_pylist(), blobs.column("data").to_pylist()):
        head, rest = untwo(data)
        key, length, doc, several = unpack(head, "<u4", "<u2", "<i8", "?")
        said = unpack(rest, "u1")[0].tobytes()
        ends = np.cumsum(length.astype(np.int64)).tolist()
        for e, n, k in zip(ends, length.tolist(), key.tolist()):
            context.append(number.setdefault(said[e - n : e], len(keys)))
            if context[-1] == len(keys):
                keys.append(k)
        heads.append((np.full(len(key), block), np.arange(len(key)), doc, several))
    block, place, doc, several = (np.concatenate(x) for x in zip(*heads))
    of = np.array(context)
    texts, anchor = list(number), np.array(keys, np.int64)
    lowest = np.full(len(texts), NONE)
    np.minimum.at(lowest, of, doc)
    # contexts that are not the only one of their anchor, anchor by anchor
    by = np.argsort(anchor, kind="stable")
    size = np.bincount(np.cumsum(np.concatenate(([0], anchor[by][1:] != anchor[by][:-1]))))
    names = by[np.repeat(size, size) > 1].tolist()
    minima: dict[int, np.ndarray] = {}
    lo = 0
    while lo < len(names):  # whole anchors at a time, as windows of different anchors aren't equal
        hi, total = lo, 0
        while hi < len(names) and (total < batch_bytes or anchor[names[hi]] == anchor[names[hi - 1]]):
            total += len(texts[names[hi]])
            hi += 1
        own = names[lo:hi]
        minima.update(zip(own, window_minima([texts[k] for k in own], lowest[own], least)))
        lo = hi
    flat, some_less = lowest.copy(), lowest.copy()  # the one least document of all windows of a context, or NONE if they differ
    for k, m in minima.items():
        flat[k], some_less[k] = (m[0] if (m == m[0]).all() else NONE), m.min()
    out = []
    tell = np.flatnonzero(several | (some_less[of] < doc))
    for at in runs(block, tell[np.argsort(block[tell], kind="stable")]):
        more = [minima[k] if flat[k] == NONE else np.zeros(0, np.int64) for k in of[at].tolist()]
        head = pack(place[at].astype("<u4"), flat[of[at]], np.array([len(m) for m in more], "<u4"))
        out.append((int(block[at[0]]), bucket, two(head, pack(np.concatenate(more)))))
    return out


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50, block_bytes: int = 6_000_000, bucket_bytes: int = 3_000_000, batch_bytes: int = 500_000, most: int = 4096, keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept], c0, c1, ...) of each row; c0 and on are the columns to carry.

    Each byte goes that a string of `least` bytes covers which also starts in a document of a smaller id.
    Null texts are empty; rows without an id lose nothing and take nothing; rows of one id aren't held
    against each other. kept, a string, drops what is left of characters cut in two.

    A text that a document of a smaller id has as a whole, by SHA-256, goes without a search. A passage in very many
    documents gives the anchors at its ends a context of each; of an anchor of more than `most` contexts the single
    windows go to buckets, each by its own hash, so no task gathers them all. They are compared there like contexts.
    """
    spark = df.sparkSession
    carried = [F.col(c).alias(f"c{k}") for k, c in enumerate(carry)]
    extra = [f"c{k}" for k in range(len(carry))]
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), *carried).withColumn("n", F.octet_length("text").cast("long"))
    searched = F.col("doc_id").isNotNull() & (F.col("n") >= least)
    total, count = rows.agg(F.sum("n"), F.count("*")).first()
    floor = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks, buckets = (max(floor, math.ceil((total or 0) / n)) for n in (block_bytes, bucket_bytes))
    tagged = rows.where(searched).withColumn("tag", F.xxhash64("text"))  # tells rows of one id apart
    block_of = F.pmod(F.xxhash64("doc_id", "tag", F.lit("block")), F.lit(blocks))
    base = tagged.withColumn("block", block_of).drop("n").repartition(blocks, "block")

    light = tagged.select("doc_id", "tag", F.sha2("text", 256).alias("whole"))
    earliest = cut(light.groupBy("whole").agg(F.min("doc_id").alias("earliest"), F.count("*").alias("n")).where("n > 1"))
    copies = hot_join(light, earliest, "whole", count).where("doc_id <> earliest").select("doc_id", "tag", block_of.alias("block")).groupBy("block").agg(F.collect_list(F.struct(F.col("doc_id").alias("id"), "tag")).alias("copies"))
    told = cut(copies.select("block", F.lit(COPIES).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("data"), "copies"))
    no_copies = F.lit(None).cast("array<struct<id:bigint,tag:bigint>>").alias("copies")

    def in_blocks(notes: DataFrame, run, schema: str) -> DataFrame:
        notes = notes.select(F.col("block").alias("to_block"), "bucket", "data", "copies").repartition(blocks, "to_block")
        return base.groupBy("block").cogroup(notes.groupBy("to_block")).applyInArrow(run, schema)

    note = "block long, bucket long, data binary"

    def told_buckets(own: Block) -> list[np.ndarray]:
        """Names of anchors by bucket."""
        bucket = bucket_of(own.names, buckets)
        return runs(bucket, np.argsort(bucket, kind="stable"))

    def announce(texts: pa.Table, notes: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return notes_of([])
        own = Block(texts, _copies(notes), least)
        own.search()
        number = texts.column("block")[0].as_py()
        return notes_of([(number, int(bucket_of(own.names[at[:1]], buckets)[0]), pack(low4(own.names[at]), own.said[at])) for at in told_buckets(own)])

    def ask(blobs: pa.Table) -> pa.Table:
        return notes_of(shared_codes(blobs, most))

    asked = in_blocks(told, announce, note).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(ask, note)

    def supply(texts: pa.Table, notes: pa.Table) -> pa.Table:
        codes = dict(_told(notes))
        if not texts.num_rows or not codes:
            return notes_of([])
        own = Block(texts, _copies(notes), least)
        own.search()
        number, code = texts.column("block")[0].as_py(), np.zeros(len(own.names), np.uint8)
        for at in told_buckets(own):
            if (said := codes.get(int(bucket_of(own.names[at[:1]], buckets)[0]))) is not None:
                code[at] = unpack(said, "u1")[0]
        start, length, h, context, doc = own.units(code, buckets)
        group, first = own.grouped(start, length, h, context, doc)
        ids = own.ids[doc]
        most_id = np.full(len(first), np.iinfo(np.int64).min)
        np.maximum.at(most_id, group, ids)
        bucket = bucket_of(h[first], buckets)
        by = np.argsort(bucket, kind="stable")
        out, bases, place = [], [], np.empty(len(first), np.int64)
        place[by] = np.arange(len(by))
        for at in runs(bucket, by):
            f = first[at]
            head = pack(low4(h[f]), length[f].astype("<u2"), ids[f], most_id[at] != ids[f])
            out.append((number, int(bucket[at[0]]), two(head, pack(own.flat[spread(start[f], length[f])]))))
            bases.append((int(bucket[at[0]]), int(place[at[0]])))
        mine = two(pack(start.astype("<i8"), length.astype("<u2"), place[group].astype("<u4")), pack(np.array([b for b, _ in bases], "<i8"), np.array([p for _, p in bases], "<i8")))
        return notes_of([*out, (number, OWN - number, mine)])

    supplied = in_blocks(asked.select("block", "bucket", "data", no_copies).unionByName(told), supply, note).repartition(buckets, "bucket")

    def answer(blobs: pa.Table) -> pa.Table:
        if blobs.column("bucket")[0].as_py() < 0:  # what a block has noted for itself
            return blobs
        return notes_of(least_owners(blobs, least, batch_bytes))

    answered = supplied.groupBy("bucket").applyInArrow(answer, note)

    own_columns = ["doc_id long", "n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string"] + ["kept string"] * keep_text
    result = ", ".join(own_columns + [f"{c} {rows.schema[c].dataType.simpleString()}" for c in extra])
    names = [x.split()[0] for x in own_columns] + extra

    def finish(texts: pa.Table, notes: pa.Table) -> pa.Table:
        kinds = (pa.int64(),) * 4 + (pa.string(),) * (1 + keep_text)
        if not texts.num_rows:
            return pa.table([pa.array([], k) for k in kinds] + [texts.column(c) for c in extra], names=names)
        own = Block(texts, _copies(notes), least)
        answers = dict(_told(notes))
        edge = np.zeros(len(own.flat) + 1, np.int32)
        if (mine := next((answers.pop(b) for b in list(answers) if b < 0), None)) is not None:
            units, bases = untwo(mine)
            start, length, place = unpack(units, "<i8", "<u2", "<u4")
            base = dict(zip(*(x.tolist() for x in unpack(bases, "<i8", "<i8"))))
            doc_id = own.ids[np.searchsorted(own.starts, start, side="right") - 1]
            groups = int(place.max()) + 1 if len(place) else 0
            flat, at, more = np.full(groups, NONE), np.full(groups, -1), [np.zeros(0, np.int64)]
            seen = 0
            for bucket, data in answers.items():
                head, rest = untwo(data)
                k, lowest, counts = unpack(head, "<u4", "<i8", "<u4")
                k = k + base[bucket]
                flat[k] = lowest
                varied = np.flatnonzero(counts)
                at[k[varied]] = seen + np.cumsum(counts[varied]) - counts[varied]
                more.append(unpack(rest, "<i8")[0])
                seen += len(more[-1])
            minima = np.concatenate(more)
            whole = np.flatnonzero(flat[place] < doc_id)
            np.add.at(edge, start[whole], 1)
            np.add.at(edge, start[whole] + length[whole], -1)
            part = np.flatnonzero(at[place] >= 0)
            windows = length[part].astype(np.int64) - least + 1
            less = minima[spread(at[place[part]], windows)] < np.repeat(doc_id[part], windows)
            begin = spread(start[part], windows)[less]
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + least, -1)
        gone = np.cumsum(edge[:-1]) > 0
        found = []
        for d, (i, at, size) in enumerate(zip(own.ids.tolist(), own.starts.tolist(), own.sizes.tolist())):
            mask = gone[at : at + size] if not own.copy[d] else np.ones(size, bool)
            kept = own.flat[at : at + size][~mask].tobytes()
            spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
            found.append((i, size, size - len(kept), spans, hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "ignore")] if keep_text else ())))
        columns = [pa.array(list(c), k) for c, k in zip(zip(*found), kinds)]
        return pa.table(columns + [texts.column(c).take(pa.array(own.order, pa.int64())) for c in extra], names=names)

    done = in_blocks(answered.select("block", F.col("bucket"), "data", no_copies).unionByName(told), finish, result)
    zero = F.lit(0).cast("long")
    kept = [F.col("text").alias("kept")] if keep_text else []
    rest = rows.where(F.col("doc_id").isNull() | (F.col("n") < least)).select("doc_id", F.col("n").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), *kept, *extra)
    return done.unionByName(rest)


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50) -> DataFrame:
    """df with its texts' repeats of smaller documents removed; rows, null texts and other columns stay."""
    others = tuple(c for c in df.columns if c != text_col)
    (empty,) = free_names(df, "_null")
    found = remove_repeats(df.withColumn(empty, F.col(text_col).isNull()), id_col, text_col, least, keep_text=True, carry=(*others, empty))
    place = {c: F.col(f"c{k}") for k, c in enumerate(others)}
    return found.select(*[(F.when(~F.col(f"c{len(others)}"), F.col("kept")) if c == text_col else place[c]).alias(c) for c in df.columns])
