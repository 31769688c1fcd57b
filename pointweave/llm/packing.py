"""Best-fit packing planned over a histogram of lengths."""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointweave.llm.common import cut, free_names, portions


#: Stands for the end of a word; no UTF-8 text holds this byte.
END = b"\xff"
#: Characters that the tokenizer neither composes nor joins with others on its way: ASCII but the apostrophe and the
#: sign that special tokens begin with, and letters below U+0250, which lower-case one by one.
PLAIN = re.compile("[" + "".join(re.escape(chr(c)) for c in range(33, 0x250) if (c < 127 and chr(c) not in "'<") or (c > 127 and c != 0x130 and chr(c).isalpha())) + "]+")
#: How the tokenizer splits a word of such characters: runs of letters, single digits, runs of marks.
SPLIT = re.compile(r"[^\W\d_]+|[0-9]|[!-/:-@\[-`{-~]+")


class Merges:
    """A vocabulary of byte pairs with word ends, as ranks of byte strings for a faster encoder of single words.

    That encoder joins whatever neighbours spell the string of the least rank, the vocabulary only the pair
    that a merge lists. Both agree unless a token is spelled by another pair on the way. unlisted holds
    the tokens whose own spelling from bytes takes such a step; a word without them took none.
    """

    def __init__(self, path: str):
        with open(path) as f:
            model = json.load(f)["model"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))}

        def spelled(token: str) -> bytes:
            core = token.removesuffix("</w>")
            return bytes(byte_of[c] for c in core) + (END if core != token else b"")

        self.ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + END: 256 + b for b in range(255)}
        self.pairs: dict[bytes, tuple[bytes, bytes]] = {bytes([b]) + END: (bytes([b]), END) for b in range(255)}
        for k, pair in enumerate(model["merges"]):
            left, right = map(spelled, pair.split(" ") if isinstance(pair, str) else pair)
            self.ranks[left + right] = 512 + k
            self.pairs[left + right] = (left, right)
        names = {self.ranks[x]: i for t, i in model["vocab"].items() if all(c in byte_of for c in t.removesuffix("</w>")) and (x := spelled(t)) in self.ranks}
        self.id_bytes = [names[r].to_bytes(4, "little") if r in names else b"" for r in range(max(self.ranks.values()) + 1)]

    def unlisted(self) -> frozenset[int]:
        """Ranks of the tokens that a word has to be without; found token by token, once."""
        out, ranks, none = set(), self.ranks, 1 << 60
        for token, rank in ranks.items():
            parts = [bytes([b]) for b in token]
            while len(parts) > 1:
                found = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
                best = min(found)
                i = found.index(best)
                if best == none or self.pairs.get(parts[i] + parts[i + 1]) != (parts[i], parts[i + 1]):
                    out.add(rank)
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return frozenset(out)


@lru_cache(maxsize=4)
def unlisted(path: str) -> frozenset[int]:
    return Merges(path).unlisted()


class Known(dict):
    """Ids of words, learned when first asked for and kept up to so many bytes of memory."""

    def __init__(self, learn: Callable[[str], bytes], keep_bytes: int):
        self.learn, self.left = learn, keep_bytes

    def __missing__(self, word: str) -> bytes:
        ids = self.learn(word)
        size = 250 + 4 * len(word) + len(ids)  # with the objects' heads and their place in the dict
        if size <= self.left:
            self.left -= size
            self[word] = ids
        return ids


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space, with the words' ids kept.

    White space separates words and yields no ids, so a text's ids are its words' ids in order. Only
    space, tab, line feed and carriage return split; whatever else is white space stays inside a word
    and is left to the tokenizer. Words are kept up to keep_bytes of memory together, and a text's are joined
    slice_words at a time. Words of plain characters go to the faster encoder of single pieces.
    """

    def __init__(self, path: str, unlisted: frozenset[int], keep_bytes: int = 64_000_000, slice_words: int = 64_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use all cores
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.slice_words = Tokenizer.from_file(path), slice_words
        merges = Merges(path)
        # a word with an unlisted token gets None among its parts, which join() refuses
        self.id_bytes = [None if r in unlisted or not x else x for r, x in enumerate(merges.id_bytes)]
        self.piece = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=merges.ranks, special_tokens={})._core_bpe.encode_single_piece
        self.known = Known(self.learn, keep_bytes)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        find, n = self.known.__getitem__, self.slice_words
        split = (t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts)
        return [b"".join(map(find, words)) if len(words) <= n else b"".join(b"".join(map(find, words[lo : lo + n])) for lo in range(0, len(words), n)) for words in split]

    def learn(self, word: str) -> bytes:
        if PLAIN.fullmatch(word):
            try:
                return b"".join([self.id_bytes[k] for part in SPLIT.findall(word.lower()) for k in self.piece(part.encode() + END)])
            except TypeError:
                pass
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=1)
def encoder(path: str, unlisted: frozenset[int]) -> WordEncoder:
    """One encoder for all tasks of a worker."""
    return WordEncoder(path, unlisted)


def token_pieces(df: DataFrame, path: str, max_len: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each text's ids and the end id, cut only beyond max_len.

    A null text is an empty one: its end id alone. Repeated rows and rows without an id have pieces like any other.
    """
    apart = unlisted(path)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = encoder(path, apart), np.array([end_id], "<u4").tobytes()
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())][: 5 + with_ids]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
        for batch in batches:
            for lo, hi in portions(batch.column(1), 500_000):
                rows = []
                for doc_id, ids in zip(batch.column(0)[lo:hi].to_pylist(), words.encode([t or "" for t in batch.column(1)[lo:hi].to_pylist()])):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids) // 4, max_len)):
                        own = ids[4 * start : 4 * (start + max_len)]
                        rows.append((doc_id, piece, start, len(own) // 4, zlib.crc32(own), *([np.frombuffer(own, "<u4").tolist()] if with_ids else ())))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def plan(counts: dict[int, int], max_len: int) -> np.ndarray:
    """Slots for counts[length] pieces of each length: rows (length, first rank, per bin, first sequence, offset), by length and rank.

    Best-fit decreasing, over counts: lengths from the largest, each into the fullest bins that still
    take it. Bins with the same contents are one group, so the work and the plan follow the number of
    lengths and not the number of pieces: a length splits at most one group, and a group holds runs
    of distinct lengths whose sum is max_len at most. The piece of a length at rank r from the row's
    first rank f on takes sequence s + (r - f) div p, at offset o + ((r - f) mod p) * length.
    """
    groups: dict[int, list[tuple[int, tuple]]] = {}  # free space -> (bins, runs of (length, first rank, per bin, offset))
    spaces: list[int] = []

    def put(space: int, bins: int, runs: tuple) -> None:
        if space not in groups:
            groups[space] = []
            bisect.insort(spaces, space)
        groups[space].append((bins, runs))

    def from_bin(runs: tuple, skip: int) -> tuple:
        return tuple((length, first + skip * each, each, offset) for length, first, each, offset in runs)

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        left, rank, changed = counts[length], 0, []
        at = bisect.bisect_left(spaces, length)
        while left:
            if at < len(spaces):
                space = spaces[at]
                bins, runs = groups[space].pop()
                if not groups[space]:
                    del groups[spaces.pop(at)]
            else:
                space, bins, runs = max_len, -(-left // (max_len // length)), ()
            each, used = space // length, 0
            while left and used < bins:  # whole bins first, then one that isn't filled
                per_bin, n = (each, min(bins - used, left // each)) if left >= each else (left, 1)
                changed.append((space - per_bin * length, n, (*from_bin(runs, used), (length, rank, per_bin, max_len - space))))
                rank, left, used = rank + per_bin * n, left - per_bin * n, used + n
            if used < bins:
                changed.append((space, bins - used, from_bin(runs, used)))
        for group in changed:
            put(*group)
    rows, sequence = [], 0
    for space in spaces:
        for bins, runs in groups[space]:
            rows += [(length, first, each, sequence, offset) for length, first, each, offset in runs]
            sequence += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def before_each(counts: DataFrame, key: str, order: str, width: int = 1024) -> DataFrame:
    """counts with before: the sum of n over the rows of an equal key and a smaller order, whole numbers from 0.

    Two levels, so that a key of very many rows is summed by many tasks: within ranges of `width` orders, and over ranges.
    """
    ranged = counts.withColumn("_range", F.floor(F.col(order) / width))
    within = Window.partitionBy(key, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_at")).agg(F.sum("n").alias("_n")).select("_key", "_at", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"))
    summed = ranged.withColumn("_within", F.coalesce(F.sum("n").over(within), F.lit(0)))
    joined = summed.join(ranges, (F.col(key) == F.col("_key")) & (F.col("_range") == F.col("_at")))
    return joined.withColumn("before", F.col("_before") + F.col("_within")).drop("_range", "_within", "_key", "_at", "_before")


def pack(pieces: DataFrame, max_len: int = 4096, cell_rows: int = 64) -> DataFrame:
    """The pieces (length, ...) with (sequence_id, offset), planned best-fit over the histogram of their lengths.

    The driver sees the histogram, at most max_len rows. A piece's rank within its length comes from
    cells of about cell_rows pieces: the pieces before its cell, plus its place in it; so a length that
    very many pieces share is ranked by many tasks, repeated rows too. The planned slots, a row a length,
    are joined by length, and the rank tells the slot. Sequence numbers have no order; which of the pieces
    of a length takes which slot is the same for the same partitions of pieces. Other columns stay.
    """
    pieces = cut(pieces)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots: dict[int, list[list[int]]] = {}
    for length, *slot in plan(counts, max_len).tolist():
        slots.setdefault(length, []).append(slot)
    spark = pieces.sparkSession
    size, cells, cell, row, key, rank, n, before, place, table, own, slot = free_names(pieces, "_size", "_cells", "_cell", "_row", "_key", "_rank", "_n", "_before", "_place", "_slots", "_own", "_slot")
    sizes = [(k, max(1, v // cell_rows)) for k, v in counts.items()]
    sized = F.broadcast(spark.createDataFrame(sizes, f"{size} long, {cells} long"))
    # the place of a row of the checkpoint deals it to a cell: equal rows are told apart too
    placed = pieces.withColumn(row, F.monotonically_increasing_id()).join(sized, F.col("length") == F.col(size)).withColumn(cell, F.pmod(F.xxhash64(row), F.col(cells))).drop(size, cells)
    light = placed.select(F.col("length").alias("of"), F.col(cell).alias("cell"), F.lit(1).alias("one")).groupBy("of", "cell").agg(F.count("*").alias("n"))
    first = before_each(light, "of", "cell").select(F.col("of").alias(key), F.col("cell").alias(place), F.col("before").alias(before))
    in_cell = F.row_number().over(Window.partitionBy("length", cell).orderBy(row)) - 1
    ranked = placed.withColumn(n, in_cell).join(first, (F.col("length") == F.col(key)) & (F.col(cell) == F.col(place))).withColumn(rank, F.col(before) + F.col(n))
    rows = [(k, [s[0] for s in own_slots], [tuple(s) for s in own_slots]) for k, own_slots in slots.items()]
    known = F.broadcast(spark.createDataFrame(rows, f"{own} long, {slot} array<long>, {table} array<struct<first:bigint,each:bigint,sequence:bigint,at:bigint>>"))
    found = ranked.join(known, F.col("length") == F.col(own)).withColumn(slot, F.expr(f"element_at({table}, cast(size(filter({slot}, f -> f <= {rank})) AS int))"))
    since = F.col(rank) - F.col(f"{slot}.first")
    each = F.col(f"{slot}.each")
    sequence = F.col(f"{slot}.sequence") + F.floor(since / each)
    return found.select(*pieces.columns, sequence.cast("long").alias("sequence_id"), (F.col(f"{slot}.at") + F.pmod(since, each) * F.col("length")).cast("long").alias("offset"))
