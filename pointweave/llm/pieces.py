"""Sampled segmentation into pieces: forward filtering, backward sampling over the piece lattice; decoding is lossless."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pointweave.llm.common import mixed, portions

#: Spaces before other characters, or at the end: no piece has a space after another character, so none crosses these.
CHUNK = re.compile(" *[^ ]+| +")


#: Chances and draws are whole numbers of 2^-30, so a draw doesn't depend on where a chunk's states are kept.
BITS = 30


def uniform(seed: np.ndarray, occurrence: np.ndarray, step: int) -> np.ndarray:
    """Whole numbers below 2^30, a function of the row's seed, the chunk's place in it and the step alone."""
    with np.errstate(over="ignore"):
        x = mixed(seed + np.uint64(0x9E3779B97F4A7C15) * (occurrence.astype(np.uint64) + np.uint64(1)))
        x = mixed(x + np.uint64(0xD1B54A32D192ED03) * np.uint64(step + 1))
    return (x >> np.uint64(64 - BITS)).astype(np.int32)


class Trie:
    """Strings to be found at every place of a text at once: one step of all places that still match, for each length.

    The commonest characters have a column in a dense table of transitions, others a sorted list.
    """

    COLUMNS = 128

    def __init__(self, words: dict[str, int]):
        node, edges = {"": 0}, []
        for word in words:
            for n in range(1, len(word) + 1):
                if word[:n] not in node:
                    node[word[:n]] = len(node)
                    edges.append((node[word[: n - 1]], ord(word[n - 1]), node[word[:n]]))
        source, char, target = np.array(edges, np.int64).reshape(-1, 3).T
        self.word = np.full(len(node), -1, np.int64)
        self.word[[node[w] for w in words]] = list(words.values())
        seen, counts = np.unique(char, return_counts=True)
        common = seen[np.argsort(-counts, kind="stable")[: self.COLUMNS - 1]]
        self.column = np.zeros(0x110000, np.uint8)
        self.column[common] = np.arange(1, len(common) + 1)
        self.next = np.zeros((len(node), self.COLUMNS), np.int32)  # 0: no such string
        dense = self.column[char] > 0
        self.next[source[dense], self.column[char[dense]]] = target[dense]
        keys = source[~dense] << 21 | char[~dense]
        by = np.argsort(keys)
        self.keys, self.targets = keys[by], target[~dense][by]
        self.rare = np.zeros(0x110000, bool)
        self.rare[char[~dense]] = True

    def step(self, node: np.ndarray, points: np.ndarray) -> np.ndarray:
        out = self.next[node, self.column[points]]
        rare = np.flatnonzero(self.rare[points])
        if len(rare):
            key = node[rare].astype(np.int64) << 21 | points[rare]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[rare] = np.where(self.keys[at] == key, self.targets[at], 0)
        return out

    def find(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(last place, place before the first, word) of every occurrence."""
        start, node, length = np.arange(len(points)), np.zeros(len(points), np.int32), 0
        ends, starts, words = [], [], []
        while len(start):
            node = self.step(node, points[start + length])
            alive = node > 0
            start, node = start[alive], node[alive]
            word = self.word[node]
            at = np.flatnonzero(word >= 0)
            ends.append(start[at] + length)
            starts.append(start[at] - 1)
            words.append(word[at])
            length += 1
            inside = start + length < len(points)
            if not inside.all():
                start, node = start[inside], node[inside]
        return np.concatenate(ends), np.concatenate(starts), np.concatenate(words)


class PieceSampler:
    """The lattices of chunks, kept up to about keep_states states: for each the arcs into it with their cumulative chances."""

    def __init__(self, path: str, sharpness: float = 1.0, keep_states: int = 2_000_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of: list[bytes] = []
        n = model.get_piece_size()
        self.byte_id, self.weight, self.length = np.zeros(256, np.int64), np.zeros(n), np.zeros(n, np.int64)
        ranked, words = 0, {}
        for i in range(n):
            said = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes_of.append(bytes([int(said[3:-1], 16)]))
                self.byte_id[self.bytes_of[-1][0]] = i
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                ranked += 1
                shown = said.replace("▁", " ")
                self.bytes_of.append(shown.encode())
                if re.search("[^ ] ", shown) or "\0" in shown:
                    raise ValueError(f"piece {said!r} has a space after another character, or a NUL")
                # scores are merge ranks: by Zipf's law the chance falls with the rank, and a single letter is the last resort
                self.weight[i] = sharpness * -math.log(ranked + 10) if len(shown) > 1 else sharpness * -math.log(n)
                self.length[i] = len(shown)
                words[shown] = i
        self.trie, self.keep_states = Trie(words), keep_states
        self.singles = {w for w in words if len(w) == 1}
        self.spelled = np.zeros(0x110000, bool)
        self.spelled[[ord(c) for c in self.singles]] = True
        self.clear()

    def clear(self) -> None:
        """Forgets all chunks. Arcs are kept by state: the upper end of an arc's share of its state, its piece, its source."""
        self.known: dict[str, int] = {}
        self.upto, self.arc_id, self.arc_from, self.first_arc = (np.zeros(1 << 16, np.int32) for _ in range(4))
        self.states, self.arcs = 1, 0  # state 0: the start of any chunk

    def arcs_of(self, chunks: list[str]) -> tuple[np.ndarray, ...]:
        """(target, source, piece, root of the target, ends) of the lattices of chunks laid side by side.

        Nodes are a root before each chunk, the ends of its characters, and those between the bytes of
        characters that no piece spells. ends: the last node of each chunk.
        """
        joined = "\0" + "\0".join(chunks)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(c) for c in chunks], np.int64)
        roots = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]  # places of the separators
        own = np.ones(len(points), bool)
        own[roots] = False
        odd = np.flatnonzero(own & ~self.spelled[points])
        width = np.ones(len(points), np.int64)
        said = [joined[k].encode("utf-8", "surrogatepass") for k in odd.tolist()]
        width[odd] = [len(x) for x in said]
        node = np.cumsum(width) - 1
        end, before, piece = self.trie.find(points)
        target, source = node[end], node[before]
        if len(odd):
            byte = np.concatenate([np.frombuffer(x, np.uint8) for x in said])
            last = np.repeat(node[odd], width[odd])
            into = last - np.repeat(width[odd], width[odd]) + 1 + np.arange(len(byte)) - np.repeat(np.cumsum(width[odd]) - width[odd], width[odd])
            target, source, piece = np.concatenate((target, into)), np.concatenate((source, into - 1)), np.concatenate((piece, self.byte_id[byte]))
        root = np.zeros(node[-1] + 1, np.int64)
        root[node[roots]] = node[roots]
        root = np.maximum.accumulate(root)
        return target, source, piece, root, node[np.concatenate((roots[1:] - 1, [len(points) - 1]))]

    def filtered(self, chunks: list[str]) -> tuple[np.ndarray, ...]:
        """Forward filtering of many chunks at once: (target, source, piece, chance given the target, root, ends), by target.

        Arcs are taken by their targets' distance from the root, so all sources are done before them.
        """
        targets, sources, pieces, root, ends = self.arcs_of(chunks)
        by = np.argsort(targets, kind="stable")
        targets, sources, pieces = targets[by], sources[by], pieces[by]
        depth = targets - root[targets]
        turn = np.argsort(depth.astype(np.uint16) if len(depth) and depth.max() < 1 << 16 else depth, kind="stable")
        target, source, piece, depth = targets[turn], sources[turn], pieces[turn], depth[turn]
        weight, alpha, chance = self.weight[piece], np.zeros(len(root)), np.empty(len(target))
        first = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
        segment = np.cumsum(np.concatenate(([0], target[1:] != target[:-1])))
        levels = np.searchsorted(depth, np.arange(1, depth[-1] + 2)) if len(depth) else np.zeros(1, np.int64)
        for lo, hi in zip(levels[:-1].tolist(), levels[1:].tolist()):
            a, b = segment[lo], segment[hi - 1] + 1
            heads, inner = first[a:b] - lo, segment[lo:hi] - a
            score = alpha[source[lo:hi]] + weight[lo:hi]
            top = np.maximum.reduceat(score, heads)
            part = np.exp(score - top[inner])
            total = np.add.reduceat(part, heads)
            alpha[target[first[a:b]]] = top + np.log(total)
            chance[lo:hi] = part / total[inner]
        chances = np.empty(len(chance))
        chances[turn] = chance
        return targets, sources, pieces, chances, root, ends

    def keep(self, chunks: list[str]) -> None:
        """Stores the lattices of new chunks."""
        target, source, piece, chance, root, ends = self.filtered(chunks)
        start = np.concatenate(([True], target[1:] != target[:-1]))
        at = np.flatnonzero(start)
        rank = np.arange(len(target)) - at[np.cumsum(start) - 1]
        total = chance.copy()
        for r in range(1, int(rank.max(initial=0)) + 1):
            k = np.flatnonzero(rank == r)
            total[k] += total[k - 1]
        share = np.round(total * (1 << BITS)).astype(np.int64)
        share[np.concatenate((at[1:] - 1, [len(target) - 1]))] = 1 << BITS
        n = len(target)
        while self.arcs + n > len(self.upto):
            self.upto, self.arc_id, self.arc_from = (np.concatenate((x, np.zeros_like(x))) for x in (self.upto, self.arc_id, self.arc_from))
        while self.states + len(root) > len(self.first_arc):
            self.first_arc = np.concatenate((self.first_arc, np.zeros_like(self.first_arc)))
        own = slice(self.arcs, self.arcs + n)
        self.upto[own] = share
        self.arc_id[own], self.arc_from[own] = piece, np.where(root[source] == source, 0, source + self.states)
        self.first_arc[target[at] + self.states] = at + self.arcs
        self.known.update(zip(chunks, (ends + self.states).tolist()))
        self.states, self.arcs = self.states + len(root), self.arcs + n

    def sample(self, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
        """Ids of each text: from the end of each chunk an arc is drawn by its chance, back to the start."""
        chunks = [CHUNK.findall(t) for t in texts]
        before = self.states, self.arcs
        if fresh := list(set().union(*chunks) - self.known.keys()):
            self.keep(fresh)
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(chunks)), np.int32)
        sizes = np.array([len(c) for c in chunks], np.int64)
        row = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        seed = seeds[row]
        active, got, step = np.arange(len(row)), [], 0
        while len(active):
            arc, u = self.first_arc[at], uniform(seed[active], place[active], step)
            beyond = np.flatnonzero(self.upto[arc] <= u)
            while len(beyond):  # a state has few arcs
                arc[beyond] += 1
                beyond = beyond[self.upto[arc[beyond]] <= u[beyond]]
            got.append((active, self.arc_id[arc]))
            at = self.arc_from[arc]
            active, at, step = active[at > 0], at[at > 0], step + 1
        if self.states > self.keep_states:  # the first chunks stay, later ones are used once
            self.states, self.arcs = before
            for c in fresh:
                del self.known[c]
        if not got:
            return [np.zeros(0, np.int32) for _ in texts]
        owner, ids = np.concatenate([o for o, _ in reversed(got)]), np.concatenate([i for _, i in reversed(got)])
        order = np.argsort(owner, kind="stable")
        counts = np.bincount(row[owner], minlength=len(texts))
        return np.split(ids[order], np.cumsum(counts)[:-1])

    def decode(self, ids: np.ndarray) -> str:
        """The text again: pieces' spellings joined."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def sampler(path: str, sharpness: float) -> PieceSampler:
    """One sampler for all tasks of a worker."""
    return PieceSampler(path, sharpness)


def row_seed(key: object, seed: int) -> int:
    return xxhash.xxh64_intdigest(str(key), seed)


def encode(df: DataFrame, path: str, seed: int = 0, sharpness: float = 1.0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_pieces, ids_sha256, lossless[, ids]): a sampled segmentation of each text, seeded by its row key.

    The sample depends on the key, the text and the seed, not on partitions or other rows. ids_sha256 is
    over little-endian 32-bit ids. lossless: decoding gives the text again. Null texts are empty ones.
    """
    schema = "doc_id long, n_pieces long, ids_sha256 string, lossless boolean" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sampler(path, sharpness)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            found: list[tuple] = []
            for lo, hi in portions(batch.column(1)):
                texts = [t or "" for t in batch.column(1)[lo:hi].to_pylist()]
                seeds = np.array([row_seed(k, seed) for k in keys[lo:hi]], np.uint64)
                for text, ids in zip(texts, of.sample(texts, seeds)):
                    found.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), of.decode(ids) == text, *([ids.tolist()] if with_ids else ())))
            kinds = (pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int32()))
            columns = [pa.array(c, k) for c, k in zip(list(zip(*found)) or [()] * (3 + with_ids), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_pieces", "ids_sha256", "lossless", "ids"][: 4 + with_ids])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """df with the text that its ids spell, the inverse of encode; null ids have a null text, none an empty one.

    Ids that no vocabulary has are an error. Byte pieces may spell what is no UTF-8: such bytes become U+FFFD, which
    never happens to ids that encode has made of a text.
    """
    rest = [c for c in df.columns if c != out]
    fields = [df.schema[c] for c in rest]
    schema = StructType([*fields, StructField(out, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sampler(path, 1.0)
        for batch in batches:
            texts = [None if ids is None else of.decode(np.array(ids, np.int64)) for ids in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in rest], pa.array(texts, pa.string())], names=[*rest, out])

    return df.mapInArrow(run, schema)
