"""Language identification by hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import letters

SYMBOLS, WIDTH, UNIT = 48, 512, 1_000_000


def _codes() -> np.ndarray:
    """Symbol of each code point: 0 for what is no letter, 1-26 for a-z, else one of 21 by its remainder."""
    table = np.where(letters(), 27 + np.arange(0x110000) % 21, 0).astype(np.uint8)
    table[97:123] = np.arange(1, 27)
    return table


CODES = _codes()


def trigrams(text: str) -> np.ndarray:
    """Codes of the letter trigrams, gaps between words counted as one symbol; empty if there is no letter."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    s = CODES[points].astype(np.int32)
    s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:] if len(s) > 2 else s[:0]


class Space:
    """Random +-1 letter vectors; a trigram's vector binds them by product, permuted by their place."""

    def __init__(self, seed: int = 8, width: int = WIDTH):
        letters = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SYMBOLS, width))
        self.places = [np.roll(letters, 2 - k, axis=1) for k in range(3)]
        self.row = np.full(SYMBOLS**3, -1, np.int32)
        self.vectors = np.zeros((0, width), np.float32)
        self.used = 0

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of distinct codes; each is bound once and kept."""
        fresh = codes[self.row[codes] < 0]
        if len(fresh):
            if self.used + len(fresh) > len(self.vectors):
                self.vectors = np.concatenate((self.vectors, np.zeros((max(4096, len(fresh), len(self.vectors)), self.vectors.shape[1]), np.float32)))
            a, b, c = (p[s] for p, s in zip(self.places, (fresh // SYMBOLS**2, fresh // SYMBOLS % SYMBOLS, fresh % SYMBOLS)))
            self.vectors[self.used : self.used + len(fresh)] = a * b * c
            self.row[fresh] = np.arange(self.used, self.used + len(fresh))
            self.used += len(fresh)
        return self.vectors[self.row[codes]]


def bundle(space: Space, codes: np.ndarray) -> np.ndarray:
    """The sum of the vectors of a text's trigrams."""
    counts = np.bincount(codes, minlength=SYMBOLS**3)
    own = np.nonzero(counts)[0]
    return counts[own].astype(np.float32) @ space.of(own)


def prototypes(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """A unit vector per language: the bundle of its rows' trigrams, each row weighing alike. Sums are whole numbers,
    so they don't depend on the order of rows. Rows without text, language or letters aren't learned from; a repeated
    row counts each time. Texts may be of any length: a text's trigrams are counted at once."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                if len(codes := trigrams(text.as_py())):
                    counts = np.bincount(codes)
                    own = np.nonzero(counts)[0]
                    sums.setdefault(lang, np.zeros(SYMBOLS**3, np.int64))[own] += counts[own] * UNIT // len(codes)
        space = Space()
        langs = list(sums)
        vectors = []
        for lang in langs:
            own, total = np.nonzero(sums[lang])[0], np.zeros(WIDTH, np.int64)
            for lo in range(0, len(own), 2048):
                part = own[lo : lo + 2048]
                total += sums[lang][part] @ space.of(part).astype(np.int64)
            vectors.append(total.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(vectors, pa.list_(pa.int64()))], names=["lang", "vector"])

    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL").mapInArrow(learn, "lang string, vector array<long>")
    totals = rows.select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x")).collect()
    out: dict[str, np.ndarray] = {}
    for r in totals:
        out.setdefault(r["lang"], np.zeros(WIDTH))[r["at"]] = r["x"]
    return {k: v / n for k, v in sorted(out.items()) if (n := np.linalg.norm(v))}


def identify(df: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", sharpness: float = 30.0) -> DataFrame:
    """(id, lang_pred, score): the language of the largest cosine, ties to the first by name. Score: its share of
    exp(sharpness * cosine). Without a letter, a text or a profile: und, 0. Each row is told by its text alone, so repeated
    rows and rows without an id have results like any other."""
    langs = list(profiles)
    matrix = np.array([profiles[k] for k in langs], np.float32).reshape(len(langs), WIDTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space()
        for batch in batches:
            found = []
            for text in batch.column(1):
                codes = trigrams(text.as_py()) if text.is_valid else ()
                if not langs or not len(codes):
                    found.append(("und", 0.0))
                    continue
                vector = bundle(space, codes)
                norm = np.linalg.norm(vector)
                cosines = (matrix @ vector) / norm if norm else np.zeros(len(langs))
                best = int(cosines.argmax())
                found.append((langs[best], float(1 / np.exp(sharpness * (cosines - cosines[best])).sum())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["id", "lang_pred", "score"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, lang_pred string, score double")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the folds."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
