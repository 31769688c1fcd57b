"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.session import cut, drop, shared_dir

__all__ = ["cut", "drop", "free_names", "hot_join", "letters", "mixed", "parts", "portions", "shared_dir", "small", "small_batches", "table", "text_or_empty"]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table; the scan reads only these."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


def small_batches(spark: SparkSession, most_bytes: int = 4_000_000) -> None:
    """Sets the session to send Arrow batches of most_bytes at most to Python, if it is set to larger ones.

    A batch is held several times over, outside of the heap and in the worker, beside what an operator holds itself.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("bB")) > most_bytes:
        spark.conf.set(key, f"{most_bytes}b")


def parts(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Partitions for so many rows: rows_each in one, but no fewer than the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / max(1, rows_each)))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def portions(texts: pa.Array, most_bytes: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about most_bytes together, a longer text by itself."""
    lo = total = 0
    for at, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if at > lo and total + n > most_bytes:
            yield lo, at
            lo, total = at, 0
        total += n
    if lo < len(texts):
        yield lo, len(texts)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until df has no such column, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): equal numbers give equal, other numbers unrelated results."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def small(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """A checkpointed table of a few numbers a row, marked for broadcast if it has most_rows at most; else as it is."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def hot_join(rows: DataFrame, classes: DataFrame, key: str, total: int, how: str = "inner", share: int = 1000) -> DataFrame:
    """rows joined with classes, one row a key, whose column n counts the key's rows among `total`.

    Keys of more than 1/share of all rows are share at most, so their classes are broadcast; no key of
    the others is large, and they meet in a shuffle. classes is a checkpoint, as it is read twice.
    """
    hot = classes.where(F.col("n") * share > total + share)
    marked = rows.join(F.broadcast(hot.select(F.col(key).alias("_hot"))), F.col(key) == F.col("_hot"), "left")
    there = marked.where("_hot IS NOT NULL").drop("_hot").join(F.broadcast(hot.drop("n")), key)
    return there.unionByName(marked.where("_hot IS NULL").drop("_hot").join(classes.drop("n"), key, how), allowMissingColumns=True)
