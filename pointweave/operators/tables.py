"""Choosing, renaming, adding and removing columns and rows of a table with a row number rid. Missing is NULL."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.errors import require
from pointweave.session import cut

RID = "rid"


def letters(index: int) -> str:
    """Spreadsheet name of a column: A to Z, AA, AB and on."""
    name = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        name = chr(65 + rest) + name
    return name


def features(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != RID]


def points(df: DataFrame, rid: str | Column, columns: Mapping[str, str | Column] | Sequence[str]) -> DataFrame:
    """A table (rid, features as doubles); NaN becomes NULL."""
    pairs = columns.items() if isinstance(columns, Mapping) else [(c, c) for c in columns]
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    clean = [F.nanvl(as_column(c).cast("double"), F.lit(None).cast("double")).alias(name) for name, c in pairs]
    return df.select(as_column(rid).cast("long").alias(RID), *clean)


def select_columns(df: DataFrame, flags: Sequence[bool]) -> DataFrame:
    """The flagged features; none or all flagged means all."""
    names = features(df)
    require(len(flags) == len(names), "one flag a column is needed")
    kept = [c for c, f in zip(names, flags) if f] or names
    return df.select(RID, *kept)


def rename_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """New names by place, trimmed; a blank or absent one becomes the column's letter."""
    own = features(df)
    new = [(names[i].strip() if i < len(names) else "") or letters(i) for i in range(len(own))]
    return df.withColumnsRenamed(dict(zip(own, new)))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    require(name in features(df), f"no column {name}")
    return df.drop(name)


def insert_column(df: DataFrame, at: int, name: str, values: DataFrame) -> DataFrame:
    """A column from values (rid, value) at a place; rows that values lacks are missing."""
    own = features(df)
    joined = df.join(values.select(RID, F.col("value").cast("double").alias(name)), RID, "left")
    return joined.select(RID, *own[:at], name, *own[at:])


def drop_rows(df: DataFrame, rids: Iterable[int]) -> DataFrame:
    return df.where(~F.col(RID).isin(list(rids)))


def drop_missing_rows(df: DataFrame) -> DataFrame:
    return df.dropna("any", subset=features(df))


def missing_counts(df: DataFrame) -> DataFrame:
    """(column, missing), one row a feature, from one pass."""
    own = features(df)
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in own])
    return counted.unpivot([], own, "column", "missing")


def missing_per_row(df: DataFrame) -> DataFrame:
    """(rid, missing)."""
    return df.select(RID, sum([F.col(c).isNull().cast("int") for c in features(df)], F.lit(0)).alias("missing"))


def sparse_columns(df: DataFrame, share: float = 0.4, at_least: bool = False) -> list[str]:
    """Features whose share of missing cells is over share (or at least share)."""
    own = features(df)
    row = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in own]).first()
    over = (lambda m: m >= share * row["_n"]) if at_least else (lambda m: m > share * row["_n"])
    return [c for c in own if row["_n"] and over(row[c])]


def drop_sparse_columns(df: DataFrame, share: float = 0.4) -> DataFrame:
    return df.drop(*sparse_columns(df, share))


def set_missing(df: DataFrame, rid: int, column: str, missing: bool = True) -> DataFrame:
    """Marks a cell missing; unmarking a missing cell makes it 0."""
    cell = F.col(RID) == rid
    value = F.lit(None).cast("double") if missing else F.coalesce(column, F.lit(0.0))
    return df.withColumn(column, F.when(cell, value).otherwise(F.col(column)))


def fill_value(df: DataFrame, rid: int, column: str, value: float) -> DataFrame:
    return df.withColumn(column, F.when(F.col(RID) == rid, F.lit(float(value))).otherwise(F.col(column)))


def fill_column(df: DataFrame, column: str, value: float) -> DataFrame:
    """Missing cells of a column become the value."""
    return df.withColumn(column, F.coalesce(column, F.lit(float(value))))


def constant(df: DataFrame, value: float) -> DataFrame:
    """Every feature becomes the value."""
    return df.select(RID, *[F.lit(float(value)).alias(c) for c in features(df)])


def sort_rows(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """By a column, missing cells last, equal ones by rid."""
    key = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    return df.orderBy(key, RID)


def page(df: DataFrame, first: int, rows: int) -> DataFrame:
    """Rows by number: a filter, which reaches the scan."""
    return df.where(F.col(RID).between(first, first + rows - 1))


def head(df: DataFrame, rows: int = 5000) -> DataFrame:
    return df.orderBy(RID).limit(rows)


def stride(df: DataFrame, total: int, most: int = 1000) -> DataFrame:
    """At most `most` evenly spaced rows of a table of rids 0 to total - 1."""
    if total <= most:
        return df
    step = total // most
    return df.where((F.col(RID) % step == 0) & (F.floor(F.col(RID) / step) < most))


def resize(df: DataFrame, rows: int, columns: int) -> DataFrame:
    """A table of rids 0 to rows - 1 and so many features: what is beyond goes, new cells are 0."""
    require(rows >= 0 and columns >= 0, "a table has no negative size")
    own = features(df)[:columns]
    new = [letters(i) for i in range(len(own), columns)]
    kept = df.where(F.col(RID) < rows).select(RID, *own, *[F.lit(0.0).alias(c) for c in new])
    there = df.agg(F.coalesce(F.max(RID) + 1, F.lit(0))).first()[0]
    more = df.sparkSession.range(min(there, rows), rows).select(F.col("id").alias(RID), *[F.lit(0.0).alias(c) for c in [*own, *new]])
    return kept.unionByName(more)


def numbered(df: DataFrame, name: str = "position") -> DataFrame:
    """df, in the order that it has, with the place of each row from 0. Each partition counts its rows, then adds those before it."""
    kept = cut(df)
    tagged = kept.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id"))
    sizes = {r["_part"]: (r["n"], r["first"]) for r in tagged.groupBy("_part").agg(F.count("*").alias("n"), F.min("_id").alias("first")).collect()}
    before, starts = 0, []
    for part in sorted(sizes):
        starts.append((part, before - sizes[part][1]))
        before += sizes[part][0]
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts or [(0, 0)], "_part int, _start long"))
    return tagged.join(offsets, "_part").select(*df.columns, (F.col("_id") + F.col("_start")).alias(name))
