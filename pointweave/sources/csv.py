"""CSV files as tables of numbers."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointweave.errors import InvalidInput
from pointweave.operators.tables import RID, letters

log = logging.getLogger(__name__)

# Cells that mean a missing value.
MISSING_TOKENS = ("", "NA", "na", "N/A", "n/a", "null", "NULL", "NaN", "nan", "-", ".", "None")

#: What a number begins with; the rest of a cell is ignored.
NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
LARGEST = 3.4028235e38


@dataclass(frozen=True)
class CsvResult:
    table: DataFrame | None
    success: bool
    error: str = ""
    total_rows: int = 0
    loaded_rows: int = 0


def parsed(cell: Column) -> Column:
    """The number that a cell begins with, or NULL; numbers beyond single precision are missing."""
    value = F.regexp_extract(cell, NUMBER, 1).try_cast("double")
    return F.when(~cell.isin(*MISSING_TOKENS) & (F.abs(value) <= LARGEST), value)


def not_numeric(cell: Column) -> Column:
    """Letters other than e, no digit and no point, or a date with a time."""
    odd = cell.rlike("[A-DF-Za-df-z]") | ~cell.rlike(r"[0-9.]") | ((F.length(cell) >= 10) & cell.contains(":") & cell.contains("-"))
    return cell.isNotNull() & ~cell.isin(*MISSING_TOKENS) & odd


def numbered(df: DataFrame) -> DataFrame:
    """A file scan with rid, the rows' numbers in order from 0: files by name, their blocks by place.

    A block's rows have consecutive ids in some task; blocks are counted, one row each, and ordered.
    """
    tagged = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    sizes = tagged.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = tagged.join(starts, ["_file", "_block"])
    return joined.select((F.col("_start") + F.col("_id") - F.col("_first")).alias(RID), *df.columns)


def read_csv(spark: SparkSession, path: str, header: bool = True, delimiter: str = ",", max_rows: int = -1, use_letters: bool = False) -> DataFrame:
    """(rid, columns) of numbers; width by the first row, short rows end in missing cells, long ones are cut.

    A column is numeric up to its first cell that isn't, and missing from there on; a column nine tenths of
    which are missing is dropped. Both take one pass over all columns.
    """
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    if not first:
        raise InvalidInput(f"{path} has no rows")
    reader = spark.read.option("sep", delimiter).option("quote", '"').option("escape", "\u0000").option("mode", "PERMISSIVE")
    names_row = spark.createDataFrame([(first[0]["value"],)], "value string").select(F.from_csv("value", ", ".join(f"c{i} string" for i in range(first[0]["value"].count(delimiter) + 1)), {"sep": delimiter}).alias("r")).select("r.*").first()
    cells = [c for c in names_row if c is not None]
    width = len(cells)
    names = [c.strip() or letters(i) for i, c in enumerate(cells)] if header and not use_letters else [letters(i) for i in range(width)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = numbered(reader.option("header", header).option("enforceSchema", True).schema(schema).csv(path))
    if max_rows >= 0:
        raw = raw.where(F.col(RID) < max_rows)
    bad = raw.agg(*[F.min(F.when(not_numeric(F.col(f"`{c}`")), F.col(RID))).alias(f"b{i}") for i, c in enumerate(names)]).first()
    value = lambda i, c: parsed(F.col(f"`{c}`")) if bad[f"b{i}"] is None else F.when(F.col(RID) < bad[f"b{i}"], parsed(F.col(f"`{c}`")))
    table = raw.select(RID, *[value(i, c).alias(c) for i, c in enumerate(names)])
    counts = table.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"m{i}") for i, c in enumerate(names)]).first()
    kept = [c for i, c in enumerate(names) if counts[f"m{i}"] * 10 < counts["n"] * 9]
    return table.select(RID, *[F.col(f"`{c}`") for c in kept])


class CsvImporter:
    """Loading with progress and cancelling, by the tags of Spark's jobs."""

    TAG = "pointweave-csv"

    def __init__(self, spark: SparkSession):
        self.spark, self.loading, self.progress = spark, False, 0.0

    def load(self, path: str, header: bool = True, delimiter: str = ",", max_rows: int = -1, progress: Callable[[float], None] | None = None) -> CsvResult:
        self.loading = True
        self.spark.addTag(self.TAG)
        try:
            total = self.spark.read.text(path).where(F.trim("value") != "").count() - header
            self._tell(0.5, progress)
            table = read_csv(self.spark, path, header, delimiter, max_rows)
            self._tell(1.0, progress)
            return CsvResult(table, True, "", total, min(total, max_rows) if max_rows >= 0 else total)
        except Exception as error:  # the result says what went wrong
            log.error("loading %s failed: %s", path, error)
            return CsvResult(None, False, str(error))
        finally:
            self.spark.removeTag(self.TAG)
            self.loading = False

    def load_async(self, path: str, done: Callable[[CsvResult], None], **options: object) -> object:
        """Loads on a thread of its own, which inherits the session's tags."""
        from pyspark import InheritableThread

        thread = InheritableThread(target=lambda: done(self.load(path, **options)))
        thread.start()
        return thread

    def cancel(self) -> None:
        self.spark.interruptTag(self.TAG)

    def _tell(self, share: float, progress: Callable[[float], None] | None) -> None:
        self.progress = share
        if progress is not None:
            progress(share)
