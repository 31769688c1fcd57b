"""Versions of models and scaled tables, as Parquet."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.errors import require
from pointweave.operators.scaling import scale_matrix
from pointweave.operators.tables import RID, features


class Folder:
    """A folder in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str) -> JavaObject:
        return self.hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(""))) if self.fs.exists(self.at("")) else []

    def has(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def place(self, name: str, write: Callable[[str], None]) -> None:
        """Writes aside, then renames: a name that is there is whole."""
        aside = f"_new-{name}"
        self.fs.delete(self.at(aside), True)
        write(f"{self.path}/{aside}")
        require(self.fs.rename(self.at(aside), self.at(name)), f"{name} couldn't be put in place")


class VersionManager:
    """Numbered models, each its centroids and labels. Numbers begin at 1 and grow."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.set_storage_path(path)

    def set_storage_path(self, path: str) -> None:
        self.folder = Folder(self.spark, path)

    def list_versions(self) -> list[int]:
        return sorted(int(n.removeprefix("version=")) for n in self.folder.names() if n.startswith("version=") and n[8:].isdigit())

    def latest_version(self) -> int:
        return max(self.list_versions(), default=0)

    def has_versions(self) -> bool:
        return bool(self.list_versions())

    def save(self, centroids: np.ndarray, labels: DataFrame, inertia: float = 0.0) -> int:
        number = self.latest_version() + 1
        rows = self.spark.createDataFrame([(i, [float(v) for v in c], float(inertia)) for i, c in enumerate(centroids)], "c int, x array<double>, inertia double")

        def write(path: str) -> None:
            rows.coalesce(1).write.parquet(f"{path}/centroids")
            labels.select(RID, "cluster").write.parquet(f"{path}/labels")

        self.folder.place(f"version={number}", write)
        return number

    def load(self, number: int) -> tuple[np.ndarray, DataFrame]:
        require(self.folder.has(f"version={number}"), f"there is no version {number}")
        base = f"{self.folder.path}/version={number}"
        rows = self.spark.read.parquet(f"{base}/centroids").orderBy("c").collect()
        return np.array([r["x"] for r in rows]), self.spark.read.parquet(f"{base}/labels")

    rollback_to_version = load
    get_available_versions = list_versions


def shape_key(rows: int, columns: int, operation: str) -> str:
    """The old name of a scaled table; tables of one shape share it."""
    return f"{rows}_{columns}_{operation}"


def content_key(df: DataFrame, operation: str) -> str:
    """A name by content: every row's hash with its number, the columns and the operation. One pass."""
    names = features(df)
    row = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(RID, *names)).alias("h")).first()
    mark = F.lit("|".join((*names, operation)))
    code = df.sparkSession.range(1).select(F.hex(F.xxhash64(F.lit(row["h"] or 0), F.lit(row["n"]), mark)).alias("k")).first()["k"]
    return f"{operation}_{code.lower()}"


class FeatureStore:
    """Scaled tables, kept if a path is set."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.set_cache_path(path)

    def set_cache_path(self, path: str | None) -> None:
        self.folder = Folder(self.spark, path) if path else None

    def cache_hit(self, key: str) -> bool:
        return self.folder is not None and self.folder.has(key)

    def preprocess(self, df: DataFrame, operation: str) -> DataFrame:
        """The table scaled by family A, from the store if it has it."""
        if self.folder is None:
            return scale_matrix(df, operation)
        key = content_key(df, operation)
        if not self.cache_hit(key):
            self.folder.place(key, lambda path: scale_matrix(df, operation).write.parquet(path))
        return self.spark.read.parquet(f"{self.folder.path}/{key}")
