"""Principal components: sums over the rows, an eigenproblem of the features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.errors import check_components, check_width
from pointweave.operators.tables import RID, features


def moments(df: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, scatter about it) of the complete rows. A task sends its count, sums and scatter; they are joined
    pairwise about their means, so no large sums of squares are subtracted."""
    own = features(df)
    d = len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, scatter = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) if batch.num_rows else np.zeros((0, d))
            if len(x):
                n, mean, scatter = combined((n, mean, scatter), (len(x), x.mean(axis=0), (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tolist()]), pa.array([scatter.ravel().tolist()])], names=["n", "mean", "scatter"])

    def reduce(group: pa.Table) -> pa.Table:
        total = (0, np.zeros(d), np.zeros((d, d)))
        for n, m, s in zip(group.column("n").to_pylist(), group.column("mean").to_pylist(), group.column("scatter").to_pylist()):
            total = combined(total, (n, np.array(m), np.array(s).reshape(d, d)))
        return pa.table({"n": [total[0]], "mean": [total[1].tolist()], "scatter": [total[2].ravel().tolist()]})

    kind = "n long, mean array<double>, scatter array<double>"
    parts = df.select(*own).dropna().mapInArrow(run, kind)
    # two levels, so the last group is small however many tasks there were
    for groups in (64, 1):
        parts = parts.groupBy(F.pmod(F.xxhash64("mean"), F.lit(groups)).alias("g")).applyInArrow(reduce, kind)
    row = parts.first()
    return (0, np.zeros(d), np.zeros((d, d))) if row is None else (row["n"], np.array(row["mean"]), np.array(row["scatter"]).reshape(d, d))


def combined(a: tuple, b: tuple) -> tuple:
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return b if b[0] else a
    shift = b[1] - a[1]
    return n, a[1] + shift * b[0] / n, a[2] + b[2] + np.outer(shift, shift) * a[0] * b[0] / n


@dataclass(frozen=True)
class PCAModel:
    columns: list[str]
    mean: np.ndarray
    components: np.ndarray  # one a row; the loading of the largest size is positive
    explained_variance: np.ndarray
    explained_variance_ratio: np.ndarray

    @property
    def total_explained(self) -> float:
        return float(self.explained_variance_ratio.sum())

    def _linear(self, names: list[str], weights: np.ndarray, shift: np.ndarray | None, add: np.ndarray | None) -> list[Column]:
        out = []
        for j in range(weights.shape[1]):
            terms = [(F.col(c) - F.lit(float(shift[i])) if shift is not None else F.col(c)) * F.lit(float(weights[i, j])) for i, c in enumerate(names)]
            out.append(sum(terms[1:], terms[0]) + F.lit(float(add[j]) if add is not None else 0.0))
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """(rid, pc1, ...): centred rows along the components; one expression each."""
        check_width(len(features(df)), len(self.columns))
        return df.select(RID, *[c.alias(f"pc{j + 1}") for j, c in enumerate(self._linear(self.columns, self.components.T, self.mean, None))])

    def inverse_transform(self, scores: DataFrame) -> DataFrame:
        """(rid, features) of scores."""
        names = features(scores)
        check_width(len(names), len(self.components))
        return scores.select(RID, *[c.alias(n) for n, c in zip(self.columns, self._linear(names, self.components, None, self.mean))])


def fit(df: DataFrame, components: int) -> PCAModel:
    own = features(df)
    n, mean, scatter = moments(df)
    check_components(components, n, len(own))
    values, axes = np.linalg.eigh(scatter / (n - 1))
    order = np.argsort(values)[::-1]
    values, axes = np.maximum(values[order], 0), axes[:, order].T
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    total = values.sum()
    return PCAModel(own, mean, axes[:components], values[:components], values[:components] / total if total else np.zeros(components))


def fit_transform(df: DataFrame, components: int) -> tuple[PCAModel, DataFrame]:
    model = fit(df, components)
    return model, model.transform(df)


def covariances(df: DataFrame) -> DataFrame:
    """(a, b, cov) of features a and b, a not after b by place."""
    own = features(df)
    pairs = [(a, b) for i, a in enumerate(own) for b in own[i:]]
    row = df.agg(*[F.covar_samp(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("cov")) for i, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")
