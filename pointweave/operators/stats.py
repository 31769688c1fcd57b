"""Column statistics and exact order statistics without a global sort."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.operators.tables import RID, features


#: Half the width of a guessed interval, as a share of the valid cells.
GUESS = 1e-3


@dataclass
class _Target:
    column: str
    rank: int
    low: float
    high: float
    below: int = 0


def order_statistics(df: DataFrame, ranks: Sequence[tuple[str, int]], bins: int = 1024) -> list[float | None]:
    """The value at a rank (from 0) among the valid cells of a column, for several ranks at once.

    A sketch guesses a narrow interval for each; where a count shows that it holds the rank, the passes start
    there, else from the whole column. Each pass counts every target's interval in bins and goes on inside the bin that holds the rank, with
    the bin's least and largest value as the new interval. All targets share a pass; what reaches the
    driver is bins times targets at most, whatever the table holds.
    """
    if not ranks:
        return []
    names = list(dict.fromkeys(c for c, _ in ranks))
    at = {c: sorted({r for d, r in ranks if d == c}) for c in names}
    ends = df.agg(*[f(c).alias(f"{f.__name__}{i}") for i, c in enumerate(names) for f in (F.min, F.max, F.count)]).first()
    # a sketch of the column guesses an interval around each rank; the first pass counts what lies below it
    chances = {c: [min(1.0, max(0.0, (r + 0.5) / max(1, ends[f"count{i}"]) + s)) for r in at[c] for s in (-GUESS, GUESS)] for i, c in enumerate(names)}
    guessed = df.agg(*[F.percentile_approx(c, chances[c], int(2 / GUESS)).alias(f"q{i}") for i, c in enumerate(names)]).first()
    guess = {(c, r): guessed[f"q{i}"][2 * k : 2 * k + 2] if guessed[f"q{i}"] else (None, None) for i, c in enumerate(names) for k, r in enumerate(at[c])}
    known = [(i, c, k, guess[c, r]) for i, c in enumerate(names) for k, r in enumerate(at[c]) if guess[c, r][0] is not None]
    counts = [f.alias(f"{e}{i}_{k}") for i, c, k, (low, high) in known for e, f in (("below", F.count_if(F.col(c) < F.lit(low))), ("upto", F.count_if(F.col(c) <= F.lit(high))))]
    counted = df.agg(*counts).first() if counts else {}
    targets = []
    for c, r in ranks:
        i, k, (low, high) = names.index(c), at[c].index(r), guess[c, r]
        if low is not None and counted[f"below{i}_{k}"] <= r < counted[f"upto{i}_{k}"]:
            targets.append(_Target(c, r, low, high, counted[f"below{i}_{k}"]))
        else:
            targets.append(_Target(c, r, ends[f"min{i}"], ends[f"max{i}"]))
    while todo := [(i, t) for i, t in enumerate(targets) if t.low is not None and t.low < t.high]:
        cells = []
        for i, t in todo:
            v = F.col(t.column)
            share = F.lit(1.0 / bins) * (t.high / 2 - t.low / 2)
            at_bin = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((v / 2 - t.low / 2) / share))).cast("int")
            cells.append(F.when(v.between(t.low, t.high), F.struct(F.lit(i).alias("t"), at_bin.alias("b"), v.alias("v"))))
        one = df.select(F.explode(F.array_compact(F.array(*cells))).alias("c"))
        found = one.groupBy("c.t", "c.b").agg(F.count("*").alias("n"), F.min("c.v").alias("low"), F.max("c.v").alias("high")).collect()
        for i, t in todo:
            for r in sorted((r for r in found if r["t"] == i), key=lambda r: r["b"]):
                if t.below + r["n"] > t.rank:
                    t.low, t.high = r["low"], r["high"]
                    break
                t.below += r["n"]
    return [t.low for t in targets]


def column_stats(df: DataFrame) -> DataFrame:
    """(column, count, missing, mean, std, min, max, q1, median, q3) of each feature.

    count holds missing cells too; std is the sample's, 0 for one value; quartiles are
    sorted[floor(p * (valid - 1))], so they are values of the column.
    """
    names = features(df)
    row = df.agg(
        F.count("*").alias("n"),
        *[f(c).alias(f"{label}{i}") for i, c in enumerate(names) for label, f in (("valid", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))],
    ).first()
    quarters = [(c, p, math.floor(p * (row[f"valid{i}"] - 1))) for i, c in enumerate(names) if row[f"valid{i}"] for p in (0.25, 0.5, 0.75)]
    values = dict(zip([(c, p) for c, p, _ in quarters], order_statistics(df, [(c, r) for c, _, r in quarters])))
    rows = [
        (c, row["n"], row["n"] - row[f"valid{i}"], row[f"mean{i}"], 0.0 if row[f"valid{i}"] == 1 else row[f"std{i}"], row[f"min{i}"], row[f"max{i}"], *[values.get((c, p)) for p in (0.25, 0.5, 0.75)])
        for i, c in enumerate(names)
    ]
    return df.sparkSession.createDataFrame(rows, "column string, count long, missing long, mean double, std double, min double, max double, q1 double, median double, q3 double")


class ColumnStatsCache:
    """Statistics of a table's columns, computed when first asked for."""

    def __init__(self, df: DataFrame):
        self.set_data(df)

    def set_data(self, df: DataFrame) -> None:
        self.df, self.known = df, {}

    def invalidate(self) -> None:
        self.known.clear()

    def invalidate_column(self, column: str) -> None:
        self.known.pop(column, None)

    def get(self, column: str) -> dict:
        if column not in self.known:
            self.known[column] = column_stats(self.df.select(RID, column)).first().asDict()
        return self.known[column]

    def sample_for_histogram(self, column: str, most: int = 1000) -> DataFrame:
        return histogram_sample(self.df, column, most)


def histogram_sample(df: DataFrame, column: str, most: int = 1000) -> DataFrame:
    """All valid cells, or every step-th row's if there are more than `most`; always the same ones."""
    n = df.agg(F.count(column)).first()[0]
    step = max(1, n // most)
    return df.where(F.col(column).isNotNull() & (F.col(RID) % step == 0)).select(RID, column)


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, n) of equal ranges between the least and largest value, which is in the last."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    width = (high - low) / bins if low is not None and high > low else 1.0
    at = F.least(F.floor((F.col(column) - F.lit(low)) / width), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
