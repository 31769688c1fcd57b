"""Tables in which one key, id or text has most of the rows."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.llm import packing, similar, simhash, suffixes, winnow
from pointweave.llm.common import cut, hot_join
from tests.llm.test_operators import prose


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(8)


def test_rows_of_a_hot_key_meet_its_class_where_they_are(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") < 15_000, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")).repartition(8)
    classes = cut(rows.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("least")))
    found = hot_join(rows, classes, "k", 20_000)
    assert Counter(r["least"] for r in found.collect()) == Counter([0] * 15_000 + list(range(15_000, 20_000)))
    sizes = Counter(r[0] for r in found.select(F.spark_partition_id()).collect())
    assert max(sizes.values()) < 6_000


@pytest.mark.parametrize("hot", ["", None, "the same text in very many documents, again and again"])
def test_one_text_in_most_rows(spark, hot):
    rng = random.Random(1)
    rows = [(i, hot) for i in range(12_000)] + [(None, hot)] * 3_000 + [(20_000 + i, prose(rng, 30)) for i in range(50)]
    df = frame(spark, rows)
    components = Counter(r["component"] for r in simhash.near_duplicates(df).collect())
    assert components[0] == 15_000 and len(components) == 51
    found = Counter(r["component"] for r in similar.near_duplicates(df).collect())
    assert found[0] == 15_000 and len(found) == 51
    removed = suffixes.remove_repeats(df).agg(F.sum("n_removed"), F.count("*"), F.count_if(F.col("n_spans") > 0)).first()
    size = len((hot or "").encode())
    assert tuple(removed) == ((size * 11_999, 15_050, 11_999) if size >= 50 else (0, 15_050, 0))
    near = winnow.compare_with_next(df).agg(F.count("*"), F.count_if(F.col("near_next") == 1.0)).first()
    assert near[0] == 15_050 and near[1] >= 14_990


def test_one_id_in_most_rows(spark):
    rng = random.Random(2)
    rows = [(7, f"{prose(rng, 12)} {i}") for i in range(6_000)] + [(8 + i, prose(rng, 20)) for i in range(50)]
    df = frame(spark, rows)
    assert winnow.compare_with_next(df).count() == len(rows)
    assert suffixes.remove_repeats(df, block_bytes=20_000).agg(F.sum("n_removed")).first()[0] == 0
    assert similar.near_duplicates(df).count() == len(rows)


def test_equal_pieces_take_places_of_their_own(spark):
    pieces = spark.range(30_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.when(F.col("id") < 25_000, 700).otherwise(F.col("id") % 900 + 1).cast("long").alias("length"), F.lit(0).cast("long").alias("rank"), F.lit("x").alias("cell"))
    packed = packing.pack(pieces.repartition(6))
    assert packed.columns == [*pieces.columns, "sequence_id", "offset"]
    rows = packed.select("sequence_id", "offset", "length").toPandas().sort_values(["sequence_id", "offset"])
    ends = rows.offset + rows.length
    same = rows.sequence_id.values[1:] == rows.sequence_id.values[:-1]
    assert (rows.offset.values[1:][same] == ends.values[:-1][same]).all() and (rows.offset.values[1:][~same] == 0).all() and ends.max() <= 4096
    assert rows.sequence_id.nunique() <= np.ceil(rows.length.sum() / 4096) * 1.2


def test_sums_before_each_row_in_two_levels(spark):
    rng = random.Random(3)
    rows = [(k, c, rng.randrange(1, 9)) for k in (1, 2, 3) for c in range(k * 40)]
    found = packing.before_each(spark.createDataFrame(rows, "of long, cell int, n long"), "of", "cell", width=7).collect()
    assert {(r["of"], r["cell"]): r["before"] for r in found} == {(k, c): sum(n for j, d, n in rows if j == k and d < c) for k, c, _ in rows}
