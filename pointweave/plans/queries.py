"""A query for each operator over the shared test tables, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.functions.vectors import doubles, l2, vector_of, zeroless
from pointweave.operators import dbscan, distances, kmeans, metrics, missing, pca, plots, scaling, stats, sweeps, tables, tsne
from pointweave.operators.missing import Strategy
from pointweave.operators.tables import RID
from pointweave.plans.history import History
from pointweave.session import shared_dir
from pointweave.sources import exports, store
from pointweave.sources.csv import CsvImporter, read_csv
from pointweave.streaming import drift, online

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


# The tables that queries work on, and the same in SQL.
PART_SQL = "SELECT p_partkey AS rid, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part"
UNIT_SQL = "SELECT p_partkey AS rid, p_size / 50.0 AS x, p_retailprice / 1000.0 AS y FROM part"
GAPS_SQL = "SELECT event_id AS rid, CASE WHEN event_id % 7 <> 0 THEN value END AS value, CASE WHEN event_id % 3 <> 0 THEN CAST(user_id AS DOUBLE) END AS usr, CASE WHEN event_id % 2 = 1 THEN value END AS half FROM events"
EMB_SQL = "SELECT vec_id AS rid, CAST(embedding AS DOUBLE[]) AS x, label AS cluster FROM embeddings"
CENTRES_SQL = "SELECT c, list(m ORDER BY pos) AS p FROM (SELECT cluster AS c, pos, avg(x[pos]) AS m FROM emb, (SELECT unnest(range(1, 65)) AS pos) GROUP BY cluster, pos) GROUP BY c"
SUPPLIER_SQL = """SELECT s_suppkey AS rid, (s_acctbal - (SELECT avg(s_acctbal) FROM supplier)) / (SELECT stddev_pop(s_acctbal) FROM supplier) AS x,
    (s_nationkey - (SELECT avg(s_nationkey) FROM supplier)) / (SELECT stddev_pop(s_nationkey) FROM supplier) AS y FROM supplier"""


def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.points(read(spark, sf_dir, "part"), "p_partkey", {"size": "p_size", "price": "p_retailprice"})


def unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.points(read(spark, sf_dir, "part"), "p_partkey", {"x": F.col("p_size") / 50.0, "y": F.col("p_retailprice") / 1000.0})


def unit_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances.vectors(unit(spark, sf_dir))


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    cells = {"value": F.when(e % 7 != 0, F.col("value")), "usr": F.when(e % 3 != 0, F.col("user_id")), "half": F.when(e % 2 == 1, F.col("value"))}
    return tables.points(read(spark, sf_dir, "events"), "event_id", cells)


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(RID), doubles("embedding").alias("x"), F.col("label").alias("cluster"))


def supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.points(read(spark, sf_dir, "supplier"), "s_suppkey", {"x": "s_acctbal", "y": "s_nationkey"})


def label_centres(labelled: DataFrame) -> np.ndarray:
    found = metrics.centres(labelled)
    return np.array([found[c] for c in sorted(found)])


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[zeroless(F.col(c), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_sql(columns: str, places: int = 6) -> str:
    return ", ".join(f"round({c}, {places}) + 0.0 AS {c}" for c in columns.split())


# --- the minimum slice


@query(
    "assign_label_centroids",
    f"""WITH emb AS ({EMB_SQL}), k AS ({CENTRES_SQL}),
    d AS (SELECT e.rid, k.c, list_distance(e.x, k.p) AS dist FROM emb e, k),
    n AS (SELECT rid, c, dist, row_number() OVER (PARTITION BY rid ORDER BY dist, c) AS r FROM d)
    SELECT CAST(c AS INTEGER) AS cluster, count(*) AS n, round(sum(dist * dist), 6) + 0.0 AS inertia FROM n WHERE r = 1 GROUP BY c""",
)
def assign_label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = emb(spark, sf_dir)
    return rounded(distances.assigned(e, label_centres(e)).groupBy("cluster").agg(F.count("*").alias("n"), F.sum("d2").alias("inertia")))


# --- sources and sinks


@query("csv_roundtrip", f"SELECT CAST(rid AS BIGINT) AS rid, {rounded_sql('size price')} FROM ({PART_SQL})")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    exports.export_table(part(spark, sf_dir), path, single=True)
    return rounded(read_csv(spark, path))


CSV_CELLS = {"num": "CASE WHEN p_partkey % 11 = 0 THEN 'NA' WHEN p_partkey % 13 = 0 THEN concat(p_size, '.5%') ELSE CAST(p_size AS STRING) END", "late": "CASE WHEN p_partkey = 100 THEN 'abc' ELSE CAST(p_size AS STRING) END", "word": "p_name", "date": "concat('2021-03-', p_size)", "rare": "CASE WHEN p_partkey % 10 = 0 THEN '1e5' ELSE 'null' END", "big": "CASE WHEN p_partkey % 5 = 0 THEN '1e60' ELSE '+2' END"}


@query(
    "csv_typing",
    """SELECT CAST(p_partkey AS BIGINT) AS rid, CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN p_size + 0.5 ELSE CAST(p_size AS DOUBLE) END AS num,
    2021.0::DOUBLE AS date, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE 2.0::DOUBLE END AS big,
    CASE WHEN (SELECT count(*) FROM part) <= 1000 AND p_partkey < 100 THEN CAST(p_size AS DOUBLE) END AS late FROM part""",
)
def csv_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, prefixes, numbers out of range, a column that turns to words at row 100, and sparse columns that are dropped."""
    path = scratch(spark)
    cells = read(spark, sf_dir, "part").selectExpr("p_partkey", *[f"{v} AS {k}" for k, v in CSV_CELLS.items()])
    cells.orderBy("p_partkey").drop("p_partkey").coalesce(1).write.option("header", True).csv(path)
    found = read_csv(spark, path)
    return found.select(RID, "num", "date", "big", (F.col("late") if "late" in found.columns else F.lit(None).cast("double")).alias("late"))


@query("csv_ragged", "SELECT CAST(p_partkey AS BIGINT) AS rid, CAST(p_partkey AS DOUBLE) AS key, CAST(p_size AS DOUBLE) AS size, CASE WHEN p_partkey % 3 <> 0 OR p_partkey = 0 THEN CAST(p_size + 1 AS DOUBLE) END AS more FROM part")
def csv_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows too short, whose last cell is missing, and too long, whose last cell is cut; blank lines between."""
    path = scratch(spark)
    cells = "CASE WHEN p_partkey % 3 = 0 AND p_partkey > 0 THEN concat(p_partkey, ',', p_size) WHEN p_partkey % 3 = 1 THEN concat(p_partkey, ',', p_size, ',', p_size + 1, ',99,98') ELSE concat(p_partkey, ',', p_size, ',', p_size + 1) END"
    lines = read(spark, sf_dir, "part").selectExpr("p_partkey AS at", f"concat({cells}, CASE WHEN p_partkey % 5 = 0 THEN '\n' ELSE '' END) AS value")
    header = spark.createDataFrame([(-1, "key,size,more")], "at long, value string")
    header.unionByName(lines).orderBy("at").select("value").coalesce(1).write.text(path)
    return read_csv(spark, path)


@query("csv_lines", "SELECT count(*) AS total, least(count(*), 70) AS loaded, true AS success FROM part")
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an import says of itself: rows there are, and rows it has taken."""
    path = scratch(spark)
    exports.export_table(part(spark, sf_dir), path, single=True)
    result = CsvImporter(spark).load(path, max_rows=70)
    return spark.createDataFrame([(result.total_rows, result.table.count(), result.success)], "total long, loaded long, success boolean")


@query("csv_max_rows", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(max(p_partkey) AS BIGINT) AS last FROM part WHERE p_partkey < 50")
def csv_max_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    exports.export_table(part(spark, sf_dir), path, single=True)
    return read_csv(spark, path, max_rows=50).agg(F.count("*").alias("n"), F.max(RID).alias("last"))


@query("export_labels", "SELECT CAST(vec_id AS BIGINT) AS id, CAST(label AS VARCHAR) AS cluster FROM embeddings")
def export_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    exports.export_labels(emb(spark, sf_dir), path)
    return spark.read.option("header", True).schema("id long, cluster string").csv(path)


@query("export_centroids", f"WITH emb AS ({EMB_SQL}), k AS ({CENTRES_SQL}) SELECT printf('%.6f', p[1]) AS f0, printf('%.6f', p[64]) AS f63 FROM k")
def export_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    exports.export_centroids(spark, label_centres(emb(spark, sf_dir)).tolist(), path)
    return spark.read.option("header", True).csv(path).select("f0", "f63")


@query("export_table", f"SELECT CAST(rid AS BIGINT) AS rid, printf('%.6f', value) AS value, printf('%.6f', usr) AS usr FROM ({GAPS_SQL})")
def export_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.table_lines(gaps(spark, sf_dir).select(RID, "value", "usr"))


@query("version_latest", f"WITH emb AS ({EMB_SQL}), k AS ({CENTRES_SQL}) SELECT CAST(2 AS INTEGER) AS version, CAST(c AS INTEGER) AS c, round(p[1], 6) + 0.0 AS first, (SELECT count(*) FROM emb WHERE cluster = c) AS n FROM k")
def version_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, manager = emb(spark, sf_dir), store.VersionManager(spark, scratch(spark))
    manager.save(label_centres(e) * 0, e)
    centroids, labels = manager.load(manager.save(label_centres(e), e))
    rows = spark.createDataFrame([(manager.latest_version(), i, float(c[0])) for i, c in enumerate(centroids)], "version int, c int, first double")
    return rounded(rows.join(labels.groupBy(F.col("cluster").alias("c")).agg(F.count("*").alias("n")), "c"))


@query("feature_store", f"SELECT CAST(rid AS BIGINT) AS rid, round((size - min(size) OVER ()) / (max(size) OVER () - min(size) OVER ()), 6) + 0.0 AS size, round((price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ()), 6) + 0.0 AS price FROM ({PART_SQL})")
def feature_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = store.FeatureStore(spark, scratch(spark))
    kept.preprocess(part(spark, sf_dir), "minmax")
    return rounded(kept.preprocess(part(spark, sf_dir), "minmax"))


# --- tables


@query("select_columns", f"SELECT CAST(rid AS BIGINT) AS rid, price FROM ({PART_SQL})")
def select_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.select_columns(part(spark, sf_dir), [False, True])


@query("rename_columns", f'SELECT CAST(rid AS BIGINT) AS rid, size AS "A", price AS cost FROM ({PART_SQL})')
def rename_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.rename_columns(part(spark, sf_dir), [" ", " cost "])


@query("drop_column", f"SELECT CAST(rid AS BIGINT) AS rid, price FROM ({PART_SQL})")
def drop_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.drop_column(part(spark, sf_dir), "size")


@query("insert_column", f"SELECT CAST(rid AS BIGINT) AS rid, size, CASE WHEN rid % 2 = 0 THEN CAST(rid AS DOUBLE) END AS even, price FROM ({PART_SQL})")
def insert_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = part(spark, sf_dir)
    return tables.insert_column(p, 1, "even", p.where("rid % 2 = 0").select(RID, F.col(RID).cast("double").alias("value")))


@query("drop_row", f"SELECT CAST(rid AS BIGINT) AS rid, size, price FROM ({PART_SQL}) WHERE rid NOT IN (3, 5)")
def drop_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.drop_rows(part(spark, sf_dir), [3, 5])


@query("drop_missing_rows", f"SELECT CAST(rid AS BIGINT) AS rid, value, usr, half FROM ({GAPS_SQL}) WHERE value IS NOT NULL AND usr IS NOT NULL AND half IS NOT NULL")
def drop_missing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing.fill(gaps(spark, sf_dir), Strategy.DROP_ROWS)


@query("drop_sparse_columns", f"SELECT CAST(rid AS BIGINT) AS rid, value, usr FROM ({GAPS_SQL})")
def drop_sparse_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing.fill(gaps(spark, sf_dir), Strategy.DROP_COLUMNS)


@query("missing_counts", f"WITH g AS ({GAPS_SQL}) SELECT 'value' AS \"column\", count(*) - count(value) AS missing FROM g UNION ALL SELECT 'usr', count(*) - count(usr) FROM g UNION ALL SELECT 'half', count(*) - count(half) FROM g")
def missing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.missing_counts(gaps(spark, sf_dir))


@query("missing_per_row", f"SELECT CAST(rid AS BIGINT) AS rid, CAST((value IS NULL)::INT + (usr IS NULL)::INT + (half IS NULL)::INT AS INTEGER) AS missing FROM ({GAPS_SQL})")
def missing_per_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.missing_per_row(gaps(spark, sf_dir))


@query("edit_cells", f"SELECT CAST(rid AS BIGINT) AS rid, CASE rid WHEN 0 THEN 0.0 WHEN 1 THEN NULL WHEN 2 THEN 9.5 ELSE value END AS value, coalesce(usr, -1.0) AS usr FROM ({GAPS_SQL})")
def edit_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = gaps(spark, sf_dir).select(RID, "value", "usr")
    t = tables.set_missing(t, 0, "value", False)
    t = tables.set_missing(t, 1, "value")
    return tables.fill_column(tables.fill_value(t, 2, "value", 9.5), "usr", -1.0)


@query("constant_matrix", f"SELECT CAST(rid AS BIGINT) AS rid, CAST(2.5 AS DOUBLE) AS size, CAST(2.5 AS DOUBLE) AS price FROM ({PART_SQL})")
def constant_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.constant(part(spark, sf_dir), 2.5)


@query("sort_rows", f"SELECT row_number() OVER (ORDER BY value DESC NULLS LAST, rid) - 1 AS position, CAST(rid AS BIGINT) AS rid, value FROM ({GAPS_SQL})")
def sort_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.numbered(tables.sort_rows(gaps(spark, sf_dir).select(RID, "value"), "value", descending=True)).select("position", RID, "value")


@query("matrix_resize", f"WITH p AS ({PART_SQL}), n AS (SELECT count(*) AS n FROM p) SELECT i AS rid, CASE WHEN p.rid IS NULL THEN 0 ELSE p.size END AS size, CASE WHEN p.rid IS NULL THEN 0 ELSE p.price END AS price, 0.0::DOUBLE AS \"C\" FROM (SELECT unnest(range(0, n + 25)) AS i FROM n) LEFT JOIN p ON p.rid = i")
def matrix_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = part(spark, sf_dir)
    return tables.resize(p, p.count() + 25, 3)


@query("page_rows", f"SELECT CAST(rid AS BIGINT) AS rid, size, price FROM ({PART_SQL}) WHERE rid BETWEEN 100 AND 149")
def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.page(part(spark, sf_dir), 100, 50)


@query("head_sample", f"SELECT CAST(rid AS BIGINT) AS rid, size, price FROM ({PART_SQL}) ORDER BY rid LIMIT 500")
def head_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.head(part(spark, sf_dir), 500)


@query("stride_sample", "WITH g AS (SELECT event_id AS rid, value, greatest((SELECT count(*) FROM events) // 1000, 1) AS step FROM events) SELECT CAST(rid AS BIGINT) AS rid, value FROM g WHERE rid % step = 0 AND rid // step < 1000")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.points(read(spark, sf_dir, "events"), "event_id", ["value"])
    return tables.stride(e, e.count())


@query("undo_redo", f"SELECT CAST(rid AS BIGINT) AS rid, size FROM ({PART_SQL}) WHERE rid <> 1")
def undo_redo(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = History(part(spark, sf_dir))
    h.apply("drop row", lambda t: tables.drop_rows(t, [1]))
    h.apply("drop column", lambda t: tables.drop_column(t, "size"))
    h.undo_all()
    h.redo()
    h.apply("drop column", lambda t: tables.drop_column(t, "price"))
    h.undo()
    return h.redo()


# --- statistics


def _stats_sql(column: str) -> str:
    at = lambda p: f"(list_sort(list(v) FILTER (WHERE v IS NOT NULL)))[CAST(floor({p} * (count(v) - 1)) AS BIGINT) + 1]"
    return f"SELECT '{column}' AS \"column\", count(*) AS count, count(*) - count(v) AS missing, round(avg(v), 4) + 0.0 AS mean, round(stddev_samp(v), 4) + 0.0 AS std, min(v) AS min, max(v) AS max, {at(0.25)} AS q1, {at(0.5)} AS median, {at(0.75)} AS q3"


@query("column_stats", " UNION ALL ".join(f"{_stats_sql(n)} FROM (SELECT {c} AS v FROM lineitem)" for n, c in (("quantity", "l_quantity"), ("price", "l_extendedprice"), ("discount", "l_discount"), ("tax", "l_tax"))))
def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = tables.points(read(spark, sf_dir, "lineitem"), "l_orderkey", {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"})
    found = stats.column_stats(line)
    return found.withColumns({c: zeroless(F.col(c), 4) for c in ("mean", "std")})


@query("column_stats_missing", " UNION ALL ".join(f"{_stats_sql(c)} FROM (SELECT {c} AS v FROM ({GAPS_SQL}))" for c in ("value", "usr", "half")))
def column_stats_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.column_stats(gaps(spark, sf_dir)).withColumns({c: zeroless(F.col(c), 4) for c in ("mean", "std")})


@query("histogram_sample", f"WITH g AS (SELECT *, greatest(count(value) OVER () // 1000, 1) AS step FROM ({GAPS_SQL})) SELECT CAST(rid AS BIGINT) AS rid, value FROM g WHERE value IS NOT NULL AND rid % step = 0")
def histogram_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram_sample(gaps(spark, sf_dir), "value")


@query("histogram", f"WITH g AS (SELECT value AS v, min(value) OVER () AS lo, (max(value) OVER () - min(value) OVER ()) / 10 AS w FROM ({GAPS_SQL}) WHERE value IS NOT NULL) SELECT CAST(least(floor((v - lo) / w), 9) AS INTEGER) AS bin, count(*) AS n FROM g GROUP BY 1")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(gaps(spark, sf_dir), "value")


# --- scaling

SUMS = ("quantity", "price", "flat")
LINE_SQL = "SELECT l_orderkey AS rid, l_quantity AS quantity, l_extendedprice AS price, CAST(3 AS DOUBLE) AS flat FROM lineitem"


def _line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.points(read(spark, sf_dir, "lineitem"), "l_orderkey", {"quantity": "l_quantity", "price": "l_extendedprice", "flat": F.lit(3.0)})


def _digest(df: DataFrame) -> DataFrame:
    """Sums over scaled columns: lineitem has no key to compare rows by."""
    return df.agg(*[zeroless(f, 4).alias(f"{k}_{c}") for c in SUMS for k, f in (("sum", F.sum(c)), ("sq", F.sum(F.col(c) * F.col(c))), ("low", F.min(c)), ("high", F.max(c)))])


def _digest_sql(new: dict[str, str]) -> str:
    columns = ", ".join(f"{new[c]} AS {c}" for c in SUMS)
    digest = ", ".join(f"round({f}, 4) + 0.0 AS {k}_{c}" for c in SUMS for k, f in (("sum", f"sum({c})"), ("sq", f"sum({c} * {c})"), ("low", f"min({c})"), ("high", f"max({c})")))
    return f"WITH l AS ({LINE_SQL}), s AS (SELECT {columns} FROM l) SELECT {digest} FROM s"


MATRIX_SQL = {
    "normalize": "CASE WHEN sqrt(sum({c} * {c}) OVER ()) > 0 THEN {c} / sqrt(sum({c} * {c}) OVER ()) ELSE 0 END",
    "standardize": "CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0 END",
    "minmax": "CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE 0 END",
}
for _name, _sql in MATRIX_SQL.items():
    query(f"scale_matrix_{_name}", _digest_sql({c: _sql.format(c=c) for c in SUMS}))(lambda spark, sf_dir, op=_name: _digest(scaling.scale_matrix(_line(spark, sf_dir), op)))

query("scale_matrix_unknown", _digest_sql({c: c for c in SUMS}))(lambda spark, sf_dir: _digest(scaling.scale_matrix(_line(spark, sf_dir), "whiten")))

CLIP_SQL = "least(greatest({c}, (SELECT (list_sort(list({c})))[CAST(floor(0.01 * (count({c}) - 1)) AS BIGINT) + 1] FROM g)), (SELECT (list_sort(list({c})))[CAST(floor(0.99 * (count({c}) - 1)) AS BIGINT) + 1] FROM g))"
COLUMN_SQL = {
    "normalize": "{c} / sqrt(sum({c} * {c}) OVER ())",
    "standardize": "({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()",
    "minmax": "({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())",
    "log": "ln(greatest({c}, 1e-10))",
    "clip": f"CASE WHEN {{c}} IS NOT NULL THEN {CLIP_SQL} END",
}
BAL_SQL = "SELECT c_custkey AS rid, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS bal, CAST(0 AS DOUBLE) AS zero FROM customer"


def _balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.points(read(spark, sf_dir, "customer"), "c_custkey", {"bal": F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")), "zero": F.lit(0.0)})


for _name, _sql in COLUMN_SQL.items():
    _bal = _sql.format(c="bal").replace("ln(greatest(bal", "CASE WHEN bal IS NOT NULL THEN ln(greatest(bal") + (" END" if _name == "log" else "")
    _zero = "ln(1e-10)" if _name == "log" else "zero"
    query(f"scale_columns_{_name}", f"WITH g AS ({BAL_SQL}) SELECT CAST(rid AS BIGINT) AS rid, round({_bal}, 6) + 0.0 AS bal, round({_zero}, 6) + 0.0 AS zero FROM g")(lambda spark, sf_dir, op=_name: rounded(scaling.scale_columns(_balances(spark, sf_dir), op)))


@query("scale_one_column", f"SELECT CAST(rid AS BIGINT) AS rid, size, round({COLUMN_SQL['minmax'].format(c='price')}, 6) + 0.0 AS price FROM ({PART_SQL})")
def scale_one_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scaling.scale_columns(part(spark, sf_dir), "minmax", ["price"]))


@query("dbscan_scaling", f"SELECT CAST(rid AS BIGINT) AS rid, {rounded_sql('x y')} FROM ({SUPPLIER_SQL})")
def dbscan_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scaling.z_scores(supplier(spark, sf_dir))[0])


# --- missing values

FILL_SQL = {
    "mean": "coalesce({c}, avg({c}) OVER ())",
    "median": "coalesce({c}, (SELECT (list_sort(list({c}) FILTER (WHERE {c} IS NOT NULL)))[count({c}) // 2 + 1] FROM g))",
    "mode": "coalesce({c}, (SELECT {c} FROM g WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1))",
    "constant": "coalesce({c}, 0.0)",
    "forward_fill": "last_value({c} IGNORE NULLS) OVER (ORDER BY rid ROWS UNBOUNDED PRECEDING)",
}
FILLED = ("value", "usr", "half")
for _strategy in (Strategy.MEAN, Strategy.MEDIAN, Strategy.MODE, Strategy.CONSTANT, Strategy.FORWARD_FILL):
    _key = _strategy.name.lower()
    query(f"impute_{_key}", f"WITH g AS ({GAPS_SQL}) SELECT CAST(rid AS BIGINT) AS rid, " + ", ".join(f"round({FILL_SQL[_key].format(c=c)}, 6) + 0.0 AS {c}" for c in FILLED) + " FROM g")(lambda spark, sf_dir, s=_strategy: rounded(missing.fill(gaps(spark, sf_dir), s)))



@query("impute_forward_fill", ORACLE_SQL["impute_forward_fill"])
def impute_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In ranges of a thousand rows, so that cells are filled across them."""
    return rounded(missing.along_rows(gaps(spark, sf_dir), FILLED, False, rows_each=1000))


_BACK, _AHEAD = "OVER (ORDER BY rid ROWS UNBOUNDED PRECEDING)", "OVER (ORDER BY rid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
INTERPOLATED_SQL = (
    f"WITH g AS ({GAPS_SQL}), n AS (SELECT rid, value, last_value(value IGNORE NULLS) {_BACK} AS a, last_value(CASE WHEN value IS NOT NULL THEN rid END IGNORE NULLS) {_BACK} AS ra, "
    f"first_value(value IGNORE NULLS) {_AHEAD} AS b, first_value(CASE WHEN value IS NOT NULL THEN rid END IGNORE NULLS) {_AHEAD} AS rb FROM g) "
    "SELECT CAST(rid AS BIGINT) AS rid, round(CASE WHEN value IS NOT NULL THEN value WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE a + (b - a) * ((rid - ra) / CAST(rb - ra AS DOUBLE)) END, 6) + 0.0 AS value FROM n"
)


@query("impute_interpolate", INTERPOLATED_SQL)
def impute_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(missing.along_rows(gaps(spark, sf_dir).select(RID, "value"), ["value"], True, rows_each=1000))


# --- distances


@query("distance_matrix", f"WITH emb AS ({EMB_SQL}), k AS ({CENTRES_SQL}) SELECT CAST(e.rid AS BIGINT) AS rid, CAST(k.c AS INTEGER) AS c, round(list_distance(e.x, k.p), 6) + 0.0 AS dist FROM emb e, k")
def distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = emb(spark, sf_dir)
    return rounded(distances.distance_matrix(e, label_centres(e)))


@query("point_distances", f"WITH emb AS ({EMB_SQL}), k AS ({CENTRES_SQL}) SELECT CAST(k.c AS INTEGER) AS c, round(list_distance(e.x, k.p), 6) + 0.0 AS dist FROM emb e, k WHERE e.rid = 7")
def point_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = emb(spark, sf_dir)
    return rounded(distances.distance_matrix(e.where("rid = 7"), label_centres(e)).drop(RID))


@query("nearest_centroid", f"WITH emb AS ({EMB_SQL}), k AS ({CENTRES_SQL}), d AS (SELECT e.rid, k.c, list_distance(e.x, k.p) AS dist, row_number() OVER (PARTITION BY e.rid ORDER BY list_distance(e.x, k.p), k.c) AS r FROM emb e, k) SELECT CAST(rid AS BIGINT) AS rid, CAST(c AS INTEGER) AS cluster, round(dist, 6) + 0.0 AS dist FROM d WHERE r = 1")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = emb(spark, sf_dir)
    return rounded(distances.nearest_centroid(e, label_centres(e)))


def sampled_sql(most: int) -> str:
    """Common tables n and emb: at most so many evenly spaced embeddings."""
    return f"n AS (SELECT count(*) AS n FROM embeddings), emb AS (SELECT e.* FROM ({EMB_SQL}) e, n WHERE n <= {most} OR (rid % (n // {most}) = 0 AND rid // (n // {most}) < {most}))"


@query("all_pairs", f"WITH {sampled_sql(1000)} SELECT CAST(a.rid AS BIGINT) AS i, CAST(b.rid AS BIGINT) AS j, round(list_distance(a.x, b.x) * list_distance(a.x, b.x), 6) + 0.0 AS d2 FROM emb a, emb b WHERE a.rid < b.rid")
def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(distances.all_pairs(emb(spark, sf_dir), 1000))


@query("range_pairs", f"WITH p AS ({SUPPLIER_SQL}) SELECT CAST(a.rid AS BIGINT) AS i, CAST(b.rid AS BIGINT) AS j, round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 6) + 0.0 AS d2 FROM p a, p b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 0.16")
def range_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = distances.vectors(scaling.z_scores(supplier(spark, sf_dir))[0])
    return distances.range_pairs(z, 0.4, 2, shown=zeroless)


@query("knn", f"WITH emb AS ({EMB_SQL}), d AS (SELECT a.rid AS query, b.rid, list_distance(a.x, b.x) AS dist, row_number() OVER (PARTITION BY a.rid ORDER BY list_distance(a.x, b.x), b.rid) AS rank FROM emb a, emb b) SELECT CAST(query AS BIGINT) AS query, CAST(rank AS INTEGER) AS rank, CAST(rid AS BIGINT) AS rid, round(dist, 6) + 0.0 AS dist FROM d WHERE rank <= 5")
def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = emb(spark, sf_dir)
    return rounded(distances.nearest(e, e, 5))


@query("nearest_training_point", f"WITH emb AS ({EMB_SQL}), q AS (SELECT rid, list_transform(x, lambda v: -v) AS x FROM emb), d AS (SELECT a.rid AS query, b.rid, row_number() OVER (PARTITION BY a.rid ORDER BY list_distance(a.x, b.x), b.rid) AS r FROM q a, emb b) SELECT CAST(query AS BIGINT) AS query, CAST(rid AS BIGINT) AS rid FROM d WHERE r = 1")
def nearest_training_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = emb(spark, sf_dir)
    return distances.nearest(e, e.select(RID, F.transform("x", lambda v: -v).alias("x")), 1).select("query", RID)


# --- k-means


def lloyd_sql(k: int, rounds: int, last: str) -> str:
    """Lloyd's iterations from the first k rows, a pair of common tables each."""
    steps = [f"p AS ({UNIT_SQL})", f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY rid) - 1 AS INTEGER) AS c, x, y FROM p ORDER BY rid LIMIT {k})"]
    for t in range(1, rounds + 2):
        d = f"(p.x - c{t - 1}.x) * (p.x - c{t - 1}.x) + (p.y - c{t - 1}.y) * (p.y - c{t - 1}.y)"
        steps.append(f"a{t} AS (SELECT * FROM (SELECT p.rid, p.x, p.y, c{t - 1}.c, {d} AS d2, row_number() OVER (PARTITION BY p.rid ORDER BY {d}, c{t - 1}.c) AS r FROM p, c{t - 1}) WHERE r = 1)")
        steps.append(f"c{t} AS (SELECT k.c, coalesce(avg(a.x), 0) AS x, coalesce(avg(a.y), 0) AS y, count(a.x) AS n FROM c0 k LEFT JOIN a{t} a ON a.c = k.c GROUP BY k.c)")
    return f"WITH {', '.join(steps)} {last}"


def _first_k(rounds: int) -> kmeans.KMeansConfig:
    return kmeans.KMeansConfig(k=4, max_iter=rounds, tol=0.0, init="first_k")


@query("kmeans_step", lloyd_sql(4, 1, "SELECT c AS cluster, n, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM c1"))
def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = kmeans.fit(unit_points(spark, sf_dir), _first_k(1))
    return rounded(spark.createDataFrame([(i, int(n), float(c[0]), float(c[1])) for i, (c, n) in enumerate(zip(model.centroids, model.counts))], "cluster int, n long, x double, y double"))


@query("kmeans_fit5", lloyd_sql(4, 5, "SELECT c AS cluster, n, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y FROM c5"))
def kmeans_fit5(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = kmeans.fit(unit_points(spark, sf_dir), _first_k(5))
    return rounded(spark.createDataFrame([(i, int(n), float(c[0]), float(c[1])) for i, (c, n) in enumerate(zip(model.centroids, model.counts))], "cluster int, n long, x double, y double"), 4)


@query("kmeans_inertia", lloyd_sql(4, 5, " UNION ALL ".join(f"SELECT {t - 1} AS step, round(sum(d2), 4) + 0.0 AS inertia FROM a{t}" for t in range(1, 6))))
def kmeans_inertia(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = kmeans.fit(unit_points(spark, sf_dir), _first_k(5))
    return rounded(spark.createDataFrame(list(enumerate(model.history)), "step int, inertia double"), 4)


@query("kmeans_predict", lloyd_sql(4, 3, "SELECT CAST(rid AS BIGINT) AS rid, c AS cluster FROM a4"))
def kmeans_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = unit_points(spark, sf_dir)
    return kmeans.labels(p, kmeans.fit(p, _first_k(3)))


@query("kmeans_sizes", lloyd_sql(4, 3, "SELECT c AS cluster, count(*) AS n FROM a4 GROUP BY c"))
def kmeans_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = unit_points(spark, sf_dir)
    return kmeans.sizes(kmeans.labels(p, kmeans.fit(p, _first_k(3))))


@query("kmeans_plus_plus")
def kmeans_plus_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = kmeans.fit(emb(spark, sf_dir), kmeans.KMeansConfig(k=10, seed=1))
    return spark.createDataFrame([(i, int(n), model.inertia) for i, n in enumerate(model.counts)], "cluster int, n long, inertia double")


@query("kmeans_maximin", f"WITH RECURSIVE p AS ({UNIT_SQL}), s(step, chosen) AS (SELECT 1, [(SELECT min(rid) FROM p)] UNION ALL SELECT step + 1, list_append(chosen, (SELECT q.rid FROM (SELECT p.rid, min((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)) AS d FROM p, p c WHERE list_contains(s.chosen, c.rid) GROUP BY p.rid) q ORDER BY q.d DESC, q.rid LIMIT 1)) FROM s WHERE step < 4) SELECT CAST(unnest(chosen) AS BIGINT) AS rid FROM s WHERE step = 4")
def kmeans_maximin(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = unit_points(spark, sf_dir)
    start = kmeans.initial(p, kmeans.KMeansConfig(k=4, init="maximin"), p.count())
    rows = spark.createDataFrame([(c.tolist(),) for c in start], "c array<double>")
    return p.join(F.broadcast(rows), p.x == rows.c).groupBy("c").agg(F.min(RID).alias(RID)).select(RID)


def converged_sql(k: int, rounds: int, tol: float) -> str:
    """Lloyd's iterations up to the first from the third on whose inertia moved by less than tol of itself."""
    base = lloyd_sql(k, rounds, "").removesuffix(" ").replace(" AS (SELECT", " AS MATERIALIZED (SELECT")
    inertia = " UNION ALL ".join(f"SELECT {t - 1} AS i, sum(d2) AS inertia FROM a{t}" for t in range(1, rounds + 1))
    centres = " UNION ALL ".join(f"SELECT {t - 1} AS i, c, x, y, n FROM c{t}" for t in range(1, rounds + 1))
    return f"""{base}, f AS (SELECT i, inertia, lag(inertia) OVER (ORDER BY i) AS before FROM ({inertia})),
    e AS (SELECT coalesce(min(i) FILTER (WHERE i >= 2 AND (abs(before - inertia) < {tol} * inertia OR before = inertia)), {rounds}) AS n_iter FROM f),
    z AS (SELECT n_iter, least(n_iter, {rounds - 1}) AS at FROM e)
    SELECT CAST(n_iter AS INTEGER) AS n_iter, round(inertia, 4) + 0.0 AS inertia, c AS cluster, n, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y FROM z JOIN f ON f.i = z.at JOIN ({centres}) k ON k.i = z.at"""


@query("kmeans_converged", converged_sql(4, 15, 0.01))
def kmeans_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = kmeans.fit(unit_points(spark, sf_dir), kmeans.KMeansConfig(k=4, max_iter=15, tol=0.01, init="first_k"))
    rows = [(model.n_iter, model.inertia, i, int(n), float(c[0]), float(c[1])) for i, (c, n) in enumerate(zip(model.centroids, model.counts))]
    return rounded(spark.createDataFrame(rows, "n_iter int, inertia double, cluster int, n long, x double, y double"), 4)


START = [[0.2, 1.0], [0.5, 1.1], [0.8, 1.2]]


def sequence_sql(source: str, centroid: str, count: str, nearest_to: str = "m") -> str:
    """Points (i, x, y) of a source one after the other, each moving the centroid nearest to it, as a recursive common table.

    centroid and count are the new values of p and n of that cluster; nearest_to is the centroids that it is told by.
    """
    d = f"list_transform({nearest_to}, lambda p: (p[1] - u.x) * (p[1] - u.x) + (p[2] - u.y) * (p[2] - u.y))"
    moved = centroid.format(p="m[w][{0}]", n="n[w]")
    return f"""WITH RECURSIVE u AS ({source}), s(i, m, n) AS (SELECT CAST(0 AS BIGINT), {START}::DOUBLE[][], [1.0, 1.0, 1.0]::DOUBLE[] UNION ALL
        SELECT i, list_transform(range(1, 4), lambda k: CASE WHEN k = w THEN [{moved.format(1, v='x')}, {moved.format(2, v='y')}] ELSE m[k] END), list_transform(range(1, 4), lambda k: CASE WHEN k = w THEN {count.format(n='n[w]')} ELSE n[k] END)
        FROM (SELECT u.i, u.x, u.y, s.m, s.n, list_position({d}, list_min({d})) AS w FROM s JOIN u ON u.i = s.i + 1))
    SELECT CAST(k - 1 AS INTEGER) AS cluster, round(n[k], 6) + 0.0 AS mass, round(m[k][1], 6) + 0.0 AS x, round(m[k][2], 6) + 0.0 AS y FROM (SELECT * FROM s ORDER BY i DESC LIMIT 1), (SELECT unnest(range(1, 4)) AS k)"""


def _centroids(spark: SparkSession, centroids: np.ndarray, counts: np.ndarray) -> DataFrame:
    return rounded(spark.createDataFrame([(i, float(n), *map(float, c)) for i, (c, n) in enumerate(zip(centroids, counts))], "cluster int, mass double, x double, y double"))


IN_ORDER_SQL = f"SELECT row_number() OVER (ORDER BY rid) AS i, x, y FROM ({UNIT_SQL})"


@query("kmeans_partial_fit", sequence_sql(IN_ORDER_SQL, "{p} + 0.5 * ({{v}} - {p})", "{n} + 1"))
def kmeans_partial_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three clusters, three iterations in, so the rate is a half; all points in order."""
    model = kmeans.partial_fit(kmeans.KMeansModel(np.array(START), np.ones(3, np.int64), n_iter=3), unit_points(spark, sf_dir))
    return _centroids(spark, model.centroids, model.counts)


MINI_SQL = f"WITH RECURSIVE u AS (SELECT d AS i, x, y FROM (SELECT unnest(range(1, 301)) AS d) JOIN ({UNIT_SQL}) ON rid = (d * 7919) % (SELECT count(*) FROM part)), s(i, m, w) AS (SELECT CAST(0 AS BIGINT), {START}::DOUBLE[][], 0 UNION ALL SELECT u.i, list_transform(range(1, 4), lambda k: CASE WHEN k = list_position(list_transform({START}::DOUBLE[][], lambda p: (p[1] - u.x) * (p[1] - u.x) + (p[2] - u.y) * (p[2] - u.y)), list_min(list_transform({START}::DOUBLE[][], lambda p: (p[1] - u.x) * (p[1] - u.x) + (p[2] - u.y) * (p[2] - u.y)))) THEN [m[k][1] + (u.x - m[k][1]) / (9 + u.i), m[k][2] + (u.y - m[k][2]) / (9 + u.i)] ELSE m[k] END), 0 FROM s JOIN u ON u.i = s.i + 1) SELECT CAST(k - 1 AS INTEGER) AS cluster, round(m[k][1], 6) + 0.0 AS x, round(m[k][2], 6) + 0.0 AS y FROM (SELECT * FROM s ORDER BY i DESC LIMIT 1), (SELECT unnest(range(1, 4)) AS k)"


@query("minibatch_update", MINI_SQL)
def minibatch_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three clusters, ten updates in, and a batch of 300 draws with replacement by a fixed list of rows."""
    points = unit_points(spark, sf_dir)
    n = points.count()
    drawn = spark.createDataFrame([(d, d * 7919 % n) for d in range(1, 301)], "draw long, rid long")
    rows = points.join(F.broadcast(drawn), RID).orderBy("draw").select("x").toArrow()
    model = kmeans.mini_batch_update(kmeans.KMeansModel(np.array(START), np.zeros(3, np.int64), updates=9), distances.rows_of(rows.column("x")))
    return rounded(spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(model.centroids)], "cluster int, x double, y double"))


@query("minibatch_fit")
def minibatch_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = kmeans.mini_batch_fit(unit_points(spark, sf_dir), config=kmeans.KMeansConfig(k=4, seed=3))
    return spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(model.centroids)], "cluster int, x double, y double")


@query("algorithm_choice", "SELECT CASE WHEN count(*) > 50000 THEN 'online' ELSE 'kmeans' END AS algorithm FROM lineitem")
def algorithm_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(kmeans.algorithm_for(read(spark, sf_dir, "lineitem").count()),)], "algorithm string")


# --- DBSCAN


def dbscan_sql(epsilon: float, last: str) -> str:
    e2 = epsilon * epsilon
    return f"""WITH RECURSIVE p AS ({SUPPLIER_SQL}),
    near AS (SELECT a.rid AS i, b.rid AS j FROM p a, p b WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < {e2}),
    core AS (SELECT i FROM near GROUP BY i HAVING count(*) >= 5),
    edge AS (SELECT n.i, n.j FROM near n JOIN core a ON a.i = n.i JOIN core b ON b.i = n.j),
    reach(i, j) AS (SELECT i, i FROM core UNION SELECT r.i, e.j FROM reach r JOIN edge e ON e.i = r.j),
    root AS (SELECT i, min(j) AS root FROM reach GROUP BY i),
    grouped AS (SELECT i, dense_rank() OVER (ORDER BY root) AS cluster FROM root),
    border AS (SELECT n.i, min(g.cluster) AS cluster FROM near n JOIN grouped g ON g.i = n.j WHERE n.i NOT IN (SELECT i FROM core) GROUP BY n.i),
    label AS (SELECT p.rid, CAST(coalesce(g.cluster, b.cluster, 0) AS INTEGER) AS cluster, p.x, p.y FROM p LEFT JOIN grouped g ON g.i = p.rid LEFT JOIN border b ON b.i = p.rid) {last}"""


@query("dbscan_labels", dbscan_sql(0.4, "SELECT CAST(rid AS BIGINT) AS rid, cluster FROM label"))
def dbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbscan.fit(supplier(spark, sf_dir), 0.4, 5, standardize=True).labels


@query("dbscan_summary", dbscan_sql(0.3, "SELECT max(cluster) AS clusters, count(*) FILTER (WHERE cluster = 0) AS noise FROM label"))
def dbscan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = dbscan.fit(supplier(spark, sf_dir), 0.3, 5, standardize=True)
    return spark.createDataFrame([(model.n_clusters(), model.n_noise())], "clusters int, noise long")


PART_Z_SQL = "SELECT p_partkey AS rid, (p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part) AS x, (p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part) AS y FROM part"


@query("dbscan_part", dbscan_sql(0.1, "SELECT CAST(rid AS BIGINT) AS rid, cluster FROM label").replace(SUPPLIER_SQL, PART_Z_SQL))
def dbscan_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbscan.fit(part(spark, sf_dir), 0.1, 5, standardize=True).labels


#: Coarse places, so that most cells are crowded.
CROWD_SQL = "SELECT c_custkey AS rid, floor(c_acctbal / 250) / 4 AS x, (c_custkey % 37) / 10.0 AS y FROM customer"


@query("dbscan_crowded", dbscan_sql(0.35, "SELECT cluster, count(*) AS n, min(CAST(rid AS BIGINT)) AS first, max(CAST(rid AS BIGINT)) AS last FROM label GROUP BY cluster").replace(SUPPLIER_SQL, CROWD_SQL).replace("reach(i, j) AS (SELECT i, i FROM core UNION SELECT r.i, e.j FROM reach r JOIN edge e ON e.i = r.j)", "spot AS (SELECT x, y, min(rid) AS s FROM p GROUP BY x, y), of AS (SELECT p.rid, s FROM p JOIN spot USING (x, y)), link AS (SELECT DISTINCT a.s AS i, b.s AS j FROM edge e JOIN of a ON a.rid = e.i JOIN of b ON b.rid = e.j), hop(i, j) AS (SELECT DISTINCT s, s FROM of JOIN core ON core.i = of.rid UNION SELECT h.i, l.j FROM hop h JOIN link l ON l.i = h.j), reach AS (SELECT core.i, h.j FROM core JOIN of ON of.rid = core.i JOIN hop h ON h.i = of.s)"))
def dbscan_crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many points at few places, so that cells are crowded and connected as cells."""
    c = read(spark, sf_dir, "customer")
    table = tables.points(c, "c_custkey", {"x": F.floor(F.col("c_acctbal") / 250) / 4, "y": F.expr("c_custkey % 37") / 10.0})
    labels = dbscan.fit(table, 0.35, 5).labels
    return labels.groupBy("cluster").agg(F.count("*").alias("n"), F.min(RID).alias("first"), F.max(RID).alias("last"))


@query("dbscan_core_points", dbscan_sql(0.4, "SELECT CAST(i AS BIGINT) AS rid, count(*) AS neighbours, count(*) >= 5 AS core FROM near GROUP BY i"))
def dbscan_core_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dbscan.core_points(scaling.z_scores(supplier(spark, sf_dir))[0], 0.4, 5)


@query("dbscan_predict", dbscan_sql(0.4, ", q AS (SELECT rid, x + 0.01 AS x, y FROM p), d AS (SELECT q.rid, l.cluster, sqrt((q.x - l.x) * (q.x - l.x) + (q.y - l.y) * (q.y - l.y)) AS dist, row_number() OVER (PARTITION BY q.rid ORDER BY sqrt((q.x - l.x) * (q.x - l.x) + (q.y - l.y) * (q.y - l.y)), l.rid) AS r FROM q, label l) SELECT CAST(rid AS BIGINT) AS rid, CASE WHEN dist <= 0.4 THEN cluster ELSE 0 END AS cluster FROM d WHERE r = 1"))
def dbscan_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = scaling.z_scores(supplier(spark, sf_dir))[0]
    return dbscan.fit(z, 0.4, 5).predict(z.withColumn("x", F.col("x") + 0.01))


@query("estimate_epsilon", f"WITH p AS ({UNIT_SQL}), s AS (SELECT * FROM p WHERE rid % greatest((SELECT count(*) FROM part) // 500, 1) = 0 AND rid // greatest((SELECT count(*) FROM part) // 500, 1) < 500), d AS (SELECT s.rid, sqrt((s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y)) AS dist, row_number() OVER (PARTITION BY s.rid ORDER BY sqrt((s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y)), p.rid) AS r FROM s, p) SELECT round(avg(dist), 6) + 0.0 AS epsilon FROM d WHERE r = 5")
def estimate_epsilon(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unit(spark, sf_dir)
    return rounded(dbscan.estimate_epsilon(u, u.count()))


def _sweep_sql(epsilon: float) -> str:
    return "SELECT * FROM (" + dbscan_sql(epsilon, f"SELECT CAST({epsilon} AS DOUBLE) AS epsilon, max(cluster) AS k, count(*) FILTER (WHERE cluster = 0) AS noise, round(CASE WHEN max(cluster) >= 2 THEN max(cluster) * (1 - count(*) FILTER (WHERE cluster = 0) / CAST(count(*) AS DOUBLE)) ELSE 0 END, 6) + 0.0 AS score FROM label") + ")"


@query("epsilon_sweep", " UNION ALL ".join(_sweep_sql(e) for e in (0.3, 0.4)))
def epsilon_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dbscan.epsilon_sweep(supplier(spark, sf_dir), [0.3, 0.4], 5, standardize=True))


# --- metrics

SPREAD_SQL = f"WITH emb AS ({EMB_SQL}), k AS ({CENTRES_SQL}), s AS (SELECT c, p, avg(list_distance(x, p)) AS spread, sum(list_distance(x, p) * list_distance(x, p)) AS within, count(*) AS n FROM emb JOIN k ON k.c = emb.cluster GROUP BY c, p)"


@query("silhouette", f"WITH emb AS ({EMB_SQL}), m AS (SELECT a.rid, a.cluster AS ci, b.cluster AS cj, avg(list_distance(a.x, b.x)) AS d FROM emb a, emb b WHERE a.rid <> b.rid GROUP BY 1, 2, 3), s AS (SELECT rid, coalesce(max(d) FILTER (WHERE ci = cj), 0) AS a, min(d) FILTER (WHERE ci <> cj) AS b FROM m GROUP BY rid) SELECT round(avg((b - a) / greatest(a, b)), 6) + 0.0 AS silhouette FROM s")
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.silhouettes(emb(spark, sf_dir)).agg(F.avg("s").alias("silhouette")))


@query("davies_bouldin", f"{SPREAD_SQL}, r AS (SELECT a.c, max((a.spread + b.spread) / list_distance(a.p, b.p)) AS worst FROM s a, s b WHERE a.c <> b.c GROUP BY a.c) SELECT round(avg(worst), 6) + 0.0 AS davies_bouldin FROM r")
def davies_bouldin(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = emb(spark, sf_dir)
    return rounded(spark.createDataFrame([(metrics.davies_bouldin(e, label_centres(e)),)], "davies_bouldin double"))


CH_SQL = "g AS (SELECT list(m ORDER BY pos) AS mean FROM (SELECT pos, avg(x[pos]) AS m FROM emb, (SELECT unnest(range(1, 65)) AS pos) GROUP BY pos)), f AS (SELECT (sum(n * list_distance(p, mean) * list_distance(p, mean)) / (count(*) - 1)) / (sum(within) / (sum(n) - count(*))) AS calinski_harabasz FROM s, g)"


@query("calinski_harabasz", f"{SPREAD_SQL}, {CH_SQL} SELECT round(calinski_harabasz, 6) + 0.0 AS calinski_harabasz FROM f")
def calinski_harabasz(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = emb(spark, sf_dir)
    return rounded(spark.createDataFrame([(metrics.calinski_harabasz(e, label_centres(e)),)], "calinski_harabasz double"))


@query("stability", "SELECT round(-sum(s * log2(s)) / log2(count(*)), 6) + 0.0 AS stability FROM (SELECT count(*) / CAST((SELECT count(*) FROM embeddings) AS DOUBLE) AS s FROM embeddings GROUP BY label)")
def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = emb(spark, sf_dir)
    return rounded(spark.createDataFrame([(metrics.stability(e, len(label_centres(e))),)], "stability double"))


def scores_sql(labels: str, centres: str) -> str:
    """Common tables that end in r (silhouette, davies_bouldin, calinski_harabasz, stability) of labels (rid, cluster, x, y)
    around centres (c, x, y); every centre counts, empty ones too."""
    d = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
    return f"""l AS ({labels}), k AS ({centres}), kk AS (SELECT count(*) AS k FROM k), nn AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my FROM l),
    m AS (SELECT a.rid, a.cluster AS ci, b.cluster AS cj, avg({d}) AS d FROM l a, l b WHERE a.rid <> b.rid GROUP BY 1, 2, 3),
    sides AS (SELECT l.rid, coalesce(max(d) FILTER (WHERE ci = cj), 0) AS a, coalesce(min(d) FILTER (WHERE ci <> cj), 3.4028234663852886e38) AS b FROM l LEFT JOIN m ON m.rid = l.rid GROUP BY l.rid),
    sil AS (SELECT avg(CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0 END) AS silhouette FROM sides),
    sp AS (SELECT b.c, b.x, b.y, count(a.rid) AS n, coalesce(avg({d}), 0) AS s, coalesce(sum({d} * {d}), 0) AS within FROM k b LEFT JOIN l a ON a.cluster = b.c GROUP BY 1, 2, 3),
    db AS (SELECT avg(worst) AS davies_bouldin FROM (SELECT a.c, max(CASE WHEN {d} > 0 THEN (a.s + b.s) / {d} ELSE 0 END) AS worst FROM sp a, sp b WHERE a.c <> b.c GROUP BY a.c)),
    ch AS (SELECT (sum(sp.n * ((sp.x - mx) * (sp.x - mx) + (sp.y - my) * (sp.y - my))) / nullif(any_value(k) - 1, 0)) / nullif(sum(within) / nullif(any_value(nn.n) - any_value(k), 0), 0) AS calinski_harabasz FROM sp, nn, kk),
    st AS (SELECT -sum(CASE WHEN sp.n > 0 THEN sp.n / nn.n * log2(sp.n / nn.n) ELSE 0 END) / nullif(log2(any_value(k)), 0) AS stability FROM sp, nn, kk),
    r AS (SELECT CASE WHEN k <= 1 THEN 0 ELSE silhouette END AS silhouette, CASE WHEN k <= 1 THEN 0 ELSE davies_bouldin END AS davies_bouldin, CASE WHEN k <= 1 OR n <= k OR within = 0 THEN 0 ELSE calinski_harabasz END AS calinski_harabasz, CASE WHEN k <= 1 THEN 1 ELSE stability END AS stability FROM sil, db, ch, st, kk, nn, (SELECT sum(within) AS within FROM sp))"""


@query("evaluate_current", dbscan_sql(0.4, f", {scores_sql('SELECT rid, cluster, x, y FROM label', 'SELECT cluster AS c, avg(x) AS x, avg(y) AS y FROM label GROUP BY cluster')} SELECT CAST(k AS INTEGER) AS k, round(silhouette, 6) + 0.0 AS silhouette, round(davies_bouldin, 6) + 0.0 AS davies_bouldin, round(calinski_harabasz, 6) + 0.0 AS calinski_harabasz, round(stability, 6) + 0.0 AS stability FROM r, kk"))
def evaluate_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.evaluate(dbscan.fit(supplier(spark, sf_dir), 0.4, 5, standardize=True).points)
    return rounded(spark.createDataFrame([tuple(found.values())], "k int, silhouette double, davies_bouldin double, calinski_harabasz double, stability double"))


@query("cluster_means", f"WITH emb AS ({EMB_SQL}), k AS ({CENTRES_SQL}) SELECT CAST(c AS INTEGER) AS cluster, CAST(pos - 1 AS INTEGER) AS pos, round(p[pos], 6) + 0.0 AS v FROM k, (SELECT unnest(range(1, 65)) AS pos)")
def cluster_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.centres(emb(spark, sf_dir))
    return rounded(spark.createDataFrame([(c, i, float(v)) for c, m in found.items() for i, v in enumerate(m)], "cluster int, pos int, v double"))


@query("elbow_sweep", " UNION ALL ".join(f"SELECT * FROM ({lloyd_sql(k, 4, f'SELECT CAST({k} AS INTEGER) AS k, round(sum(d2), 4) + 0.0 AS inertia FROM a4')})" for k in (2, 3, 4)))
def elbow_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sweeps.elbow(unit_points(spark, sf_dir), 2, 4, 4, kmeans.KMeansConfig(init="first_k", tol=0.0)), 4)


#: At most a thousand evenly spaced rows of part, as evaluation takes them.
STRIDE_SQL = "(SELECT count(*) FROM part) <= 1000 OR (rid % ((SELECT count(*) FROM part) // 1000) = 0 AND rid // ((SELECT count(*) FROM part) // 1000) < 1000)"


def _scored_sql(k: int, rounds: int, last: str) -> str:
    return lloyd_sql(k, rounds, f", {scores_sql(f'SELECT rid, c AS cluster, x, y FROM a{rounds + 1} WHERE {STRIDE_SQL}', f'SELECT c, x, y FROM c{rounds}')}, i AS (SELECT sum(d2) AS inertia FROM a{rounds}) {last}").replace(" AS (SELECT", " AS MATERIALIZED (SELECT")


@query("evaluate_sweep", " UNION ALL ".join(f"SELECT * FROM ({_scored_sql(k, 4, f'SELECT CAST({k} AS INTEGER) AS k, round(inertia, 4) + 0.0 AS inertia, round(silhouette, 4) + 0.0 AS silhouette, round(davies_bouldin, 4) + 0.0 AS davies_bouldin, round(calinski_harabasz, 4) + 0.0 AS calinski_harabasz FROM r, i')})" for k in (2, 3, 4, 5)))
def evaluate_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sweeps.evaluate(unit_points(spark, sf_dir), 2, 5, 4, kmeans.KMeansConfig(init="first_k", tol=0.0)), 4)


def _line_sql(label: str, value: str) -> str:
    return f"'{label}: ' || printf('%.4f', {value}) || chr(10)"


@query("report", _scored_sql(4, 5, f"SELECT 'Dataset: ' || (SELECT count(*) FROM part) || ' rows x 2 cols' || chr(10) || 'Selected columns: x y' || chr(10) || 'Algorithm: kmeans  k: 4' || chr(10) || {_line_sql('Inertia', 'inertia')} || 'Iterations: 5' || chr(10) || {_line_sql('Silhouette', 'silhouette')} || {_line_sql('Davies-Bouldin', 'davies_bouldin')} AS report FROM r, i"))
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text on a table and a run of k-means, scored on evenly spaced rows."""
    table = unit(spark, sf_dir)
    points = distances.vectors(table)
    model, n = kmeans.fit(points, _first_k(5)), table.count()
    some = tables.stride(distances.assigned(points, model.centroids).select(RID, "x", "cluster"), n)
    run = {"algorithm": "kmeans", "k": model.k, "inertia": model.inertia, "iterations": model.n_iter, "silhouette": metrics.silhouette(some, model.k), "davies_bouldin": metrics.davies_bouldin(some, model.centroids)}
    return spark.createDataFrame([(exports.report(n, 2, tables.features(table), run),)], "report string")


RESULTS_SQL = "SELECT CAST(n_nationkey + 2 AS INTEGER) AS k, 1000.0 / (n_nationkey + 1) + (n_nationkey * 7) % 5 AS inertia, ((n_nationkey * 13) % 11) / 11.0 AS silhouette, ((n_nationkey * 5) % 7) + 1.0 AS davies_bouldin FROM nation"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").selectExpr("n_nationkey + 2 AS k", "cast(1000.0D / (n_nationkey + 1) + (n_nationkey * 7) % 5 AS double) AS inertia", "((n_nationkey * 13) % 11) / 11.0D AS silhouette", "((n_nationkey * 5) % 7) + 1.0D AS davies_bouldin")


@query("best_k_silhouette", f"SELECT k FROM ({RESULTS_SQL}) ORDER BY silhouette DESC, k LIMIT 1")
def best_k_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweeps.best_k_silhouette(_results(spark, sf_dir))


@query("best_k_davies_bouldin", f"SELECT k FROM ({RESULTS_SQL}) ORDER BY davies_bouldin, k LIMIT 1")
def best_k_davies_bouldin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweeps.best_k_davies_bouldin(_results(spark, sf_dir))


@query("best_k_elbow", f"SELECT k FROM (SELECT k, lag(inertia) OVER (ORDER BY k) + lead(inertia) OVER (ORDER BY k) - 2 * inertia AS bend FROM ({RESULTS_SQL})) WHERE bend IS NOT NULL ORDER BY bend DESC, k LIMIT 1")
def best_k_elbow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweeps.best_k_elbow(_results(spark, sf_dir))


@query("newest_runs", f"SELECT k AS run, round(inertia, 6) + 0.0 AS inertia FROM ({RESULTS_SQL}) ORDER BY k DESC LIMIT 20")
def newest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sweeps.newest(_results(spark, sf_dir).select(F.col("k").alias("run"), "inertia")))


# --- streams

LOG_SQL = "SELECT CAST(user_id AS BIGINT) AS seq, avg(value) / 200 AS silhouette FROM events GROUP BY user_id"


@query("drift_flags", f"WITH l AS ({LOG_SQL}), w AS (SELECT seq, silhouette, list(silhouette) OVER (ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS w FROM l) SELECT seq, round(silhouette, 6) + 0.0 AS silhouette, CASE WHEN len(w) < 3 THEN false ELSE list_avg(w[1 : len(w) // 2]) - list_avg(w[len(w) // 2 + 1 : len(w)]) > 0.05 END AS drifting FROM w")
def drift_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("seq")).agg((F.avg("value") / 200).alias("silhouette"))
    return rounded(drift.drift_flags(log, 0.05))


@query("online_decayed_mean", "WITH l AS (SELECT user_id, value, pow(0.95, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1) AS w FROM events) SELECT CAST(user_id AS BIGINT) AS user_id, round(sum(w), 6) + 0.0 AS n, round(sum(w * value) / sum(w), 6) + 0.0 AS mean FROM l GROUP BY user_id")
def online_decayed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(online.decayed_mean(read(spark, sf_dir, "events"), ["user_id"], "value", "event_id", 0.95))


BATCHED_SQL = f"WITH p AS ({UNIT_SQL}), k AS (SELECT unnest(range(1, 4)) AS k, unnest({START}::DOUBLE[][]) AS c), a AS (SELECT rid, x, y, arg_min(k, struct_pack(d := (c[1] - x) * (c[1] - x) + (c[2] - y) * (c[2] - y), k := k)) AS k FROM p, k GROUP BY rid, x, y), w AS (SELECT k, x, y, pow(0.99, row_number() OVER (PARTITION BY k ORDER BY rid DESC) - 1) AS w FROM a), s AS (SELECT k, count(*) AS m, sum(w) AS w, sum(w * x) AS x, sum(w * y) AS y FROM w GROUP BY k) SELECT CAST(k.k - 1 AS INTEGER) AS cluster, round(CASE WHEN m IS NULL THEN 5 ELSE pow(0.99, m) * 5 + w END, 6) + 0.0 AS mass, round(CASE WHEN m IS NULL THEN c[1] ELSE (pow(0.99, m) * 5 * c[1] + s.x) / (pow(0.99, m) * 5 + w) END, 6) + 0.0 AS x, round(CASE WHEN m IS NULL THEN c[2] ELSE (pow(0.99, m) * 5 * c[2] + s.y) / (pow(0.99, m) * 5 + w) END, 6) + 0.0 AS y FROM k LEFT JOIN s ON s.k = k.k"


@query("online_batched", BATCHED_SQL)
def online_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three clusters of five points each, then all points with forgetting, in closed form."""
    return _centroids(spark, *online.batched_update(np.array(START), np.full(3, 5.0), unit_points(spark, sf_dir), 0.99))


@query("online_sequence", sequence_sql(IN_ORDER_SQL, "{p} + ({{v}} - {p}) / (0.99 * {n} + 1)", "0.99 * {n} + 1"))
def online_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three clusters, all points one after the other with forgetting."""
    model = online.OnlineKMeans(online.OnlineConfig(k=3, forgetting_factor=0.99, auto_retrain=False))
    model.state.centroids, model.state.counts = np.array(START), np.ones(3)
    model.partial_fit(unit_points(spark, sf_dir))
    return _centroids(spark, model.centroids, model.counts)


@query("online_kmeans")
def online_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of files of points, point by point."""
    folder = scratch(spark)
    unit_points(spark, sf_dir).repartitionByRange(4, RID).sortWithinPartitions(RID).write.parquet(f"{folder}/points")
    stream = spark.readStream.schema("rid long, x array<double>").option("maxFilesPerTrigger", 1).parquet(f"{folder}/points")
    model = online.OnlineKMeans(online.OnlineConfig(k=4, window_size=200, retrain_interval=500))
    model.start(stream, f"{folder}/state").awaitTermination()
    return spark.createDataFrame([(i, float(n), *map(float, c)) for i, (c, n) in enumerate(zip(model.centroids, model.counts))], "cluster int, mass double, x double, y double")


# --- dimensions


@query("pca_covariances", "WITH l AS (SELECT l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount FROM lineitem) SELECT 'quantity' AS a, 'quantity' AS b, round(covar_samp(quantity, quantity), 4) + 0.0 AS cov FROM l UNION ALL SELECT 'quantity', 'price', round(covar_samp(quantity, price), 4) + 0.0 FROM l UNION ALL SELECT 'quantity', 'discount', round(covar_samp(quantity, discount), 4) + 0.0 FROM l UNION ALL SELECT 'price', 'price', round(covar_samp(price, price), 4) + 0.0 FROM l UNION ALL SELECT 'price', 'discount', round(covar_samp(price, discount), 4) + 0.0 FROM l UNION ALL SELECT 'discount', 'discount', round(covar_samp(discount, discount), 4) + 0.0 FROM l")
def pca_covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = tables.points(read(spark, sf_dir, "lineitem"), "l_orderkey", {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount"})
    return rounded(pca.covariances(line), 4)


EIGEN_SQL = f"WITH p AS ({UNIT_SQL}), m AS (SELECT var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c, avg(x) AS mx, avg(y) AS my FROM p), e AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS l1, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) AS l2 FROM m)"


@query("pca2_variance", f"{EIGEN_SQL} SELECT CAST(1 AS INTEGER) AS pc, round(l1, 6) + 0.0 AS variance, round(l1 / (l1 + l2), 6) + 0.0 AS ratio FROM e UNION ALL SELECT 2, round(l2, 6) + 0.0, round(l2 / (l1 + l2), 6) + 0.0 FROM e")
def pca2_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pca.fit(unit(spark, sf_dir), 2)
    rows = [(i + 1, float(v), float(r)) for i, (v, r) in enumerate(zip(model.explained_variance, model.explained_variance_ratio))]
    return rounded(spark.createDataFrame(rows, "pc int, variance double, ratio double"))


@query("pca2_scores", f"{EIGEN_SQL}, v AS (SELECT *, CASE WHEN abs(b) > abs(l1 - a) THEN sign(b) ELSE sign(l1 - a) END / sqrt(b * b + (l1 - a) * (l1 - a)) AS s FROM e) SELECT CAST(rid AS BIGINT) AS rid, round(((x - mx) * b + (y - my) * (l1 - a)) * s, 5) + 0.0 AS pc1 FROM p, v")
def pca2_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pca.fit_transform(unit(spark, sf_dir), 1)[1], 5)


@query("pca_roundtrip", f"SELECT CAST(rid AS BIGINT) AS rid, {rounded_sql('x y', 5)} FROM ({UNIT_SQL})")
def pca_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, scores = pca.fit_transform(unit(spark, sf_dir), 2)
    return rounded(model.inverse_transform(scores), 5)


@query("tsne_pairwise_sq", f"WITH {sampled_sql(1000)} SELECT CAST(a.rid AS BIGINT) AS i, CAST(b.rid AS BIGINT) AS j, round(list_distance(a.x, b.x) * list_distance(a.x, b.x), 6) + 0.0 AS d2 FROM emb a, emb b WHERE a.rid < b.rid")
def tsne_pairwise_sq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tsne.pairwise_squared(emb(spark, sf_dir), 1000))


FIXED_P_SQL = f"WITH {sampled_sql(200)}, m AS (SELECT count(*) AS m FROM emb), w AS (SELECT a.rid AS i, b.rid AS j, exp(-list_distance(a.x, b.x)) AS w FROM emb a, emb b WHERE a.rid <> b.rid), o AS (SELECT i, j, w / sum(w) OVER (PARTITION BY i) AS p FROM w), p AS (SELECT a.i, a.j, (a.p + b.p) / (2 * m) AS p FROM o a JOIN o b ON a.i = b.j AND a.j = b.i, m)"


def _fixed_chances(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A sample, and its symmetric chances from fixed weights."""
    e = emb(spark, sf_dir)
    e = tables.stride(e, e.count(), 200)
    pairs = distances.all_pairs(e).select("i", "j", F.exp(-F.sqrt("d2")).alias("w"))
    w = pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    p = w.join(w.groupBy("i").agg(F.sum("w").alias("s")), "i").select("i", "j", (F.col("w") / F.col("s")).alias("p"))
    return e, tsne.symmetrized(p, e.count())


@query("tsne_symmetrize", f"{FIXED_P_SQL} SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(p * 1e6, 6) + 0.0 AS p FROM p WHERE i < j")
def tsne_symmetrize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_fixed_chances(spark, sf_dir)[1].withColumn("p", F.col("p") * 1e6))


STEP_SQL = f"""{FIXED_P_SQL}, y AS (SELECT rid, x[1] AS u, x[2] AS v FROM emb), k AS (SELECT a.rid AS i, b.rid AS j, a.u - b.u AS du, a.v - b.v AS dv, 1 / (1 + (a.u - b.u) * (a.u - b.u) + (a.v - b.v) * (a.v - b.v)) AS k FROM y a, y b WHERE a.rid <> b.rid),
    q AS (SELECT i, j, du, dv, k / sum(k) OVER () AS q FROM k),
    g AS (SELECT q.i, sum(4 * (p.p - q.q) * q.du) AS gu, sum(4 * (p.p - q.q) * q.dv) AS gv FROM q JOIN p ON p.i = q.i AND p.j = q.j GROUP BY q.i),
    s AS (SELECT y.rid, u - 200 * CASE WHEN gu > 0 THEN 0.8 ELSE 1.2 END * gu AS u, v - 200 * CASE WHEN gv > 0 THEN 0.8 ELSE 1.2 END * gv AS v FROM y JOIN g ON g.i = y.rid),
    d AS (SELECT sum(p.p * ln(p.p / q.q)) AS kl FROM q JOIN p ON p.i = q.i AND p.j = q.j)
    SELECT CAST(rid AS BIGINT) AS rid, round(u - avg(u) OVER (), 6) + 0.0 AS y1, round(v - avg(v) OVER (), 6) + 0.0 AS y2, round(kl, 6) + 0.0 AS kl FROM s, d"""


@query("tsne_step", STEP_SQL)
def tsne_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first step of a descent, from places of two coordinates."""
    e, p = _fixed_chances(spark, sf_dir)
    ids, matrix = tsne.matrix_of(p)
    start = {r[RID]: r["x"][:2] for r in e.collect()}
    state = tsne.Descent.begin(np.array([start[i] for i in ids.tolist()]))
    kl = state.step(matrix, 0, tsne.TSNEConfig(most_step=None))
    return rounded(spark.createDataFrame([(i, *y, kl) for i, y in zip(ids.tolist(), state.y.tolist())], "rid long, y1 double, y2 double, kl double"))


@query("tsne_widths", f"WITH {sampled_sql(200)} SELECT CAST(rid AS BIGINT) AS rid, true AS found FROM emb")
def tsne_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each row's chances have the entropy of the perplexity asked for, to the search's tolerance."""
    e = emb(spark, sf_dir)
    p = tsne.chances(tables.stride(e, e.count(), 200), 12.0)
    entropy = p.groupBy(F.col("i").alias(RID)).agg(F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log("p")).otherwise(0.0)).alias("h"), F.sum("p").alias("total"))
    return entropy.select(RID, ((F.abs(F.col("h") - float(np.log(12.0))) < 0.01) & (F.abs(F.col("total") - 1) < 1e-9)).alias("found"))


@query("tsne_transform", f"WITH emb AS ({EMB_SQL}), t AS (SELECT * FROM emb WHERE rid % 2 = 0), d AS (SELECT a.rid, b.x[1] AS y1, b.x[2] AS y2, row_number() OVER (PARTITION BY a.rid ORDER BY list_distance(a.x, b.x), b.rid) AS r FROM emb a, t b) SELECT CAST(rid AS BIGINT) AS rid, round(y1, 6) + 0.0 AS y1, round(y2, 6) + 0.0 AS y2 FROM d WHERE r = 1")
def tsne_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all embeddings by a given layout of every second one."""
    e = emb(spark, sf_dir).select(RID, "x")
    trained = e.where("rid % 2 = 0")
    model = tsne.TSNEModel(trained, trained.select(RID, F.col("x")[0].alias("y1"), F.col("x")[1].alias("y2")), 0.0)
    return rounded(model.transform(e))


@query("tsne_embedding")
def tsne_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.head(emb(spark, sf_dir).select(RID, "x"), tsne.MOST_ROWS)
    return tsne.fit(e).embedding


@query("plot_frame", f"SELECT CAST(p.rid AS BIGINT) AS rid, round(p.x, 6) + 0.0 AS x, round(p.y, 6) + 0.0 AS y, CAST(0 AS DOUBLE) AS z, CASE WHEN l.cluster = 0 THEN -1 ELSE l.cluster END AS label FROM ({SUPPLIER_SQL}) p JOIN ({dbscan_sql(0.4, 'SELECT rid, cluster FROM label')}) l ON l.rid = p.rid")
def plot_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = scaling.z_scores(supplier(spark, sf_dir))[0]
    return rounded(plots.plot_frame(z, dbscan.fit(z, 0.4, 5).labels, noise=True))


@query("axis_ranges", f"WITH p AS ({UNIT_SQL}) SELECT 'x' AS axis, round(min(x), 6) + 0.0 AS low, round(max(x), 6) + 0.0 AS high FROM p UNION ALL SELECT 'y', round(min(y), 6) + 0.0, round(max(y), 6) + 0.0 FROM p UNION ALL SELECT 'z', 0.0, 0.0")
def axis_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(plots.axis_ranges(plots.plot_frame(unit(spark, sf_dir))))
