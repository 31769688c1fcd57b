"""Rules, edge cases and invariants of the library, on small tables made here."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.errors import InvalidInput
from pointweave.operators import balls, components, dbscan, distances, kmeans, metrics, missing, pca, scaling, stats, sweeps, tables, tsne
from pointweave.operators.missing import Strategy
from pointweave.plans.history import History
from pointweave.sources import exports, store
from pointweave.sources.csv import CsvImporter, read_csv
from pointweave.streaming import online
from pointweave.streaming.drift import DriftDetector, falls


def frame(spark, rows, names="ab"):
    return spark.createDataFrame([(i, *map(lambda v: None if v is None else float(v), r)) for i, r in enumerate(rows)], ", ".join(["rid long", *[f"{n} double" for n in names]]))


def cloud(spark, rows):
    return distances.vectors(frame(spark, rows, "abcdefgh"[: len(rows[0])]))


def column(df, name="a"):
    return [r[name] for r in df.orderBy("rid").collect()]


def text(spark, path):
    return "".join("\n".join(r["value"] for r in spark.read.text(str(path)).collect()))


TWO_ATOMS = [(0, 0)] * 18 + [(10, 10)] * 18
DENSE = [(0.1 * (i % 3), 0.1 * (i // 3)) for i in range(10)] + [(10 + 0.1 * (i % 3), 10 + 0.1 * (i // 3)) for i in range(10)] + [(5, 0), (0, 5), (5, 10), (10, 5), (-5, -5)]


# --- tables, statistics, scaling, missing values


def test_letters():
    assert [tables.letters(i) for i in (0, 25, 26, 51, 52)] == ["A", "Z", "AA", "AZ", "BA"]


def test_column_stats_use_lower_ranks_and_sample_deviation(spark):
    row = stats.column_stats(frame(spark, [(1,), (2,), (3,), (10,), (None,)], "a")).first()
    assert (row["count"], row["missing"], row["median"], row["q1"], row["q3"]) == (5, 1, 2.0, 1.0, 3.0)
    assert row["std"] == pytest.approx(np.std([1, 2, 3, 10], ddof=1))
    one = stats.column_stats(frame(spark, [(4,)], "a")).first()
    assert (one["std"], one["median"]) == (0.0, 4.0)
    none = stats.column_stats(frame(spark, [(None,)], "a")).first()
    assert none["mean"] is None and none["median"] is None


@pytest.mark.parametrize("values", [[5.0] * 100, list(range(1000)), [1e-300, 1e300, -1e300, 0.0], [1.0, 1.0 + 2**-52, 1.0 + 2**-51] * 5])
def test_order_statistics_are_exact(spark, values):
    t = frame(spark, [(v,) for v in values], "a")
    ranks = [0, len(values) // 3, len(values) // 2, len(values) - 1]
    assert stats.order_statistics(t, [("a", r) for r in ranks]) == [sorted(map(float, values))[r] for r in ranks]


def test_scaling_families_differ_on_constant_columns(spark):
    t = frame(spark, [(2, 1), (2, 3)])
    assert column(scaling.scale_matrix(t, "standardize")) == [0.0, 0.0]
    assert column(scaling.scale_matrix(t, "minmax")) == [0.0, 0.0]
    assert column(scaling.scale_columns(t, "standardize")) == [2.0, 2.0]
    assert column(scaling.z_scores(t)[0]) == [0.0, 0.0]
    assert column(scaling.scale_matrix(t, "standardize"), "b") == [-1.0, 1.0]
    assert column(scaling.scale_columns(t, "standardize"), "b") == pytest.approx([-(0.5**0.5), 0.5**0.5])
    assert column(scaling.scale_columns(frame(spark, [(-5,), (None,), (math.e,)], "a"), "log"))[1:] == [None, 1.0]


def test_normalized_columns_have_norm_one(spark):
    t = scaling.scale_matrix(frame(spark, [(i, 2 * i) for i in range(10)]), "normalize")
    assert t.agg(F.sum(F.col("a") * F.col("a")), F.sum(F.col("b") * F.col("b"))).first() == pytest.approx((1.0, 1.0))


@pytest.mark.parametrize(("strategy", "expected"), [(Strategy.MEAN, 3.0), (Strategy.MEDIAN, 2.0), (Strategy.MODE, 2.0), (Strategy.CONSTANT, 0.0), (Strategy.FORWARD_FILL, 2.0), (Strategy.INTERPOLATE, 4.5)])
def test_filling(spark, strategy, expected):
    t = frame(spark, [(1,), (2,), (2,), (None,), (7,)], "a")
    assert column(missing.fill(t, strategy))[3] == pytest.approx(expected)


def test_edges_of_filling_and_columns_without_values(spark):
    t = frame(spark, [(None, None), (1, None), (None, None), (3, None), (None, None)])
    assert column(missing.fill(t, Strategy.FORWARD_FILL)) == [None, 1, 1, 3, 3]
    assert column(missing.fill(t, Strategy.INTERPOLATE)) == [1, 1, 2, 3, 3]
    for s in (Strategy.MEAN, Strategy.MEDIAN, Strategy.MODE, Strategy.FORWARD_FILL, Strategy.INTERPOLATE):
        assert column(missing.fill(t, s), "b") == [None] * 5
    assert missing.fill(t, Strategy.DROP_COLUMNS).columns == ["rid"]
    assert column(missing.along_rows(t, ["a"], True, rows_each=1)) == [1, 1, 2, 3, 3]


def test_history(spark):
    h = History(frame(spark, [(1, 2), (None, 4)]))
    h.apply("fill", lambda t: missing.fill(t, Strategy.CONSTANT))
    h.apply("drop", tables.drop_missing_rows)
    assert h.names() == ["fill", "drop"] and h.current.count() == 2
    assert column(h.undo_all()) == [1, None] and h.can_redo() and not h.can_undo()
    h.redo()
    h.apply("drop column", lambda t: tables.drop_column(t, "b"))
    assert not h.can_redo() and h.names() == ["fill", "drop column"]
    with pytest.raises(InvalidInput):
        h.redo()


# --- files


def test_csv_rules(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('x,late,word,day,quoted\n1e5,1,abc,2021-03-24,"1,5"\n\n1.5%,2,def,2021-03-24,7\n$5,oops,ghi,2021-03-24\n1e60,4,jkl,2021-03-24,9,9\n+,5,mno,2021-03-24 10:00,N/A\n')
    t = read_csv(spark, str(path))
    assert t.columns == ["rid", "x", "late", "day", "quoted"]
    assert column(t, "x") == [1e5, 1.5, None, None, None]
    assert column(t, "late") == [1.0, 2.0, None, None, None]
    assert column(t, "day") == [2021.0] * 4 + [None]
    assert column(t, "quoted") == [1.0, 7.0, None, 9.0, None]
    assert read_csv(spark, str(path), max_rows=2).count() == 2
    assert read_csv(spark, str(path), use_letters=True).columns[1] == "A"


def test_sparse_columns_go_at_nine_tenths(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("keep,go\n" + "\n".join(f"{'1' if i < 11 else 'NA'},{'1' if i < 10 else '-'}" for i in range(100)))
    assert read_csv(spark, str(path)).columns == ["rid", "keep"]


def test_importer_reports(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a\n1\n2\n")
    shares = []
    result = CsvImporter(spark).load(str(path), progress=shares.append)
    assert (result.success, result.total_rows, shares[-1]) == (True, 2, 1.0)
    assert not CsvImporter(spark).load(str(tmp_path / "none.csv")).success


def test_exports(spark, tmp_path):
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 0)], "rid long, cluster int")
    exports.export_labels(labels, str(tmp_path / "l"), single=True)
    exports.export_centroids(spark, [[0, 1], [10, 11]], str(tmp_path / "c"))
    exports.export_table(frame(spark, [(0, None), (10, 11)], "xy"), str(tmp_path / "t"), single=True)
    assert text(spark, tmp_path / "l") == "id,cluster\n0,0\n1,1\n2,0"
    assert text(spark, tmp_path / "c") == "f0,f1\n0.000000,1.000000\n10.000000,11.000000"
    assert text(spark, tmp_path / "t") == "x,y\n0.000000,\n10.000000,11.000000"
    said = exports.report(10, 3, ["a", "c"], {"algorithm": 0, "k": 3, "inertia": 78.5, "iterations": 4, "silhouette": 0.5, "davies_bouldin": 0.4})
    assert all(x in said for x in ("Dataset: 10 rows x 3 cols", "Selected columns: a c", "Algorithm: 0  k: 3", "Inertia: 78.5000"))


def test_versions_and_store(spark, tmp_path):
    manager, labels = store.VersionManager(spark, str(tmp_path / "v")), spark.createDataFrame([(i, i % 3) for i in range(10)], "rid long, cluster int")
    assert not manager.has_versions()
    assert [manager.save(np.full((3, 2), n), labels) for n in range(3)] == [1, 2, 3]
    assert store.VersionManager(spark, str(tmp_path / "v")).list_versions() == [1, 2, 3]
    centroids, found = manager.rollback_to_version(2)
    assert centroids.tolist() == [[1, 1]] * 3 and found.count() == 10
    with pytest.raises(InvalidInput):
        manager.load(999)
    t, kept = frame(spark, [(1, 2), (3, 4)]), store.FeatureStore(spark, str(tmp_path / "f"))
    key = store.content_key(t, "minmax")
    assert not kept.cache_hit(key)
    assert column(kept.preprocess(t, "minmax")) == column(kept.preprocess(t, "minmax")) == [0.0, 1.0]
    assert kept.cache_hit(key) and store.content_key(frame(spark, [(3, 4), (1, 2)]), "minmax") != key
    assert store.shape_key(5, 2, "standardize") == "5_2_standardize"


# --- grouping


def test_kmeans_on_atoms(spark):
    points = cloud(spark, TWO_ATOMS)
    model = kmeans.fit(points, kmeans.KMeansConfig(k=2, seed=3))
    assert sorted(map(tuple, model.centroids.tolist())) == [(0.0, 0.0), (10.0, 10.0)]
    assert model.inertia == 0 and len({r["cluster"] for r in kmeans.labels(points, model).collect()}) == 2
    near = {r["rid"]: r["cluster"] for r in model.predict(cloud(spark, [(0.1, 0.1), (9.9, 9.9)])).collect()}
    assert near[0] != near[1]


def test_kmeans_rules(spark):
    points = cloud(spark, [(i, i) for i in range(50)])
    assert {r["cluster"] for r in kmeans.labels(points, kmeans.fit(points, kmeans.KMeansConfig(k=1))).collect()} == {0}
    same = kmeans.fit(cloud(spark, [(1, 2, 3)] * 10), kmeans.KMeansConfig(k=3))
    assert sorted(same.counts.tolist()) == [0, 0, 10] and (same.centroids[same.counts == 0] == 0).all()
    history = kmeans.fit(points, kmeans.KMeansConfig(k=4, init="first_k")).history
    assert all(a >= b - 1e-9 for a, b in zip(history, history[1:]))
    assert kmeans.fit(points, kmeans.KMeansConfig(k=3, callback=lambda i, _: i == 1)).n_iter == 1
    for k in (0, 51):
        with pytest.raises(InvalidInput):
            kmeans.fit(points, kmeans.KMeansConfig(k=k))
    with pytest.raises(InvalidInput):
        kmeans.labels(points, None)
    with pytest.raises(Exception, match="features"):
        kmeans.fixed([[1.0]]).predict(points).collect()
    with pytest.raises(InvalidInput):
        kmeans.fit(points.where("false"))


def test_mini_batch_follows_the_points(spark):
    model = kmeans.mini_batch_partial_fit(None, cloud(spark, [(1, 1)] * 30), 10, kmeans.KMeansConfig(k=1))
    for seed in range(6):
        model = kmeans.mini_batch_partial_fit(model, cloud(spark, [(9, 9)] * 30), 10, kmeans.KMeansConfig(k=1), seed)
    assert model.centroids[0, 0] > 7 and model.updates == 70


def naive_dbscan(x, epsilon, min_pts):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    near, label, c = [np.flatnonzero(r < epsilon) for r in d], [0] * len(x), 0
    seen = set()
    for i in range(len(x)):
        if i in seen or len(near[i]) < min_pts:
            continue
        c += 1
        stack = [i]
        while stack:
            k = stack.pop()
            if k in seen and label[k]:
                continue
            seen.add(k)
            label[k] = label[k] or c
            if len(near[k]) >= min_pts:
                stack += [j for j in near[k] if not label[j]]
    return label


@pytest.mark.parametrize("seed", [0, 1])
def test_dbscan_equals_the_sequential_rule(spark, seed):
    x = np.random.default_rng(seed).normal(0, 1, (60, 2)).round(1)
    found = dbscan.fit(frame(spark, x.tolist()), 0.5, 4)
    assert column(found.labels, "cluster") == naive_dbscan(x, 0.5, 4)


def test_dbscan_groups_and_noise(spark):
    model = dbscan.fit(frame(spark, DENSE), 1.0, 3)
    assert (model.n_clusters(), model.n_noise()) == (2, 5)
    assert column(model.predict(frame(spark, [(0.05, 0.05), (50, 50)])), "cluster") == [1, 0]
    none = dbscan.fit(frame(spark, [(10 * i, 10 * i) for i in range(5)]), 1.0, 2)
    assert (none.n_clusters(), none.n_noise()) == (0, 5)
    four = dbscan.fit(frame(spark, [(0, 0, 0, 0)] * 20 + [(0, 0, 0, 9)] * 20, "abcd"), 0.5, 3)
    assert (four.n_clusters(), four.n_noise()) == (2, 0)
    for e, m in ((0, 5), (1, 1)):
        with pytest.raises(InvalidInput):
            dbscan.fit(frame(spark, DENSE), e, m)
    assert dbscan.estimate_epsilon(frame(spark, [(1, 1)]), 1).first()[0] == 0.5


def test_metrics(spark):
    labelled = spark.createDataFrame([(0, [0.0], 0), (1, [1.0], 0), (2, [10.0], 1), (3, [11.0], 1)], "rid long, x array<double>, cluster int")
    centroids = np.array([[0.5], [10.5]])
    a, b = 1.0, [10.5, 9.5, 9.5, 10.5]
    assert metrics.silhouette(labelled, 2) == pytest.approx(np.mean([(x - a) / x for x in b]))
    assert metrics.davies_bouldin(labelled, centroids) == pytest.approx(0.1)
    assert metrics.calinski_harabasz(labelled, centroids) == pytest.approx(100 / (1 / 2))
    assert metrics.stability(labelled, 2) == pytest.approx(1.0)
    assert metrics.silhouette(labelled, 1) == 0 and metrics.stability(labelled, 1) == 1
    alone = spark.createDataFrame([(0, [0.0], 0), (1, [1.0], 1)], labelled.schema)
    assert metrics.silhouette(alone, 2) == 1.0


def test_choosing_k(spark):
    rows = [(2, 100.0, 0.5, 0.9), (3, 40.0, 0.7, 0.5), (4, 35.0, 0.7, 0.5), (5, 33.0, 0.1, 0.6)]
    results = spark.createDataFrame(rows, "k int, inertia double, silhouette double, davies_bouldin double")
    assert [f(results).first()[0] for f in (sweeps.best_k_silhouette, sweeps.best_k_davies_bouldin, sweeps.best_k_elbow)] == [3, 3, 3]
    assert [f(results.where("false")).first()[0] for f in (sweeps.best_k_silhouette, sweeps.best_k_davies_bouldin, sweeps.best_k_elbow)] == [2, 2, 2]
    assert sweeps.best_k_elbow(results.where("k > 3")).first()[0] == 4
    assert sweeps.elbow(cloud(spark, [(1, 1)])).count() == 0


# --- reduction, streams


def test_pca(spark):
    x = np.random.default_rng(0).normal(0, 1, (100, 5)) @ np.diag([5, 3, 1, 0.5, 0.1])
    t = frame(spark, x.tolist(), "abcde")
    model, scores = pca.fit_transform(t, 3)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert model.explained_variance == pytest.approx(values[:3]) and 0 < model.total_explained <= 1
    back = np.array([[r[c] for c in "abcde"] for r in model.inverse_transform(scores).orderBy("rid").collect()])
    assert np.sqrt(((back - x) ** 2).mean()) < 0.3
    for n in (0, 6):
        with pytest.raises(InvalidInput):
            pca.fit(t, n)


def test_tsne(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (20, 3)) for c in (0, 5)])
    points = cloud(spark, x.tolist())
    model = tsne.fit(points, tsne.TSNEConfig(perplexity=8, iterations=150))
    y = np.array([[r["y1"], r["y2"]] for r in model.embedding.orderBy("rid").collect()])
    assert np.isfinite(y).all() and y.std() > 0 and np.isfinite(model.kl_divergence)
    again = tsne.fit(points, tsne.TSNEConfig(perplexity=8, iterations=150)).embedding.orderBy("rid").collect()
    assert [r["y1"] for r in again] == y[:, 0].tolist()
    assert model.transform(points.where("rid = 3")).first()["y1"] == y[3, 0]
    with pytest.raises(InvalidInput):
        tsne.fit(points, tsne.TSNEConfig(perplexity=100))
    p = tsne.row_chances(np.arange(1.0, 30.0), 5)
    assert np.exp(-(p * np.log(p)).sum()) == pytest.approx(5, rel=0.05)


def test_online_modes_agree_for_one_cluster(spark):
    first, rest = cloud(spark, [(0.5 * i, 1) for i in range(10)]), cloud(spark, [(2 + 0.1 * i, 3) for i in range(10)])
    found = []
    for mode in ("exact", "batched"):
        model = online.OnlineKMeans(online.OnlineConfig(k=1, window_size=5, forgetting_factor=0.5, auto_retrain=False, mode=mode))
        model.partial_fit(first)
        assert model.points_seen == 10 and not len(model.window)
        model.partial_fit(rest)
        assert model.points_seen == 20 and len(model.window) == 5
        found.append((*model.centroids[0], model.counts[0], *model.window.ravel()))
    assert found[0] == pytest.approx(found[1])
    with pytest.raises(InvalidInput):
        online.OnlineKMeans(online.OnlineConfig(forgetting_factor=1.5))


def test_drift(spark):
    assert falls([0.9, 0.9, 0.2, 0.2], 0.1) and not falls([0.9, 0.2], 0.1) and not falls([0.5] * 5, 0.1)
    tight = spark.createDataFrame([(i, [float(i % 2 * 10), i * 0.001], i % 2) for i in range(20)], "rid long, x array<double>, cluster int")
    loose = spark.createDataFrame([(i, [float(i % 7), float(i % 5)], i % 2) for i in range(20)], tight.schema)
    detector, centroids = DriftDetector(0.05, 4), np.array([[0.0, 0.0], [10.0, 0.0]])
    for labelled in (tight, tight, loose, loose):
        detector.check(labelled, centroids)
    assert detector.is_drifting()


# --- neighbours, components, sequences


def brute_nearest(points, queries, k):
    out = []
    for name, q in queries:
        d = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(x, q))), i) for i, x in points)
        out += [(name, r + 1, i, round(v, 9)) for r, (v, i) in enumerate(d[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [16_384, 60, 7])
def test_index_finds_what_all_distances_do(spark, shard_rows):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.2, (60, 3)) for c in (0, 3, 9)] + [np.zeros((50, 3)), rng.normal(100, 0.1, (2, 3))]).round(2)
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    asked = [*rows[::7], (1000, [50.0, 50.0, 50.0]), (1001, [0.0, 0.0, 0.0])]
    points, queries = (spark.createDataFrame(r, "rid long, x array<double>").repartition(3) for r in (rows, asked))
    built = balls.index(points, shard_rows, most_centres=6)
    for k in (1, 5, 400):
        found = sorted((r["query"], r["rank"], r["rid"], round(r["dist"], 9)) for r in built.nearest(queries, k, block_rows=20).collect())
        assert found == brute_nearest(rows, asked, k)
    assert built.nearest(queries.where("false"), 2).count() == 0
    assert balls.index(points.where("false")).nearest(points.where("false"), 2).count() == 0


@pytest.mark.parametrize("one_task", [500_000, 30])
def test_components_are_those_of_a_plain_search(spark, one_task):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5060)] + [(7, 7)]
    least: dict[int, int] = {}
    near: dict[int, set[int]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for start in sorted(near):
        stack = [start] if start not in least else []
        while stack:
            k = stack.pop()
            if k not in least:
                least[k] = start
                stack += near[k]
    found = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "u long, v long").repartition(4), one_task).collect()}
    assert found == {k: r for k, r in least.items() if k != r}


@pytest.mark.parametrize("width", [1, 2, 3])
def test_dbscan_of_crowded_cells_equals_the_sequential_rule(spark, width):
    rng = np.random.default_rng(width)
    x = np.concatenate([rng.normal(0, 0.25, (50, width)), rng.normal(2, 0.3, (50, width)), rng.uniform(-3, 5, (25, width)), np.zeros((9, width))]).round(2)
    found = dbscan.fit(frame(spark, x.tolist(), "abc"[:width]), 0.45, 4)
    assert column(found.labels, "cluster") == naive_dbscan(x, 0.45, 4)


def test_crowded_cells_that_barely_touch_are_one_group(spark):
    """Far corners as witnesses, and one pair of points just closer than epsilon across the cells."""
    left = [(0.01 * i, 0.3 * (i % 2)) for i in range(20)] + [(0.65, 0.3)]
    right = [(2.3 + 0.01 * i, 0.3 * (i % 2)) for i in range(20)] + [(1.64, 0.3)]
    for gap, groups in ((0.0, 1), (0.02, 2)):
        rows = left + [(a + gap, b) for a, b in right] + [(0.65, 0.3)] * 5 + [(1.64 + gap, 0.3)] * 5
        assert dbscan.fit(frame(spark, rows), 1.0, 4).n_clusters() == groups


def test_sequences_follow_the_points_in_order(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (120, 2)) + rng.integers(0, 3, (120, 1)) * 4
    points, start = cloud(spark, x.tolist()).repartition(5), np.array([[0.0, 0.0], [4.0, 4.0], [8.0, 8.0]])
    expected, rate = start.copy(), 1 / math.sqrt(5)
    for p in x:
        c = ((expected - p) ** 2).sum(axis=1).argmin()
        expected[c] += rate * (p - expected[c])
    model = kmeans.partial_fit(kmeans.KMeansModel(start, np.zeros(3, np.int64), n_iter=4), points)
    assert model.centroids == pytest.approx(expected) and model.counts.sum() == 120
    one = online.OnlineKMeans(online.OnlineConfig(k=3, window_size=30, forgetting_factor=0.9, retrain_interval=25))
    two = online.OnlineKMeans(online.OnlineConfig(k=3, window_size=30, forgetting_factor=0.9, retrain_interval=25))
    for m in (one, two):
        m.state.centroids, m.state.counts = start.copy(), np.ones(3)
    one.partial_fit(points)
    for p in x:
        two.partial_fit_point(p)
    assert one.centroids == pytest.approx(two.centroids) and one.counts == pytest.approx(two.counts)
    assert one.points_seen == 120 and len(one.detector.history) == 4 and one.window == pytest.approx(x[-30:])
    assert one.window_inertia() == pytest.approx(np.sqrt(((x[-30:, None] - one.centroids[None]) ** 2).sum(axis=2)).min(axis=1).sum())
    one.set_retrain_interval(7)
    one.set_auto_retrain(False)
    one.set_window_size(10)
    assert one.config.retrain_interval == 7 and len(one.window) == 10
    with pytest.raises(InvalidInput):
        one.set_retrain_interval(0)


def test_a_window_that_dissolves_is_fitted_again():
    state = online.OnlineState(online.OnlineConfig(k=2, window_size=40, retrain_interval=20, drift_threshold=0.05), np.array([[0.0, 0.0], [10.0, 10.0]]), np.ones(2), detector=DriftDetector(0.05, 4))
    rng = np.random.default_rng(7)
    tight = np.concatenate([rng.normal(c, 0.1, (20, 2)) for c in (0, 10)])
    for part in (tight, tight, rng.uniform(0, 10, (80, 2))):
        state.see(part)
    assert state.retrained >= 1


def test_metrics_of_arrays_are_those_of_tables(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.6, (15, 2)) for c in (0, 3)] + [[[9.0, 9.0]]])
    labels = np.array([0] * 15 + [1] * 15 + [2])
    labelled = spark.createDataFrame([(i, p.tolist(), int(c)) for i, (p, c) in enumerate(zip(x, labels))], "rid long, x array<double>, cluster int")
    means = np.array([x[labels == c].mean(axis=0) for c in range(3)])
    found = metrics.of_arrays(x, labels, means)
    assert found == pytest.approx((metrics.silhouette(labelled, 3), metrics.davies_bouldin(labelled, means), metrics.calinski_harabasz(labelled, means), metrics.stability(labelled, 3)))
    assert np.array([m for _, m in sorted(metrics.centres(labelled).items())]) == pytest.approx(means)


def test_sizes_and_places_of_rows(spark):
    t = frame(spark, [(1, 2), (3, None), (5, 6)])
    assert [tuple(r) for r in tables.resize(t, 2, 1).orderBy("rid").collect()] == [(0, 1.0), (1, 3.0)]
    assert [tuple(r) for r in tables.resize(t, 4, 3).orderBy("rid").collect()] == [(0, 1.0, 2.0, 0.0), (1, 3.0, None, 0.0), (2, 5.0, 6.0, 0.0), (3, 0.0, 0.0, 0.0)]
    big = spark.range(500).withColumnRenamed("id", "rid").withColumn("a", (F.col("rid") * 7919 % 500).cast("double")).repartition(6)
    found = tables.numbered(tables.sort_rows(big, "a")).collect()
    assert sorted((r["position"], r["a"]) for r in found) == [(k, float(k)) for k in range(500)]
    assert tables.numbered(big.where("false")).count() == 0


def test_all_pairs_of_a_sample(spark):
    points = cloud(spark, [(i, 0) for i in range(40)])
    found = {(r["i"], r["j"]): r["d2"] for r in distances.all_pairs(points, block_rows=7).collect()}
    assert found == {(i, j): float((j - i) ** 2) for i in range(40) for j in range(i + 1, 40)}
    assert {r["i"] for r in distances.all_pairs(points, 10).collect()} | {36} == set(range(0, 40, 4))


def test_a_tsne_step_is_the_written_rule():
    rng = np.random.default_rng(9)
    p = rng.random((12, 12))
    p = (p + p.T) * (1 - np.eye(12))
    p /= p.sum()
    y = rng.normal(0, 1, (12, 2))
    state = tsne.Descent.begin(y.copy())
    kl = state.step(p, 0, tsne.TSNEConfig(most_step=None))
    k = np.array([[0 if i == j else 1 / (1 + ((y[i] - y[j]) ** 2).sum()) for j in range(12)] for i in range(12)])
    q = k / k.sum()
    g = np.array([sum(4 * (p[i, j] - q[i, j]) * (y[i] - y[j]) for j in range(12)) for i in range(12)])
    moved = y - 200 * np.where(g > 0, 0.8, 1.2) * g
    assert state.y == pytest.approx(moved - moved.mean(axis=0))
    assert kl == pytest.approx(sum(p[i, j] * math.log(p[i, j] / q[i, j]) for i in range(12) for j in range(12) if i != j))


def test_places_of_many_points_meet_once(spark):
    r = np.random.default_rng(5)
    at = r.uniform(-1, 1, (60, 2)).round(1)
    x = at[r.integers(0, 60, 400)]
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(x.tolist())], "rid long, x double, y double")
    points = distances.vectors(table)
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    near = d2 < 0.35 * 0.35
    found = distances.range_pairs(points, 0.35, 2).toPandas()
    assert sorted(zip(found.i, found.j)) == list(map(tuple, np.argwhere(near).tolist()))
    assert np.allclose(found.d2, d2[found.i, found.j])
    counted = sorted(dbscan.core_points(table, 0.35, 40).toPandas().itertuples(index=False, name=None))
    assert counted == [(i, int(n), bool(n >= 40)) for i, n in enumerate(near.sum(axis=1))]
    places = len(np.unique(x, axis=0))
    met = distances.near_places(distances.places_of(points).withColumnRenamed("rids", "i"), distances.places_of(points).withColumnRenamed("rids", "j"), 0.35, 2)
    assert met.count() <= places * places < near.sum()


def test_near_pairs_on_the_edges_of_cells(spark):
    x = np.arange(-6, 7) * 0.2
    for e in (0.4, 0.4 + 1e-12, 0.2):
        points = spark.createDataFrame([(i, [v]) for i, v in enumerate(x.tolist())], "rid long, x array<double>")
        near = (x[:, None] - x[None]) ** 2 < e * e
        assert sorted((r.i, r.j) for r in distances.range_pairs(points, e, 1).collect()) == list(map(tuple, np.argwhere(near).tolist()))


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_wide_points_are_looked_at_by_products(offset):
    r = np.random.default_rng(8)
    x = r.normal(size=(3000, 24)) + offset
    x[2500:] = x[:500]
    ids, asked = r.permutation(3000), np.concatenate((x[:60], -x[:60]))
    tree = balls.BallTree(x)
    tree._search = None  # the tree would look at nearly all in small pieces
    d = np.sqrt(balls.squared(asked, x))
    for limits in (np.full(120, np.inf), np.sort(d, axis=1)[:, 3]):
        best, best_ids = np.empty((120, 5)), np.empty((120, 5), np.int64)
        for own, far, names in tree.nearest(ids, asked, limits, 5):
            best[own], best_ids[own] = far, names
        for q in range(120):
            order = np.lexsort((ids, d[q]))[:5]
            order = order[d[q][order] <= limits[q]]
            assert best_ids[q, : len(order)].tolist() == ids[order].tolist()
            assert best[q, : len(order)].tolist() == d[q][order].tolist() and np.isinf(best[q, len(order) :]).all()


def test_distances_to_clusters_are_summed_by_products():
    r = np.random.default_rng(4)
    y = np.concatenate((r.normal(size=(300, 6)) + 1e3, np.full((40, 6), 1e3)))
    y[200:210] = y[:10] + 1e-7
    x, starts = y[::3], np.array([0, 5, 130, 131])
    d = np.sqrt(distances.distances_to(y, x)).T
    found = metrics.cluster_sums(x, y, starts, rows=7, columns=32)
    assert np.allclose(found, np.add.reduceat(d, starts, axis=1), rtol=1e-9, atol=1e-12)
    assert (metrics.cluster_sums(x[-1:], y[300:], np.array([0])) == 0).all()


def test_silhouettes_send_a_point_a_few_times(spark):
    r = np.random.default_rng(6)
    x, label = r.normal(size=(20_000, 3)), r.integers(0, 4, 20_000)
    labelled = spark.createDataFrame([(i, p, int(c)) for i, (p, c) in enumerate(zip(x.tolist(), label))], "rid long, x array<double>, cluster int")
    found = metrics.silhouettes(labelled)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "), 8)" in plan and "), 20)" not in plan  # blocks of 1024 would be 20
    some = {s["rid"]: s["s"] for s in found.where("rid < 40").collect()}
    d = np.sqrt(distances.distances_to(x, x[:40])).T
    for i in range(40):
        means = [d[i][label == c].sum() / ((label == c).sum() - (c == label[i])) for c in range(4)]
        a, b = means[label[i]], min(m for c, m in enumerate(means) if c != label[i])
        assert some[i] == pytest.approx((b - a) / max(a, b), abs=1e-9)
