"""Neighbour joins, density clusters and detectors against brute force on small points."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trafficward.operators import density, detectors, neighbours, propagation, similarity


def points_of(spark, array):
    rows = [(f"p{i:03d}", [float(x) for x in row]) for i, row in enumerate(array)]
    return spark.createDataFrame(rows, "id string, vec array<double>").repartition(3)


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(4)
    spread = np.concatenate([rng.normal(c, 0.4, size=(40, 3)) for c in (0, 3, 8)])
    # a third of all points are copies of one vector
    return np.concatenate([spread, np.tile([1.0, 1.0, 1.0], (60, 1))])


def brute_neighbours(array, k):
    names = [f"p{i:03d}" for i in range(len(array))]
    away = np.sqrt(((array[:, None] - array[None]) ** 2).sum(axis=2))
    out = {}
    for i, name in enumerate(names):
        order = sorted((round(away[i, j], 9), names[j]) for j in range(len(array)) if j != i)
        out[name] = order[:k]
    return out


@pytest.mark.parametrize("cell_size", [16, 1024])
def test_nearest_neighbours_are_exact(spark, cloud, cell_size):
    found = {}
    for r in neighbours.nearest_neighbours(points_of(spark, cloud), 4, cell_size).orderBy("id", "rank").collect():
        found.setdefault(r.id, []).append((round(r.distance, 9), r.neighbour))
    assert found == brute_neighbours(cloud, 4)


@pytest.mark.parametrize("cell_size", [16, 1024])
def test_pairs_within_are_exact(spark, cloud, cell_size):
    array = cloud[:121]
    found = {(r.id_a, r.id_b) for r in neighbours.pairs_within(points_of(spark, array), 0.7, cell_size).collect()}
    away = np.sqrt(((array[:, None] - array[None]) ** 2).sum(axis=2))
    expected = {(f"p{i:03d}", f"p{j:03d}") for i in range(121) for j in range(i + 1, 121) if away[i, j] <= 0.7}
    assert found == expected


def brute_dbscan(array, eps, minimum):
    away = np.sqrt(((array[:, None] - array[None]) ** 2).sum(axis=2)) <= eps
    core = away.sum(axis=1) >= minimum
    label = np.full(len(array), -1)
    current = 0
    for i in range(len(array)):
        if not core[i] or label[i] >= 0:
            continue
        stack = [i]
        label[i] = current
        while stack:
            for j in np.flatnonzero(away[stack.pop()] & core):
                if label[j] < 0:
                    label[j] = current
                    stack.append(j)
        current += 1
    border = {i: {label[j] for j in np.flatnonzero(away[i] & core)} for i in np.flatnonzero(~core)}
    return label, core, border


@pytest.mark.parametrize("cell_size", [16, 1024])
def test_dbscan_matches_brute_force(spark, cloud, cell_size):
    label, core, border = brute_dbscan(cloud, 0.5, 5)
    found = {int(r.id[1:]): r.cluster for r in density.dbscan(points_of(spark, cloud), 0.5, 5, cell_size).collect()}
    assert len(found) == len(cloud)
    naming = {}
    for i in np.flatnonzero(core):
        assert naming.setdefault(label[i], found[i]) == found[i]
    assert len(set(naming.values())) == len(naming)
    for i, choices in border.items():
        assert (found[i] == -1) if not choices else (found[i] in {naming[c] for c in choices})


def test_two_moons(spark):
    t = np.linspace(0, np.pi, 60)
    moons = np.concatenate([np.c_[np.cos(t), np.sin(t)], np.c_[1 - np.cos(t), 0.5 - np.sin(t)]])
    found = density.dbscan(points_of(spark, moons), 0.15, 3, 32).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in found) == [60, 60]


def test_outlier_factor_matches_brute_force(spark, cloud):
    array = cloud[:100]
    k = 10
    away = np.sqrt(((array[:, None] - array[None]) ** 2).sum(axis=2))
    np.fill_diagonal(away, np.inf)
    near = np.argsort(away, axis=1)[:, :k]
    kth = np.take_along_axis(away, near, 1)[:, -1]
    density_of = 1 / (np.maximum(kth[near], np.take_along_axis(away, near, 1)).mean(axis=1) + 1e-10)
    expected = density_of[near].mean(axis=1) / density_of
    found = {int(r.id[1:]): r.lof for r in detectors.local_outlier_factor(points_of(spark, array), k, 0.1, 32).collect()}
    assert [found[i] for i in range(100)] == pytest.approx(expected)


@pytest.fixture(scope="module")
def with_outliers():
    rng = np.random.default_rng(9)
    return np.concatenate([rng.normal(size=(190, 4)), rng.normal(size=(10, 4)) * 0.1 + 9])


def flagged(df, column):
    return {int(r.id[1:]) for r in df.where(F.col(column)).collect()}


def test_isolation_forest(spark, with_outliers, tmp_path):
    points = points_of(spark, with_outliers)
    found = detectors.isolation_forest(points, 0.1, 50)
    marked = flagged(found, "anomaly")
    assert set(range(190, 200)) <= marked and 15 <= len(marked) <= 20
    model = detectors.IsolationForest.fit(points, 10)
    model.save(spark, str(tmp_path / "forest"))
    again = detectors.IsolationForest.load(spark, str(tmp_path / "forest"))
    key = lambda m: sorted((r.id, r.score) for r in m.score(points).collect())
    assert key(model) == key(again)


def test_one_class_machine(spark, with_outliers):
    marked = flagged(detectors.one_class_svm(points_of(spark, with_outliers), 0.1), "svm_anomaly")
    assert 15 <= len(marked) <= 20


def test_elliptic_envelope(spark, with_outliers):
    found = detectors.elliptic_envelope(points_of(spark, with_outliers), 0.1)
    assert set(range(190, 200)) <= flagged(found, "envelope_anomaly")
    clean = with_outliers[:190]
    centre, inverse = clean.mean(axis=0), np.linalg.inv(np.cov(clean.T, bias=True))
    direct = np.sqrt(np.einsum("ij,jk,ik->i", clean - centre, inverse, clean - centre))
    robust = {int(r.id[1:]): r.mahalanobis for r in found.collect()}
    assert np.corrcoef(direct, [robust[i] for i in range(190)])[0, 1] > 0.95


@pytest.mark.parametrize("method", ["propagation", "spreading"])
def test_labels_spread_within_blobs(spark, method):
    rng = np.random.default_rng(2)
    array = np.concatenate([rng.normal(c, 0.3, size=(20, 2)) for c in (0, 10)])
    labels = {0: 1, 1: 1, 20: 3, 21: 3}
    df = points_of(spark, array)
    given = spark.createDataFrame([(f"p{i:03d}", v) for i, v in labels.items()], "id string, label int")
    found = {int(r.id[1:]): r.label for r in propagation.propagate(df.join(given, "id", "left"), method).collect()}
    assert all(found[i] == v for i, v in labels.items())
    assert all(found[i] in (1, None) for i in range(20)) and all(found[i] in (3, None) for i in range(20, 40))
    assert sum(v is None for v in found.values()) <= 4


def test_minhash_pairs_are_right_and_mostly_found(spark):
    rng = np.random.default_rng(3)
    sets = [frozenset(rng.choice(40, size=10, replace=False).tolist()) for _ in range(30)]
    sets += [frozenset(list(s)[:8] + [100 + i, 200 + i]) for i, s in enumerate(sets)]
    df = spark.createDataFrame([(f"s{i:02d}", [str(x) for x in sorted(s)]) for i, s in enumerate(sets)], "id string, tokens array<string>")
    found = {(r.id_a, r.id_b) for r in similarity.minhash_pairs(df, 0.5).collect()}
    exact = {
        (f"s{i:02d}", f"s{j:02d}") for i in range(60) for j in range(i + 1, 60)
        if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.5
    }
    assert found <= exact and len(found) >= 0.8 * len(exact)


def test_mean_similarity_equals_the_matrix(spark, cloud):
    array = cloud[:50]
    unit = array / np.linalg.norm(array, axis=1, keepdims=True)
    got = similarity.mean_similarity(points_of(spark, array)).first()
    assert got.mean_similarity == pytest.approx((unit @ unit.T).mean())


def test_degenerate_tables(spark):
    empty = spark.createDataFrame([], "channelId string, a double")
    assert similarity.robust_points(empty)[1] == []
    one = spark.createDataFrame([("x", 1.0)], "channelId string, a double")
    assert similarity.robust_points(one)[1] == []
    texts = spark.createDataFrame([("x", "y")], "channelId string, a string")
    assert similarity.robust_points(texts)[1] == []
    same = spark.createDataFrame([("x", 1.0), ("y", 1.0), ("z", 1.0)], "channelId string, a double")
    points, columns = similarity.robust_points(same)
    assert columns == ["a"] and points.count() == 3


@pytest.mark.parametrize("shift, size", [(0.0, 1.0), (1e6, 1.0), (0.0, 1e-9), (-3e4, 50.0)])
def test_products_settle_nothing_that_differences_tell_otherwise(shift, size):
    rng = np.random.default_rng(7)
    b = shift + size * rng.integers(-3, 4, (300, 8))
    a = np.concatenate([b[:40] + size * 1e-7 * rng.normal(size=(40, 8)), b[40:90], shift + size * rng.normal(size=(60, 8))])
    away = neighbours._distances(a, b)
    for radius in (0.0, size * 2.0, size * np.sqrt(3.0), float(np.median(away)), -1.0):
        assert (neighbours.within(a, b, radius) == (away <= radius)).all()
    names, others = [f"q{i:03d}" for i in range(len(a))], [f"s{i:03d}" for i in range(len(b))]
    found = neighbours._closest(5)(pd.DataFrame({"rep": names}), pd.DataFrame({"rep": others}), a, b)
    for i, rows in found.groupby("rep"):
        mine = away[names.index(i)]
        best = np.lexsort((np.arange(len(b)), mine))[:5]
        assert list(rows.other) == [others[j] for j in best] and (rows.distance.to_numpy() == mine[best]).all()


def test_distances_by_a_product_are_those_of_differences():
    rng = np.random.default_rng(8)
    b = 1000 + rng.normal(size=(200, 64))
    a = np.concatenate([b[:50], b[50:90] + 1e-9 * rng.normal(size=(40, 64)), rng.normal(size=(30, 64))])
    np.testing.assert_allclose(neighbours.distances_by_product(a, b), neighbours._distances(a, b), rtol=1e-9, atol=0)
