"""Packs of points that meet without a shuffle: copies, disk, and more packs than one."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trafficward.operators import density, hierarchy, neighbours, similarity


def points_of(spark, array):
    return spark.createDataFrame([(f"p{i:03d}", v.tolist()) for i, v in enumerate(array)], "id string, vec array<double>")


@pytest.mark.parametrize("cell_size", [2, 1024])
def test_copies_are_paired_like_others(spark, cell_size):
    rng = np.random.default_rng(4)
    array = np.concatenate([rng.normal(size=(40, 3)), np.tile([1.0, 1.0, 1.0], (30, 1)), np.tile([1.0, 1.0, 1.1], (3, 1))])
    away = np.sqrt(((array[:, None] - array[None]) ** 2).sum(axis=2))
    found = [(r.id_a, r.id_b, round(r.distance, 9), r.copies_a) for r in neighbours.pairs_within(points_of(spark, array), 0.7, cell_size).collect()]
    expected = [(f"p{i:03d}", f"p{j:03d}", round(away[i, j], 9), 1) for i in range(73) for j in range(i + 1, 73) if away[i, j] <= 0.7]
    assert sorted(found) == expected


@pytest.mark.parametrize("threshold", [0.3, 0.5])
def test_cosine_pairs_of_copies(spark, threshold):
    rng = np.random.default_rng(5)
    array = np.repeat(rng.normal(size=(20, 5)), 3, axis=0) * np.tile([1.0, 1.0, 2.0], 20)[:, None]  # same directions
    unit = array / np.linalg.norm(array, axis=1, keepdims=True)
    found = {(r.id_a, r.id_b): r.similarity for r in similarity.cosine_pairs(points_of(spark, array), threshold, 1).collect()}
    cosine = unit @ unit.T
    expected = {(f"p{i:03d}", f"p{j:03d}"): cosine[i, j] for i in range(60) for j in range(i + 1, 60) if cosine[i, j] >= threshold}
    assert found.keys() == expected.keys() and all(found[p] == pytest.approx(expected[p]) for p in found)


def test_neighbours_across_many_packs(spark):
    rng = np.random.default_rng(6)
    array = np.concatenate([rng.normal(size=(150, 3)), rng.normal(size=(50, 3)) * 0.1 + 5, np.tile([5.0, 5.0, 5.0], (9, 1))])
    df = points_of(spark, array)
    assert neighbours.build_grid(neighbours.collapse(df)[0], 2).packs > 8
    away = np.sqrt(((array[:, None] - array[None]) ** 2).sum(axis=2))
    found = {}
    for r in neighbours.nearest_neighbours(df, 4, 2).orderBy("id", "rank").collect():
        found.setdefault(int(r.id[1:]), []).append((int(r.neighbour[1:]), round(r.distance, 9)))
    for i in range(len(array)):
        order = sorted((away[i, j], j) for j in range(len(array)) if j != i)[:4]
        assert found[i] == [(j, pytest.approx(d, abs=1e-8)) for d, j in order]


def test_dense_groups_across_many_packs(spark):
    rng = np.random.default_rng(7)
    array = np.concatenate([rng.normal(c, 0.3, size=(60, 2)) for c in (0, 4, 9)] + [rng.uniform(-20, 20, size=(20, 2))])
    found = [{r.id: r.cluster for r in density.dbscan(points_of(spark, array), 0.4, 4, size).collect()} for size in (2, 1024)]
    assert found[0] == found[1] and len({c for c in found[0].values() if c >= 0}) >= 3


def test_packs_meet_without_a_shuffle(spark):
    """A vector used to be shuffled once for every block it was compared with."""
    points = spark.range(300).select(F.col("id").cast("string").alias("id"), F.array(F.rand(1), F.rand(2)).alias("vec"))
    plan = neighbours.pairs_within(points, 0.1, 2)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


@pytest.mark.parametrize("most", [64, 2])
def test_silhouettes_shuffle_no_vector_for_its_products(spark, monkeypatch, most):
    monkeypatch.setattr(hierarchy, "_FEW", most)  # as with many clusters, too
    rng = np.random.default_rng(8)
    x, c = rng.normal(size=(90, 3)), np.arange(90) % 5
    x[80:] = x[3]
    rows = [(f"p{i:03d}", v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, c))]
    found = hierarchy.silhouettes(spark.createDataFrame(rows, "id string, vec array<double>, cluster int"), 10)
    away = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for r in found.collect():
        i = int(r.id[1:])
        means = [away[i, c == k].sum() / ((c == k).sum() - (k == c[i])) for k in range(5)]
        other = min(m for k, m in enumerate(means) if k != c[i])
        assert r.silhouette == pytest.approx((other - means[c[i]]) / max(other, means[c[i]]), abs=1e-9)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "FlatMapCoGroups" not in plan


def test_ward_links_every_vector_whatever_their_number(spark):
    """Beyond 2,000 vectors cells stood for them: 1,999 merges, fewer than the vectors call for."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2100, 2)).round(3)
    x = np.unique(x, axis=0)
    rows = [(f"p{i:04d}", v.tolist()) for i, v in enumerate(x)]
    labelled, merges = hierarchy.ward(spark.createDataFrame(rows, "id string, vec array<double>"), 5)
    assert merges.count() == len(x) - 1 > 2000
    assert labelled.count() == len(x)


@pytest.mark.parametrize("grid", [False, True])
def test_rounds_and_the_last_task_merge_alike(spark, grid):
    rng = np.random.default_rng(10)
    x = np.unique(rng.integers(0, 9, (120, 2)).astype(float) if grid else rng.normal(size=(120, 3)), axis=0)
    rows = [(f"p{i:03d}", v.tolist(), 1 + i % 3) for i, v in enumerate(x)]
    nodes = spark.createDataFrame(rows, "node string, vec array<double>, size long")
    found = [sorted((r.a, r.b, round(r.height, 9), r.size) for r in hierarchy.ward_merges(nodes, size).collect()) for size in (4, 4096)]
    assert len(found[0]) == len(x) - 1
    if not grid:
        assert found[0] == found[1]
    pairs = {tuple(sorted(m[:2])) for m in found[0]}
    assert len(pairs) == len(found[0]) and all(a < b for a, b in pairs)
