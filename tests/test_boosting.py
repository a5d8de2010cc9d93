"""Second-order trees: splits and leaf weights recomputed, missing values, saving."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from trafficward.operators.boosting import BoostedTrees, SecondOrderBoosting, _bins
from trafficward.session import new_folder


def rows(n: int = 400):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 3)).round(2)
    x[rng.random(n) < 0.15, 1] = np.nan
    y = np.where(np.isnan(x[:, 1]), 3.0, np.sign(x[:, 1])) + x[:, 0] ** 2 + 0.05 * rng.normal(size=n)
    return x, y


@pytest.fixture(scope="module")
def table(spark):
    x, y = rows()
    data = [(f"c{i}", Vectors.dense(v.tolist()), float(t)) for i, (v, t) in enumerate(zip(x, y))] + [("null", None, 1.0), ("no label", Vectors.dense([0, 0, 0]), None)]
    schema = spark.createDataFrame([("a", Vectors.dense([1.0]), 1.0)], ["channelId", "features", "original_label"]).schema
    return spark.createDataFrame(data, schema).repartition(3).persist()


def test_leaves_and_splits_are_the_regularised_optimum(table):
    x, y = rows()
    fit = SecondOrderBoosting(trees=4, depth=3, bins=16, keep=2, penalty=2.0, least_hessian=5.0, rows_per_partition=150)
    model = fit.fit(table)
    assert model.base == pytest.approx(y.mean()) and len(model.trees) == 4 and fit.jobs <= 12
    coded = _bins(x, model.edges)
    margin = np.full(len(y), model.base)
    for tree in model.trees:
        g = margin - y
        at = tree.place(coded, 3)
        for leaf in np.unique(at):
            mine = at == leaf
            assert tree.feature[leaf] == -1
            assert tree.value[leaf] == pytest.approx(-0.1 * g[mine].sum() / (mine.sum() + 2.0))
        # the root split gains as much as any
        gain = lambda s: sum(g[m].sum() ** 2 / (m.sum() + 2.0) for m in (s, ~s))
        options = []
        for f in range(3):
            for b in range(1, coded[:, f].max() + 1):
                for left in ((coded[:, f] <= b) & (coded[:, f] > 0), coded[:, f] <= b):
                    if min(left.sum(), (~left).sum()) >= 5:
                        options.append(gain(left))
        f, b = tree.feature[0], coded[:, tree.feature[0]]
        chosen = np.where(b == 0, tree.missing_left[0], b <= tree.cut[0])
        assert gain(chosen) == pytest.approx(max(options))
        margin += tree.value[at]
    assert np.allclose(model.margins(x), margin)


def test_it_learns_saves_and_loads(spark, table):
    model = SecondOrderBoosting(trees=25, rate=0.3, depth=3, subsample=0.8, keep=10).fit(table)
    got = model.transform(table.where("features IS NOT NULL AND original_label IS NOT NULL"))
    pairs = np.array([(r.original_label, r.gbt_b) for r in got.collect()])
    assert ((pairs[:, 0] - pairs[:, 1]) ** 2).mean() < 0.1 * pairs[:, 0].var()
    assert model.featureImportances.sum() == pytest.approx(1) and model.featureImportances[2] < 0.1
    path = new_folder(spark, "trees")
    model.save(spark, path)
    x, _ = rows()
    assert (BoostedTrees.load(spark, path).margins(x) == model.margins(x)).all()


def test_logistic_loss_and_no_rows(spark, table):
    from pyspark.sql import functions as F

    binary = table.withColumn("original_label", (F.col("original_label") > 1).cast("double"))
    model = SecondOrderBoosting(trees=15, rate=0.3, depth=3, loss="logistic").fit(binary)
    x, y = rows()
    assert ((model.margins(x) > 0) == (y > 1)).mean() > 0.9
    none = SecondOrderBoosting(trees=3).fit(table.limit(0))
    assert none.trees == [] and none.margins(x).tolist() == [0.0] * len(x)
