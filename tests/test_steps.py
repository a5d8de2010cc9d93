"""Parts of tables that many small steps read, and the size of generated methods."""

from __future__ import annotations

from trafficward.operators.clean import clean
from trafficward.plans.features import row_features
from trafficward.session import compact, parts_for
from trafficward.sources.events import load_traffic


def test_steps_of_a_fit_are_one_wave_of_tasks(spark):
    """540,000 channels made 54 tasks of each of some thousand steps."""
    assert spark.sparkContext.defaultParallelism == 4
    assert [parts_for(spark, n, 10_000) for n in (0, 9_000, 25_000, 90_000, 540_000)] == [1, 1, 3, 4, 6]
    assert compact(spark.range(540_000)).rdd.getNumPartitions() == 6


def test_row_features_are_not_one_method_that_the_jvm_interprets(spark):
    rows = row_features(clean(load_traffic(spark, "/root/testdata/sf0.001")))
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    assert rows.count() > 0
