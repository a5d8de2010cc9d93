"""Steps whose work must grow no faster than their rows, and use the cluster while it does."""

from __future__ import annotations

from pyspark.sql import functions as F

from trafficward.catalog import channel_queries as cq
from trafficward.catalog.base import Tables
from trafficward.operators import neighbours, quality as ql
from trafficward.operators.boosting import SecondOrderBoosting
from trafficward.session import compact


def test_fits_of_tens_of_thousands_of_rows_are_spread(spark):
    assert compact(spark.range(45_000)).rdd.getNumPartitions() >= 4
    assert compact(spark.range(9_000)).rdd.getNumPartitions() == 1
    assert SecondOrderBoosting().rows_per_partition <= 10_000


def test_models_read_the_log_once(spark, monkeypatch):
    """The scaling asks for quantiles again and again: the channel metrics must be stored before it."""
    seen = []

    def scaled(df, *rest):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, *rest)

    real = ql.robust_scale
    monkeypatch.setattr(ql, "robust_scale", scaled)
    t = Tables(spark, "/root/testdata/sf0.001")
    cq._prepared(t)
    cq._graph_input(t)
    assert len(seen) == 2 and not any("event_id" in plan or "parquet" in plan for plan in seen)


def test_points_go_to_fewer_cells_than_in_proportion(spark):
    """Where nothing can be pruned a point visits every cell, so their number is what the shuffle grows by."""
    points = spark.range(20_000).select(F.col("id").cast("string").alias("rep"), F.array(F.rand(1), F.rand(2)).alias("vec"), F.lit(1).alias("weight"))
    grid = neighbours.build_grid(points)
    assert len(grid.pivots) <= 20_000**0.5 * 64 / 1024 + 1
    assert grid.points.groupBy("cell", "block").count().agg(F.max("count")).first()[0] <= 3 * 20_000**0.5 * 16
