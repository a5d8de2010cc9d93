"""Mergeable distinct counts: merged parts equal one pass, and the stated error holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from trafficward.operators import patterns


def test_merged_parts_equal_one_pass(spark):
    n = 40_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 4 == 0, "small").otherwise("large").alias("channelId"),
        F.when(F.col("id") % 4 == 0, F.concat(F.lit("a"), (F.col("id") % 40).cast("string"))).otherwise(F.col("id").cast("string")).alias("ip"),
        F.lit(None).cast("string").alias("country"),
    )
    sketch = lambda df: patterns.distinct_sketches(df, ["channelId"], ["ip", "country"])
    parts = [sketch(rows.where(F.crc32(F.col("ip").cast("binary")) % 5 == i)) for i in range(5)]
    merged = patterns.distinct_estimates(patterns.merge_sketches(parts, ["channelId"], ["ip", "country"]), ["ip", "country"])
    whole = patterns.distinct_estimates(sketch(rows), ["ip", "country"])
    got = {r.channelId: (r.ip, r.country) for r in merged.collect()}
    once = {r.channelId: (r.ip, r.country) for r in whole.collect()}
    assert got["small"] == once["small"] == (10, 0)
    for found in (got, once):
        assert abs(found["large"][0] / 30_000 - 1) < 0.05 and found["large"][1] == 0


def test_no_rows(spark):
    none = patterns.distinct_sketches(spark.createDataFrame([], "channelId string, ip string"), ["channelId"], ["ip"])
    assert patterns.distinct_estimates(patterns.merge_sketches([none], ["channelId"], ["ip"]), ["ip"]).collect() == []
