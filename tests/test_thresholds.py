"""Values that lie exactly on a threshold."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trafficward.operators.anomaly import daily_anomalies
from trafficward.operators.channels import quality_metrics

#: Weekday counts whose largest z-score is exactly 2.
TIES = [[20, 8, 8, 14, 10, 10, 14], [12, 10, 14, 10, 20, 12, 6], [13, 18, 10, 14, 16, 5, 15], [7, 14, 8, 9, 19, 8, 12]]


def test_a_daily_score_of_exactly_two_is_no_anomaly(spark):
    rows = [(f"t{i}", *x) for i, x in enumerate(TIES)] + [("above", 20, 8, 8, 14, 10, 10, 13), ("even", *[5] * 7), ("none", *[0] * 7)]
    counts = spark.createDataFrame(rows, "channelId string, " + ", ".join(f"dow_{d} long" for d in range(7)))
    found = {r.channelId: r for r in daily_anomalies(counts).collect()}
    for i in range(len(TIES)):
        assert not found[f"t{i}"].daily_anomaly and found[f"t{i}"].daily_max_z_score == pytest.approx(2.0, abs=1e-12)
    assert found["above"].daily_anomaly
    assert not found["even"].daily_anomaly and found["even"].daily_max_z_score == 0 and found["none"].daily_max_z_score == 0


def test_a_daily_score_holds_for_huge_counts(spark):
    big = [v * 10**9 for v in TIES[0]]
    counts = spark.createDataFrame([("c", *big)], "channelId string, " + ", ".join(f"dow_{d} long" for d in range(7)))
    assert not daily_anomalies(counts).first().daily_anomaly


@pytest.mark.parametrize("scores, mean", [([1.2, 1.8], 1.5), ([0.1, 0.7, 2.2], 1.0), ([1.2, 2.2, 5.6], 3.0)])
def test_a_mean_on_a_threshold_is_exact(spark, scores, mean):
    text = {"ip": "a", "country": "US", "browser": "b", "channelId": "c", "date": dt.datetime(2024, 1, 1)}
    whole = {c: 0 for c in ["total_fraud_flags", "ua_suspicious", "is_business_hours", "is_weekend", "keyword_commercial_intent", "referrer_is_ad_network"]}
    rows = [{**text, **whole, "isLikelyBot": False, "hour": h, "weighted_fraud_score": s} for h in range(10, 31) for s in scores]
    df = spark.createDataFrame(rows).coalesce(1)
    found = quality_metrics(df).first()
    assert found.fraud_score_avg == mean
    hours = [r["hour"] for r in rows]
    spread = sum((h - 20) ** 2 for h in hours) / (len(hours) - 1)
    assert found.time_pattern_diversity == pytest.approx(spread**0.5, rel=1e-12)
    assert quality_metrics(df.limit(1)).select(F.col("time_pattern_diversity")).first()[0] == 0
