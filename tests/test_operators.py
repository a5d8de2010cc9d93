"""Windows, ranks, labels, classification and their edge cases."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from trafficward.operators import anomaly, classify, clean, evaluate, quality, ranks, report, sequence
from trafficward.schema import ANOMALY_FLAGS, TRAFFIC, ensure_columns


def log(spark, n=400, seed=3, hot=0.4):
    """Requests with a hot address, ties and missing keys."""
    rng = random.Random(seed)
    start = dt.datetime(2025, 8, 1)
    rows = []
    for i in range(n):
        ip = "hot" if rng.random() < hot else rng.choice(["a", "b", "c", None])
        rows.append((i, start + dt.timedelta(seconds=rng.randrange(0, 40000) // 7 * 7), ip, f"ch{rng.randrange(4)}"))
    return spark.createDataFrame(rows, "eventId bigint, date timestamp, ip string, channelId string")


def test_gaps_equal_the_plain_window(spark):
    df = log(spark)
    found = sequence.add_gaps(df, "ip", burst="burst")
    w = Window.partitionBy("ip").orderBy("date", "eventId")
    sec = F.unix_seconds("date")
    gap = df.withColumn("_g", sec - F.lag(sec).over(w))
    plain = gap.withColumns(
        {"g": F.coalesce("_g", F.lit(0)), "b": F.coalesce((F.sum("_g").over(w.rowsBetween(-4, 0)) < 300).cast("int"), F.lit(0))}
    )
    expected = {r.eventId: (r.g, r.b) if r.ip else (0, 0) for r in plain.collect()}
    rows = found.collect()
    assert len(rows) == 400
    assert {r.eventId: (r.ip_time_gap, r.burst) for r in rows} == expected


@pytest.mark.parametrize("minimum", [1, 5])
def test_rolling_equals_the_plain_window(spark, minimum):
    df = log(spark, hot=0.3).where("ip IS NOT NULL")
    w = Window.partitionBy("ip").orderBy("date", "eventId")
    near = w.rowsBetween(-2, 2)
    sec = F.unix_seconds("date").cast("double")
    plain = df.withColumn("g", sec - F.lag(sec).over(w)).withColumns(
        {"m": F.when(F.count("g").over(near) >= minimum, F.avg("g").over(near)), "n": F.count("g").over(near)}
    )
    expected = {r.eventId: r.m for r in plain.collect()}
    for r in sequence.rolling(df, "ip", minimum).collect():
        assert (r.rolling_mean is None) == (expected[r.eventId] is None)
        if r.rolling_mean is not None:
            assert r.rolling_mean == pytest.approx(expected[r.eventId])


def test_burst_modes(spark):
    start = dt.datetime(2025, 1, 1)
    at, rows = 0, []
    for i, gap in enumerate([0, 100, 110, 90, 100, 1, 100, 110, 90, 105, 95]):
        at += gap
        rows.append((i, start + dt.timedelta(seconds=at), "x"))
    df = spark.createDataFrame(rows, "eventId bigint, date timestamp, ip string")
    found = sequence.bursts(df, "ip", "baseline").collect()
    assert [(r.entity_id, r.burst_count, r.min_time_diff) for r in found] == [("x", 1, 1.0)]
    assert sequence.bursts(df, "ip", "faithful").count() == 0


@pytest.mark.parametrize("partitions", ["1", "5"])
def test_quantiles_are_exact_and_partition_independent(spark, partitions):
    rng = random.Random(1)
    values = [rng.choice([rng.gauss(0, 1), 0.5, 7.0]) for _ in range(999)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame([(v,) for v in values], "v double")
        probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.95, 1.0]
        found = {r.p: r.value for r in ranks.quantiles(df, ["v"], probs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for p in probs:
        assert found[p] == pytest.approx(np.quantile(values, p))


def test_average_ranks_and_bands(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 9)], "id int, v int")
    shares = {r.v: r.share for r in ranks.average_rank_share(df, "v", F.lit(1), "share").collect()}
    assert shares == {1: 1.5 / 4, 2: 3 / 4, 9: 1.0}
    bands = ranks.row_bands(spark.range(11), [F.col("id")], 3, "band").orderBy("id").collect()
    assert [r.band for r in bands] == [1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3]


def test_quantile_bins_merge_equal_edges(spark):
    df = spark.createDataFrame([(v,) for v in [1.0] * 8 + [2.0, 3.0]], "v double")
    # quartiles 1, 1, 1, 1, 3 leave a single bucket
    assert {(r.v, r.b) for r in ranks.quantile_bins(df, "v", 4, "b").collect()} == {(1.0, 0), (2.0, 0), (3.0, 0)}


def metrics_row(**changes):
    base = dict(
        channelId="c", bot_rate=0.0, fraud_flags_avg=0.0, fraud_score_avg=0.0, ip_diversity=20, country_diversity=3,
        browser_diversity=3, ua_suspicious_rate=0.0, volume=100, business_hours_rate=0.5, weekend_rate=0.1,
        time_pattern_diversity=5.0, commercial_intent_rate=0.0, ad_network_rate=0.0,
    )
    return {**base, **changes}


@pytest.mark.parametrize(
    "changes,band",
    [
        ({}, "high"),
        ({"volume": 30}, "good"),
        ({"volume": 10}, "medium"),
        ({"bot_rate": 0.25, "volume": 10}, "medium"),
        ({"bot_rate": 0.26}, "medium_low"),
        ({"bot_rate": 0.5}, "medium_low"),
        ({"bot_rate": 0.51}, "low"),
        ({"time_pattern_diversity": 0.5}, "medium_low"),
        ({"ip_diversity": 1, "volume": 101}, "low"),
        ({"ip_diversity": 1}, "medium_low"),
    ],
)
def test_rule_labels(spark, changes, band):
    row = metrics_row(**changes)
    df = spark.createDataFrame([row])
    got = quality.quality_labels(df).first()
    low, high = quality.LABEL_RANGES[band]
    assert got.label_band == band and low <= got.original_label <= high


def flags_of(spark, count, **raised):
    row = {"channelId": "c", **{f: raised.get(f, False) for f in ANOMALY_FLAGS}, "overall_anomaly_count": count}
    return spark.createDataFrame([row])


@pytest.mark.parametrize(
    "quality_score,count,bot,dc,anon,kind,label,confidence,reasons",
    [
        (7.0, 1, True, False, False, "clean", "good_account", 0.8, "clean_pattern"),
        (3.0, 3, False, False, False, "clean", "fraud", 0.9, "multiple_indicators"),
        (5.0, 0, True, True, False, "clean", "fraud", 0.8, "high_bot_activity"),
        (5.0, 0, False, True, True, "clean", "fraud", 0.7, "datacenter_ip"),
        (5.0, 0, False, False, True, "malicious", "fraud", 0.6, "anonymous_ip, suspicious_ip_pattern"),
        (3.1, 4, False, False, False, "malicious", "fraud", 0.5 + 0.4 * 0.576, "suspicious_ip_pattern"),
        (3.0, 0, False, False, False, "clean", "fraud", 0.6, "low_quality_score"),
        (6.0, 3, False, False, False, "clean", "fraud", 0.7, "multiple_indicators"),
        (6.0, 1, False, False, False, "clean", "good_account", 0.5, "clean_pattern"),
    ],
)
def test_rules_in_order(spark, quality_score, count, bot, dc, anon, kind, label, confidence, reasons):
    row = [("c", bot, dc, anon, kind)]
    df = ensure_columns(spark.createDataFrame(row, "channelId string, isLikelyBot boolean, isIpDatacenter boolean, isIpAnonymous boolean, ipClassification string"))
    scores = spark.createDataFrame([("c", quality_score)], "channelId string, quality_score double")
    got = classify.classify(df, scores, flags_of(spark, count)).first()
    assert (got.classification, got.reason_codes) == (label, reasons)
    assert got.confidence == pytest.approx(confidence)


def test_classification_keeps_columns_and_defaults(spark):
    df = ensure_columns(spark.createDataFrame([(None, None), ("zz", True)], "channelId string, isLikelyBot boolean"))
    empty_scores = spark.createDataFrame([], "channelId string, quality_score double")
    out = classify.classify(df, empty_scores, flags_of(spark, 2, temporal_anomaly=True))
    assert {f.name for f in TRAFFIC} <= set(out.columns)
    rows = {r.channelId: r for r in out.collect()}
    assert rows[None].quality_score == 5.0 and rows[None].classification == "good_account"
    assert rows["zz"].classification == "fraud" and rows["zz"].overall_anomaly_count == 0
    by_row = df.select("eventId", F.lit(True).alias("volume_anomaly"), F.lit(4).alias("overall_anomaly_count"))
    assert {r.overall_anomaly_count for r in classify.classify(df, empty_scores, by_row, level="row").collect()} == {4}


def test_canonical_flags_cover_every_channel(spark):
    keys = spark.createDataFrame([("a",), ("b",)], "channelId string")
    found = {
        "temporal": spark.createDataFrame([("a", True, False)], "channelId string, hourly_anomaly boolean, daily_anomaly boolean"),
        "volume": spark.createDataFrame([("a", True), ("z", None)], "channelId string, unique_ips_anomaly boolean"),
        "device": spark.createDataFrame([("b", True)], "channelId string, device_anomaly_ensemble boolean"),
    }
    rows = {r.channelId: r for r in anomaly.canonical_flags(found, keys).collect()}
    assert set(rows) == {"a", "b", "z"}
    assert (rows["a"].overall_anomaly_count, rows["a"].overall_anomaly_flag) == (2, True)
    assert rows["b"].device_anomaly and rows["z"].overall_anomaly_count == 0


def test_a_failing_family_leaves_the_others(spark, monkeypatch):
    from trafficward.operators.clean import clean as tidy
    from trafficward.plans.features import row_features
    from trafficward.sources.events import load_traffic

    for name in ["temporal_anomalies", "geographic_anomalies", "device_anomalies"]:
        monkeypatch.setattr(anomaly, name, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("broken")))
    monkeypatch.setattr(anomaly, "behavioural_anomalies", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("broken")))
    rows = row_features(tidy(load_traffic(spark, "/root/testdata/sf0.001")))
    found = anomaly.detect(rows)
    assert list(found) == ["volume"]
    flags = anomaly.canonical_flags(found, anomaly.channel_keys(rows))
    assert flags.count() == rows.select("channelId").distinct().count()
    assert flags.where("overall_anomaly_count NOT BETWEEN 0 AND 5").isEmpty()


def test_cleaning_edges(spark):
    df = ensure_columns(spark.createDataFrame([("1.2.3.4",), ("NaN",), ("Null",), ("none",), (None,), ("fe80::1",)], "ip string"))
    assert sorted(r.ip for r in clean.drop_bad_ips(df).collect()) == ["1.2.3.4", "fe80::1"]
    assert clean.duplicate_count(df.unionByName(df)).first().duplicate_rows == 6


def test_drift_against_brute_force(spark):
    rng = random.Random(5)
    a, b = [rng.gauss(0, 1) for _ in range(300)], [rng.gauss(0.3, 1) for _ in range(200)]
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "x double")
    got = evaluate.drift(frame(a), frame(b)).first()
    grid = sorted(a + b)
    cdf = lambda v, x: sum(y <= x for y in v) / len(v)
    assert got.ks_statistic == pytest.approx(max(abs(cdf(a, x) - cdf(b, x)) for x in grid))
    root = math.sqrt(300 * 200 / 500) * got.ks_statistic
    series = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * root * root) for k in range(1, 101))
    assert got.p_value == pytest.approx(series)
    assert evaluate.drift(frame(a), frame(a)).first().p_value == 1.0


def test_risk_levels(spark):
    cases = [(2.0, True, 0, "HIGH"), (4.0, False, 1, "MEDIUM"), (6.0, False, 0, "LOW"), (9.0, False, 0, "MINIMAL")]
    df = spark.createDataFrame([c[:3] for c in cases], "q double, h boolean, a int")
    got = [r[0] for r in df.select(classify.risk_level(F.col("q"), F.col("h"), F.col("a"))).collect()]
    assert got == [c[3] for c in cases]


def test_histogram_puts_the_maximum_in_the_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 10]], "v double")
    assert sorted((r.bin, r.n) for r in report.histogram(df, "v", 10).collect()) == [(0, 1), (1, 1), (2, 1), (9, 1)]
