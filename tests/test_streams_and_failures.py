"""Streams cut into different batches, failing detector families, repeated ids and empty inputs."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trafficward.operators import anomaly, classify, detectors, similarity
from trafficward.schema import ANOMALY_FLAGS, TIE
from trafficward.streaming import live


@pytest.fixture(scope="module")
def requests():
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    at = 0
    rows = []
    for i in range(400):
        at += rng.choice([0, 1, 60, 900, 4000])
        rows.append((i, start + dt.timedelta(seconds=at), f"10.0.0.{rng.randint(0, 5)}", rng.choice("ab")))
    return rows


def stream(spark, tmp_path, rows, batches):
    schema = f"{TIE} long, date timestamp, ip string, device string"
    folder = str(tmp_path / f"in{batches}")
    size = -(-len(rows) // batches)
    for i in range(batches):
        part = rows[i * size : (i + 1) * size]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return live.read_files(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)


@pytest.mark.parametrize("ttl", [None, 3000])
def test_gaps_do_not_depend_on_batches(spark, tmp_path, requests, ttl):
    wanted, last = [], {}
    for i, at, ip, _ in requests:
        gap = int((at - last[ip]).total_seconds()) if ip in last else 0
        wanted.append((i, gap if ttl is None or gap <= ttl else 0))
        last[ip] = at
    for batches in (1, 3, 10):
        path = str(tmp_path / f"gaps{batches}")
        live.write_gaps(stream(spark, tmp_path, requests, batches), path, f"{path}/log", ttl_seconds=ttl).awaitTermination()
        got = sorted((r[TIE], r.ip_time_gap) for r in spark.read.parquet(f"{path}/gaps").collect())
        assert got == wanted


def test_repeats_do_not_depend_on_batches(spark, tmp_path, requests):
    wanted, last = [], {}
    for i, at, ip, device in requests:
        if (ip, device) not in last or (at - last[ip, device]).total_seconds() > 3600:
            wanted.append(i)
        last[ip, device] = at
    assert 0 < len(wanted) < len(requests)
    for batches in (1, 3, 10):
        path = str(tmp_path / f"fresh{batches}")
        live.write_fresh(stream(spark, tmp_path, requests, batches), ["ip", "device"], path, f"{path}/log").awaitTermination()
        assert sorted(r[TIE] for r in spark.read.parquet(f"{path}/fresh").collect()) == wanted


def test_silent_keys_are_forgotten_and_orphans_are_firsts(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=i), f"10.0.0.{i}", "a") for i in range(12)]
    rows += [(20 + i, start + dt.timedelta(hours=11, seconds=i + 1), None if i % 2 else "10.0.0.11", "a") for i in range(6)]
    path = str(tmp_path / "silent")
    query = live.write_gaps(stream(spark, tmp_path, rows, 9), path, f"{path}/log", ttl_seconds=60)
    query.awaitTermination()
    got = {r[TIE]: r.ip_time_gap for r in spark.read.parquet(f"{path}/gaps").collect()}
    assert got == {i: 0 for i in range(12)} | {20: 1, 21: 0, 22: 2, 23: 0, 24: 2, 25: 0}
    state = query.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] < 8  # twelve addresses came by, only the last ones and their timers remain


def test_state_is_kept_by_buckets_and_outside_the_heap(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=i // 4), f"10.0.{i % 3000}", "a") for i in range(6000)]
    path = str(tmp_path / "many")
    query = live.write_gaps(stream(spark, tmp_path, rows, 2), path, f"{path}/log")
    query.awaitTermination()
    got = {r[TIE]: r.ip_time_gap for r in spark.read.parquet(f"{path}/gaps").collect()}
    assert got == {i: 0 if i < 3000 else 750 for i in range(6000)}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1024  # 3,000 addresses
    counted = live.write_counts(live.ip_bursts(stream(spark, tmp_path, rows[:40], 1), 2), f"{path}/out", f"{path}/log2")
    counted.awaitTermination()
    assert any(k.lower().startswith("rocksdb") for k in counted.lastProgress["stateOperators"][0]["customMetrics"])


def test_counts_hold_open_windows_and_do_not_depend_on_batches(spark, tmp_path, requests):
    wanted = {}
    for _, at, ip, _ in requests:
        for back in range(5):
            slot = at.replace(second=0) - dt.timedelta(minutes=back)
            wanted[slot, ip] = wanted.get((slot, ip), 0) + 1
    wanted = {k: n for k, n in wanted.items() if n >= 2}
    for batches in (1, 3, 10):
        path = str(tmp_path / f"counts{batches}")
        live.write_counts(live.ip_bursts(stream(spark, tmp_path, requests, batches), 2), f"{path}/out", f"{path}/log").awaitTermination()
        got = live.read_counts(spark, f"{path}/out", ["slot", "ip"]).collect()
        assert {(r.slot, r.ip): r.requests for r in got} == wanted and len(got) == len(wanted)


def test_a_failing_family_is_null_and_named(spark, monkeypatch):
    ok = spark.createDataFrame([("a", True), ("b", False)], "channelId string, flag boolean")
    names = {family: flags for family, (_, flags) in anomaly.CANONICAL.items()}
    result = lambda family: ok.select("channelId", F.col("flag").alias(names[family][0]))

    def late_failure(*_):  # planned well, fails when it runs
        return ok.select("channelId", F.raise_error(F.lit("broken")).cast("boolean").alias(names["volume"][0]))

    for name, family in (("temporal_anomalies", "temporal"), ("geographic_anomalies", "geographic"), ("device_anomalies", "device")):
        monkeypatch.setattr(anomaly, name, lambda *_, family=family: result(family))
    monkeypatch.setattr(anomaly, "behavioural_anomalies", lambda *_: 1 / 0)
    monkeypatch.setattr(anomaly, "volume_anomalies", late_failure)
    found = anomaly.detect(ok)
    assert set(found) == {"temporal", "geographic", "device"} and set(found.failed) == {"behavioral", "volume"}
    table = {r.channelId: r for r in anomaly.canonical_flags(found, ok.select("channelId")).collect()}
    lost = {anomaly.CANONICAL[f][0] for f in found.failed}
    for channel, raised in (("a", True), ("b", False)):
        assert {f: table[channel][f] for f in ANOMALY_FLAGS} == {f: None if f in lost else raised for f in ANOMALY_FLAGS}
        assert table[channel].overall_anomaly_count == 3 * raised


def test_a_failure_is_no_result(spark, monkeypatch):
    """The query of all five families must not give a table when one of them is broken."""
    from trafficward.catalog.all import REGISTRY

    ok = spark.createDataFrame([("a", False), ("b", True)], "channelId string, volume_anomaly boolean")
    for name in ("temporal", "geographic", "device", "volume"):
        monkeypatch.setattr(anomaly, f"{name}_anomalies", lambda *_: ok)
    monkeypatch.setattr(anomaly, "behavioural_anomalies", lambda *_: 1 / 0)
    with pytest.raises(anomaly.DetectionError, match="behavioral: ZeroDivisionError"):
        REGISTRY["K13_all_families"].run(spark, "/root/testdata/sf0.001")
    table = {r.channelId: r for r in anomaly.canonical_flags(anomaly.detect(ok), ok.select("channelId")).collect()}
    assert all(r.behavioral_anomaly is None for r in table.values())
    assert table["a"].overall_anomaly_flag is False and table["b"].overall_anomaly_flag is None  # one more would raise it


def test_repeated_row_ids_do_not_multiply(spark):
    rows = spark.createDataFrame([(i % 5, "a") for i in range(10)], f"{TIE} long, channelId string")
    quality = spark.createDataFrame([("a", 4.0)], "channelId string, quality_score double")
    flags = spark.createDataFrame([(i % 5, i == 3) for i in range(10)], f"{TIE} long, volume_anomaly boolean")
    got = classify.with_scores(rows, quality, flags, level="row").collect()
    assert len(got) == 10 and sorted(r[TIE] for r in got if r.volume_anomaly) == [3, 3]


def test_empty_inputs_give_empty_results(spark):
    points = spark.createDataFrame([], "id string, vec array<double>")
    assert detectors.elliptic_envelope(points).columns == ["id", "mahalanobis", "envelope_anomaly"]
    assert detectors.elliptic_envelope(points).collect() == []
    assert detectors.one_class_svm(points).collect() == []
    projected, shares = similarity.principal_components(points)
    assert projected.collect() == [] and shares == []


def test_every_row_can_reach_a_tree(spark):
    points = spark.range(6000).select(F.col("id").cast("string").alias("id"), F.array(F.rand(1), F.rand(2)).alias("vec"))
    forest = detectors.IsolationForest.fit(points, trees=40, sample=64)
    assert len(forest.trees) == 40 and forest.sample == 64
    odd = spark.createDataFrame([("far", [9.0, -9.0]), ("near", [0.5, 0.5])], "id string, vec array<double>")
    scores = {r.id: r.score for r in forest.score(odd).collect()}
    assert scores["far"] > 0.6 > scores["near"]
