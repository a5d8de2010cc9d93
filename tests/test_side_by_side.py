"""Independent chains of jobs at the same time, and what the full job stores for them."""

from __future__ import annotations

import threading

import pytest

from trafficward.operators import anomaly, similarity
from trafficward.plans import jobs
from trafficward.session import side_by_side
from trafficward.sources.events import load_traffic

SMALL = "/root/testdata/sf0.001"


def test_steps_meet_and_keep_their_order(spark):
    gate = threading.Barrier(3, timeout=60)

    def step(i):
        gate.wait()  # opens only when all three run
        return spark.range(i).count()

    assert side_by_side(spark, [lambda i=i: step(i) for i in (3, 1, 2)]) == [3, 1, 2]


def test_an_error_of_a_step_is_raised(spark):
    def broken():
        raise ValueError("broken")

    with pytest.raises(ValueError, match="broken"):
        side_by_side(spark, [broken, lambda: spark.range(5).count()])
    assert spark.range(5).count() == 5


def test_anomaly_families_run_at_the_same_time(spark, monkeypatch):
    gate = threading.Barrier(5, timeout=60)
    flags = spark.createDataFrame([("a", True)], "channelId string, temporal_anomaly boolean")

    def family(*_):
        gate.wait()
        return flags

    for name in ("temporal", "geographic", "device", "behavioural", "volume"):
        monkeypatch.setattr(anomaly, f"{name}_anomalies", family)
    found = anomaly.detect(flags)
    assert list(found) == ["temporal", "geographic", "device", "behavioral", "volume"] and not found.failed


def test_tries_of_kmeans_are_those_of_single_fits(spark):
    points = spark.createDataFrame([(f"p{i}", [float(i % 7), float(i % 3)]) for i in range(60)], "id string, vec array<double>")
    _, best = similarity.kmeans(points, 4, tries=6)
    costs = [similarity.kmeans(points, 4, tries=1, seed=42 + i)[1].summary.trainingCost for i in range(6)]
    assert best.summary.trainingCost == pytest.approx(min(costs))


def test_the_full_job_reads_its_rows_from_a_table(spark, monkeypatch):
    """A checkpoint would hand every column of the log to each of its readers."""
    plans = []
    metrics = jobs.channels.quality_metrics

    class Seen(Exception):
        pass

    def look(rows):
        plans.append(metrics(rows)._jdf.queryExecution().optimizedPlan().toString())
        raise Seen

    monkeypatch.setattr(jobs.channels, "quality_metrics", look)
    with pytest.raises(Seen):
        jobs.score_log(load_traffic(spark, SMALL))
    assert "LogicalRDD" not in plans[0] and "parquet" in plans[0].lower()
    assert "userAgent#" not in plans[0].split("Relation")[0]
