"""The registry and a cross-section of queries against their SQL twins on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from trafficward.catalog.all import REGISTRY
from trafficward.sources import sinks, traffic
from trafficward.sources.events import load_traffic

FOLDER = "/root/testdata/sf0.001"
TABLES = ["events", "documents", "embeddings", "pages", "labels"]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return connection


def test_contract():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert all(callable(q) for q in driver.queries().values())


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert rows and all(0 <= r.quality_score <= 100 for r in rows)


@pytest.mark.parametrize(
    "name",
    ["A01_csv_scan", "B05_summary", "C09_private_ip", "D08_ip_burst", "D12_volume_percentile", "E10_agent_patterns",
     "E12_behaviour", "G09_quartiles", "I15_closed_form_quality", "K03_bursts", "L04_reason_codes", "M06_validation",
     "N11_quality_trend", "P01_channel_metrics", "P05_request_gaps"],
)
def test_query_equals_its_twin(spark, db, name):
    df = REGISTRY[name].run(spark, FOLDER)
    answer = db.execute(REGISTRY[name].twin())
    names = [d[0] for d in answer.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted((dict(zip(names, r)) for r in answer.fetchall()), key=lambda r: repr(sorted(r.items())))
    found = sorted((r.asDict() for r in df.collect()), key=lambda r: repr(sorted(r.items())))
    assert len(found) == len(expected)
    for a, b in zip(found, expected):
        for key, value in b.items():
            assert a[key] == (pytest.approx(value, abs=2e-6) if isinstance(value, float) else value), key


def test_stored_table_prunes_days_and_pushes_filters(spark, tmp_path):
    path = str(tmp_path / "table")
    sinks.write_table(load_traffic(spark, FOLDER), path)
    stored = spark.read.parquet(path).where((F.col("dt") == "2024-01-03") & (F.col("channelId") == "ch_5")).select("ip")
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "EqualTo(channelId,ch_5)" in plan


def test_missing_result_reads_empty(spark, tmp_path):
    assert sinks.read_or_empty(spark, str(tmp_path / "none"), "a int, b string").columns == ["a", "b"]


def test_required_columns(spark):
    with pytest.raises(ValueError, match="channelId"):
        traffic.require_columns(spark.range(1).withColumn("date", F.current_timestamp()))
