"""Sequences of a hot entity: equal to plain windows, in parts of about equal size."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trafficward.operators import sequence
from trafficward.schema import TIE


def requests(n: int = 900):
    rng = random.Random(8)
    start = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.4
        at = start + dt.timedelta(milliseconds=rng.randint(0, 999)) if hot else start + dt.timedelta(seconds=rng.randint(0, 90_000))
        rows.append((i, at, "10.0.0.1" if hot else f"10.0.1.{rng.randint(0, 60)}"))
    rows += [(n, start, None), (n + 1, None, "10.0.0.1"), (n + 2, None, None), (n + 3, start, "10.0.0.1"), (n + 4, start, "10.0.0.1")]
    return rows


def by_entity(rows):
    out = {}
    for i, at, ip in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[1], r[0])):
        out.setdefault(ip, []).append((at, i))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(requests(), f"{TIE} long, date timestamp, ip string").repartition(3).persist()


@pytest.mark.parametrize("parts", [1, 9, 64])
def test_gaps_and_frames_across_borders(spark, table, parts, monkeypatch):
    whole = sequence.with_neighbours
    monkeypatch.setattr(sequence, "with_neighbours", lambda *a, **b: whole(*a, **b, parts=parts))
    got = {r[TIE]: (r.ip_time_gap, r.burst) for r in sequence.add_gaps(table, "ip", "burst").collect()}
    rolled = {r[TIE]: r for r in sequence.rolling(table, "ip", 1).collect()}
    assert len(got) == table.count()
    for items in by_entity(requests()).values():
        stamp = [at.timestamp() for at, _ in items]
        for j, (_, i) in enumerate(items):
            gap = int(stamp[j] // 1) - int(stamp[j - 1] // 1) if j else 0
            assert got[i] == (gap, int(j > 0 and stamp[j] - stamp[max(0, j - 5)] < 300))
            near = [stamp[x] - stamp[x - 1] for x in range(max(1, j - 2), min(len(items), j + 3))]
            assert rolled[i].rolling_mean == (pytest.approx(sum(near) / len(near), abs=1e-6) if near else None)
    assert got[900][0] == 0 and got[902][0] == 0


def test_a_hot_entity_is_spread(spark, table):
    rows, _ = sequence.with_neighbours(table, "ip", before=5, parts=12)
    sizes = sorted(r["count"] for r in rows.where(~F.col("_carry")).groupBy("_part").count().collect())
    assert len(sizes) == 12 and sizes[-1] <= 2 * sizes[6]
    assert rows.where("_carry").count() <= 11 * 5
    hot = rows.where((F.col("ip") == "10.0.0.1") & ~F.col("_carry")).select("_part").distinct().count()
    assert hot >= 4


def test_no_rows(spark):
    nothing = spark.createDataFrame([], f"{TIE} long, date timestamp, ip string")
    assert sequence.add_gaps(nothing, "ip", "burst").collect() == [] and sequence.bursts(nothing, "ip").collect() == []
