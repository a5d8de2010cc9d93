"""Streams over the event files, run to completion and read back from their sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import configure, new_folder, settle
from ..sources.events import events_as_traffic
from ..streaming import live
from .base import query
from .channel_queries import _JUDGED, flags, scores


def _stream(t):
    configure(t.spark)
    schema = t.read("events").schema
    return events_as_traffic(live.read_files(t.spark, t.folder, schema, "events.parquet"))


def _sliced(t, slices: int = 3):
    """The events as a stream of one micro-batch per time slice, in order of time."""
    configure(t.spark)
    events = t.read("events")
    at = F.col("ts").cast("timestamp").cast("double")
    edges = events.select(F.percentile_approx(at, [i / slices for i in range(1, slices)], 10000)).first()[0] or []
    folder = new_folder(t.spark, "event-slices")
    numbered = events.withColumn("_slice", sum((F.when(at > e, 1).otherwise(0) for e in edges), F.lit(0)))
    for i in range(slices):
        numbered.where(F.col("_slice") == i).drop("_slice").coalesce(1).write.mode("append").parquet(folder)
    return events_as_traffic(live.read_files(t.spark, folder, events.schema, files_per_batch=1))


def _counts(t, stream, name: str, keys: list[str]):
    path = new_folder(t.spark, name)
    live.write_counts(stream, f"{path}/out", f"{path}/log").awaitTermination()
    return live.read_counts(t.spark, f"{path}/out", keys)


@query("P01_channel_metrics", "slot:s channelId:s requests:i bots:i datacenter:i high_risk:i", """SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS slot, * FROM (SELECT date_trunc('hour', date) AS h, channelId, count(*) AS requests, sum(isLikelyBot::INT) AS bots,
    sum(isIpDatacenter::INT) AS datacenter, sum((isIpDatacenter::INT + isIpAnonymous::INT + isIpCrawler::INT + isIpPublicProxy::INT + coalesce(isIpVPN, false)::INT + isIpTOR::INT + isIpResidentialProxy::INT >= 2)::INT) AS high_risk
    FROM traffic GROUP BY ALL)""")
def _(t):
    found = _counts(t, live.channel_metrics(_sliced(t)), "metrics-stream", ["slot", "channelId"])
    return found.withColumn("slot", F.date_format("slot", "yyyy-MM-dd HH:mm:ss"))


@query("P01_channel_totals", "channelId:s requests:i bots:i ips:i", """SELECT channelId, count(*) AS requests, sum(isLikelyBot::INT) AS bots, count(DISTINCT ip) AS ips
    FROM traffic WHERE channelId IS NOT NULL GROUP BY channelId""")
def _(t):
    return live.channel_totals(_counts(t, live.channel_metrics(_sliced(t)), "metrics-stream", ["slot", "channelId"]))


@query("P02_scored_rows", "eventId:i classification:s risk_score:f reason_codes:s", _JUDGED)
def _(t):
    path = new_folder(t.spark, "scored-stream")
    arriving = _stream(t).where(F.col("ip").isNotNull() & ~F.col("ip").rlike("(?i)nan|none|null"))
    live.write_scored(arriving, settle(scores(t)), settle(flags(t)), f"{path}/out", f"{path}/log").awaitTermination()
    return t.spark.read.parquet(f"{path}/out")


@query("P03_repeat_suppression", "eventId:i request_key:s", """SELECT eventId, request_key FROM (SELECT *, floor(epoch(date))::BIGINT - lag(floor(epoch(date))::BIGINT) OVER (PARTITION BY request_key ORDER BY date, eventId) AS gap
    FROM (SELECT eventId, date, md5('{"channelId":"' || channelId || '","ip":"' || ip || '","device":"' || device || '"}') AS request_key FROM traffic)) WHERE gap IS NULL OR gap > 3600""")
def _(t):
    path = new_folder(t.spark, "repeat-stream")
    live.write_fresh(_sliced(t), ["channelId", "ip", "device"], path, f"{path}/log").awaitTermination()
    return t.spark.read.parquet(f"{path}/fresh")


@query("P04_ip_bursts", "slot:s ip:s requests:i", """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS slot, ip, count(*) AS requests FROM (SELECT ip, date_trunc('minute', date) - to_minutes(m) AS w FROM traffic, range(5) r(m))
    GROUP BY w, ip HAVING count(*) >= 2""")
def _(t):
    found = _counts(t, live.ip_bursts(_sliced(t), threshold=2), "burst-stream", ["slot", "ip"])
    return found.withColumn("slot", F.date_format("slot", "yyyy-MM-dd HH:mm:ss"))


@query("P05_request_gaps", "eventId:i ip:s ip_time_gap:i", """SELECT eventId, ip, coalesce(floor(epoch(date))::BIGINT - lag(floor(epoch(date))::BIGINT) OVER (PARTITION BY ip ORDER BY date, eventId), 0) AS ip_time_gap FROM traffic""")
def _(t):
    path = new_folder(t.spark, "gap-stream")
    live.write_gaps(_sliced(t), path, f"{path}/log").awaitTermination()
    return t.spark.read.parquet(f"{path}/gaps")
