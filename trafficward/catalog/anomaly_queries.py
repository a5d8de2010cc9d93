"""Anomaly families and their combination."""

from __future__ import annotations


from ..operators import anomaly as an, channels as ch, detectors as det
from ..schema import ANOMALY_FLAGS
from ..session import settle
from .base import query
from .channel_queries import flags


def _counts(t):
    return ch.time_counts(t.rows)


@query("K01_hourly_anomalies", "channelId:s hourly_anomaly:b hourly_anomaly_score:f")
def _(t):
    return an.hourly_anomalies(settle(_counts(t)))


@query("K02_daily_anomalies", "channelId:s daily_anomaly:b daily_max_z_score:f", "SELECT *, daily_max_z_score > 2 AS daily_anomaly FROM daily")
def _(t):
    return an.daily_anomalies(_counts(t))


def _burst_sql(entity: str) -> str:
    return f"""SELECT '{entity}' AS level, entity_id, count(*) AS burst_count, min(gap) AS min_time_diff FROM (SELECT {entity} AS entity_id, gap,
      (sum(gap) OVER w - gap) / 4 AS m, (sum(gap * gap) OVER w - gap * gap) AS q, count(gap) OVER w AS n FROM
      (SELECT *, epoch(date) - lag(epoch(date)) OVER (PARTITION BY {entity} ORDER BY date, eventId) AS gap FROM hits)
      WINDOW w AS (PARTITION BY {entity} ORDER BY date, eventId ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
    WHERE n = 5 AND gap < m - 2 * sqrt(greatest((q - 4 * m * m) / 3, 0)) GROUP BY entity_id"""


@query("K03_bursts", "level:s entity_id:s burst_count:i min_time_diff:f", f"{_burst_sql('channelId')} UNION ALL {_burst_sql('ip')}")
def _(t):
    return an.burst_anomalies(t.clean)


@query("K03_bursts_faithful", "level:s entity_id:s burst_count:i", "SELECT 'channelId' AS level, channelId AS entity_id, 0 AS burst_count FROM hits WHERE false")
def _(t):
    return an.burst_anomalies(t.clean, "faithful")


@query("K04_geographic_anomalies", "channelId:s geo_anomaly_score:f geo_is_anomaly:b country_diversity:i dominant_country_pct:f multi_country_ips:i ip_geo_anomaly:b")
def _(t):
    return an.geographic_anomalies(t.clean)


@query("K05_ip_geography", "channelId:s multi_country_ips:i country_diversity:i ip_geo_anomaly:b", "SELECT * FROM ip_geo")
def _(t):
    return an.ip_geography(t.clean)


@query("K06_device_anomalies", "channelId:s device_isolation_forest_anomaly:b device_lof_anomaly:b device_one_class_svm_anomaly:b device_anomaly_ensemble:b")
def _(t):
    return an.device_anomalies(t.clean)


@query("K07_behavioural_anomalies", "channelId:s behavioral_isolation_forest_anomaly:b behavioral_elliptic_envelope_anomaly:b behavioral_one_class_svm_anomaly:b behavioral_anomaly_ensemble:b")
def _(t):
    return an.behavioural_anomalies(t.clean)


_VOLUME = ["total_requests", "unique_ips", "unique_users", "suspicious_ip_requests"]


@query("K08_volume_anomalies", "channelId:s " + " ".join(f"{v}_anomaly:b" for v in _VOLUME), "SELECT * FROM volume_flags")
def _(t):
    return an.volume_anomalies(t.clean)


@query("K08_volume_features", "channelId:s " + " ".join(f"{v}:i" for v in _VOLUME), "SELECT * FROM volumes")
def _(t):
    return an.volume_features(t.clean)


@query("K09_suspicious_ips", "ip:s requests_per_ip:i channels_per_ip:i", "SELECT * FROM suspect_ips")
def _(t):
    return an.suspicious_ips(t.clean)


@query("K10_busy_channels", "channelId:s daily_anomaly:b daily_max_z_score:f", """SELECT channelId, CASE WHEN busy THEN daily_max_z_score > 2 ELSE false END AS daily_anomaly,
    CASE WHEN busy THEN daily_max_z_score ELSE 0 END AS daily_max_z_score FROM daily JOIN (SELECT channelId, count(*) >= 65 AS busy FROM hits GROUP BY channelId) USING (channelId)""")
def _(t):
    found = an.daily_anomalies(ch.time_counts(an.busy_channels(t.rows, 65)))
    return an.with_defaults(found, an.channel_keys(t.clean))


@query("K11_temporal_anomalies", "channelId:s hourly_anomaly:b hourly_anomaly_score:f daily_anomaly:b daily_max_z_score:f burst_count:i min_time_diff:f")
def _(t):
    return an.temporal_anomalies(t.rows)


@query("K12_wide_flags", "channelId:s daily_anomaly:b ip_geo_anomaly:b " + " ".join(f"{v}_anomaly:b" for v in _VOLUME) + " overall_anomaly_count:i overall_anomaly_flag:b",
       "SELECT *, c AS overall_anomaly_count, c >= 2 AS overall_anomaly_flag FROM (SELECT *, daily_max_z_score > 2 AS daily_anomaly, (daily_max_z_score > 2)::INT + ip_geo_anomaly::INT + "
       + " + ".join(f"{v}_anomaly::INT" for v in _VOLUME) + " AS c FROM daily JOIN ip_geo USING (channelId) JOIN volume_flags USING (channelId))")
def _(t):
    return an.wide_flags([an.daily_anomalies(_counts(t)), an.ip_geography(t.clean), an.volume_anomalies(t.clean)])


@query("K13_canonical_flags", "channelId:s " + " ".join(f"{f}:b" for f in ANOMALY_FLAGS) + " overall_anomaly_count:i overall_anomaly_flag:b", "SELECT * FROM flags")
def _(t):
    return flags(t)


@query("K13_all_families", "channelId:s " + " ".join(f"{f}:b" for f in ANOMALY_FLAGS) + " overall_anomaly_count:i overall_anomaly_flag:b")
def _(t):
    found = an.detect(t.rows).complete()
    return an.canonical_flags(found, an.channel_keys(t.clean))


@query("K15_hourly_traffic", "hour:i traffic_count:i z_score:f is_anomaly:b", """SELECT *, z_score > 2 AS is_anomaly FROM (SELECT hour, count(*) AS traffic_count,
    coalesce(abs(count(*) - avg(count(*)) OVER ()) / nullif(stddev_pop(count(*)) OVER (), 0), 0) AS z_score FROM hits GROUP BY hour)""")
def _(t):
    return an.hourly_traffic_anomalies(t.rows)


@query("K16_contamination_flag", "channelId:s flagged:b", "SELECT channelId, quality_score < (SELECT quantile_cont(quality_score, 0.1) FROM closed) AS flagged FROM closed")
def _(t):
    return det.flag_lowest(ch.closed_form_quality(t.rows), "quality_score", 0.1, "flagged")


@query("G08_busiest_bursts", "level:s entity_id:s burst_count:i", f"""SELECT * FROM ({_burst_sql('channelId')} UNION ALL {_burst_sql('ip')}) WHERE
    (level = 'channelId' AND entity_id IN (SELECT channelId FROM hits GROUP BY channelId ORDER BY count(*) DESC, channelId LIMIT 40))
    OR (level = 'ip' AND entity_id IN (SELECT ip FROM hits GROUP BY ip ORDER BY count(*) DESC, ip LIMIT 40))""")
def _(t):
    return an.burst_anomalies(t.clean, approximate=True, n=40)


