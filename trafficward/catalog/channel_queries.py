"""Channel aggregates, pivots, joins, set operations, scoring and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import SEGMENTS
from ..functions.text import add_location, add_platform
from ..functions.agent import add_parsed_agent
from ..operators import anomaly as an, channels as ch, classify as cf, patterns as pt, quality as ql, tables as tb
from ..operators.ranks import quantiles
from ..operators.similarity import similar_channels
from .base import hash01, query


def metrics(t):
    return ch.quality_metrics(t.rows)


def scores(t):
    return ql.rule_scores(metrics(t))


def flags(t):
    """Canonical flags from the detectors that need no fitted model."""
    rows = t.rows
    found = {
        "temporal": an.daily_anomalies(ch.time_counts(rows)),
        "geographic": an.ip_geography(t.clean).withColumnRenamed("ip_geo_anomaly", "geo_anomaly"),
        "volume": an.volume_anomalies(t.clean),
    }
    return an.canonical_flags(found, an.channel_keys(t.clean))


_r4 = lambda e: f"round_even({e}, 4)"
_E01 = {
    "channel_isLikelyBot_mean": _r4("avg(isLikelyBot::INT)"),
    "channel_total_fraud_flags_mean": _r4("avg(total_fraud_flags)"),
    "channel_weighted_fraud_score_mean": _r4("avg(weighted_fraud_score)"),
    "channel_weighted_fraud_score_max": _r4("max(weighted_fraud_score)"),
    "channel_hour_mean": _r4("avg(hour)"),
    "channel_hour_std": _r4("stddev_samp(hour)"),
    "channel_day_of_week_mean": _r4("avg(day_of_week)"),
    "channel_day_of_week_std": _r4("stddev_samp(day_of_week)"),
    **{f"channel_{c}_mean": _r4(f"avg({c})") for c in [
        "is_weekend", "is_night", "is_business_hours", "ua_length", "ua_entropy", "ip_entropy", "keyword_length", "keyword_commercial_intent"]},
    "channel_bot_ratio": _r4("sum(isLikelyBot::INT) / count(date)"),
    "channel_unique_ip_ratio": _r4("count(DISTINCT ip) / count(date)"),
}
_E01_INT = {
    "channel_date_count": "count(date)",
    "channel_isLikelyBot_sum": "sum(isLikelyBot::INT)",
    "channel_total_fraud_flags_sum": "sum(total_fraud_flags)",
    **{f"channel_{c}_nunique": f"count(DISTINCT {c})" for c in ["country", "browser", "device", "ip"]},
}


@query("E01_channel_features", "channelId:s " + " ".join(f"{c}:f" for c in _E01) + " " + " ".join(f"{c}:i" for c in _E01_INT),
       "SELECT channelId, " + ", ".join(f"{e} AS {n}" for n, e in {**_E01, **_E01_INT}.items()) + " FROM hits GROUP BY channelId")
def _(t):
    return ch.channel_features(t.rows)


@query("E02_quality_metrics", "channelId:s " + " ".join(f"{c}:f" for c in ql.METRICS), "SELECT * FROM metrics")
def _(t):
    return metrics(t)


@query("E03_light_features", "channelId:s volume:i bot_rate:f ip_diversity:i hour_diversity:i day_diversity:i device_diversity:i browser_diversity:i",
       """SELECT channelId, count(*) AS volume, avg(isLikelyBot::INT) AS bot_rate, count(DISTINCT ip) AS ip_diversity, count(DISTINCT hour) AS hour_diversity,
    count(DISTINCT day_of_week) AS day_diversity, count(DISTINCT device) AS device_diversity, count(DISTINCT browser) AS browser_diversity FROM hits GROUP BY channelId""")
def _(t):
    return ch.light_features(t.rows)


@query("E03_light_features_sampled", "channelId:s volume:i bot_rate:f ip_diversity:i hour_diversity:i",
       f"""SELECT channelId, max(volume) AS volume, avg(isLikelyBot::INT) AS bot_rate, count(DISTINCT ip) AS ip_diversity, count(DISTINCT hour) AS hour_diversity
    FROM (SELECT *, count(*) OVER (PARTITION BY channelId) AS volume, row_number() OVER (PARTITION BY channelId ORDER BY {hash01('eventId::VARCHAR')}, eventId) AS turn FROM hits)
    WHERE turn <= 1000 GROUP BY channelId""")
def _(t):
    return ch.light_features(t.rows, approximate=True)


_PROFILE = [f"hour_{h}_traffic" for h in range(24)]


@query("E04_channel_profiles", "channelId:s " + " ".join(f"{c}:i" for c in _PROFILE) + " mobile_ratio:f top_countries_diversity:i weekend_ratio:f avg_ip_risk_score:f bot_ratio:f",
       "SELECT channelId, " + ", ".join(f"count(*) FILTER (WHERE hour = {h}) AS hour_{h}_traffic" for h in range(24)) + """,
    avg(coalesce(device = 'mobile', false)::INT) AS mobile_ratio, count(DISTINCT country) AS top_countries_diversity, avg(is_weekend) AS weekend_ratio,
    avg(ip_risk_points) AS avg_ip_risk_score, avg(isLikelyBot::INT) AS bot_ratio FROM hits GROUP BY channelId""")
def _(t):
    return ch.profiles(t.rows)


def _pivot_sql(column, values, prefix):
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "SELECT channelId, " + ", ".join(f"count(*) FILTER (WHERE {column} = {quote(v)}) AS {prefix}{v}" for v in values) + " FROM hits GROUP BY channelId"


@query("E05_hourly_pivot", "channelId:s " + " ".join(f"hour_{h}:i" for h in range(24)), _pivot_sql("hour", range(24), "hour_"))
def _(t):
    return pt.hourly_pivot(t.rows)


@query("E05_weekday_pivot", "channelId:s " + " ".join(f"dow_{d}:i" for d in range(7)), _pivot_sql("day_of_week", range(7), "dow_"))
def _(t):
    return pt.weekday_pivot(t.rows)


@query("E05_segment_pivot", "channelId:s " + " ".join(f"segment_{s}:i" for s in SEGMENTS), _pivot_sql("time_segment", SEGMENTS, "segment_"))
def _(t):
    return pt.segment_pivot(t.rows)


@query("E06_time_counts", "channelId:s " + " ".join(f"hour_{h}:i" for h in range(24)) + " " + " ".join(f"dow_{d}:i" for d in range(7)),
       f"SELECT * FROM ({_pivot_sql('hour', range(24), 'hour_')}) JOIN ({_pivot_sql('day_of_week', range(7), 'dow_')}) USING (channelId)")
def _(t):
    return ch.time_counts(t.rows)


@query("E07_device_share", "device:s n:i share:f", "SELECT device, count(*) AS n, count(*) / (SELECT count(*) FROM hits) AS share FROM hits GROUP BY device")
def _(t):
    return pt.shares(t.rows, "device")


@query("E07_device_share_by_channel", "channelId:s device:s n:i share:f",
       "SELECT channelId, device, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY channelId) AS share FROM hits GROUP BY channelId, device")
def _(t):
    return pt.shares(t.rows, "device", "channelId")


@query("E07_device_share_by_hour", "hour:i device:s n:i share:f",
       "SELECT hour, device, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY hour) AS share FROM hits GROUP BY hour, device")
def _(t):
    return pt.shares(t.rows, "device", "hour")


@query("E08_country_counts", "value:s n:i", "SELECT country AS value, count(*) AS n FROM hits WHERE country IS NOT NULL GROUP BY country")
def _(t):
    return pt.country_counts(t.clean)


_CITY = "CASE WHEN json_valid(location) THEN location::JSON->>'$.{}' END"


@query("E08_top_cities", "value:s n:i", f"SELECT value, count(*) AS n FROM (SELECT {_CITY.format('cityName')} AS value FROM clean) WHERE value IS NOT NULL GROUP BY value ORDER BY n DESC, value LIMIT 50")
def _(t):
    return pt.top_cities(add_location(t.clean))


@query("E08_timezone_counts", "value:s n:i", f"SELECT value, count(*) AS n FROM (SELECT {_CITY.format('timezone')} AS value FROM clean) WHERE value IS NOT NULL GROUP BY value")
def _(t):
    return pt.timezone_counts(add_location(t.clean))


@query("E08_country_diversity", "channelId:s country_diversity:i", "SELECT channelId, count(DISTINCT country) AS country_diversity FROM hits GROUP BY channelId")
def _(t):
    return pt.country_diversity(t.clean)


@query("E09_browser_versions", "browser:s browserMajorVersion:i n:i", "SELECT browser, browserMajorVersion, count(*) AS n FROM hits GROUP BY ALL")
def _(t):
    return pt.browser_versions(t.clean)


@query("E09_family_counts", "field:s value:s n:i", """SELECT 'browser_family' AS field, CASE WHEN userAgent = 'curl' THEN 'curl' WHEN userAgent LIKE 'python%' THEN 'Python Requests'
    ELSE 'Chrome' END AS value, count(*) AS n FROM clean WHERE userAgent IS NOT NULL GROUP BY ALL UNION ALL
    SELECT 'os_name', CASE WHEN json_valid(platform) THEN platform::JSON->>'$.os.name' END AS value, count(*) FROM clean WHERE json_valid(platform) GROUP BY ALL""")
def _(t):
    return pt.family_counts(add_parsed_agent(add_platform(t.clean)))


@query("E10_agent_patterns", "channelId:s ua_diversity:i ua_avg_length:f ua_length_std:f short_ua_rate:f dominant_ua_pct:f",
       """SELECT * FROM (SELECT channelId, count(DISTINCT userAgent) AS ua_diversity, avg(length(userAgent)) AS ua_avg_length, stddev_samp(length(userAgent)) AS ua_length_std,
    avg(coalesce(length(userAgent) < 50, false)::INT) AS short_ua_rate FROM hits GROUP BY channelId) JOIN (SELECT channelId, max(c) / max(whole) AS dominant_ua_pct FROM
    (SELECT channelId, userAgent, count(userAgent) AS c, sum(count(*)) OVER (PARTITION BY channelId) AS whole FROM hits GROUP BY channelId, userAgent) GROUP BY channelId) USING (channelId)""")
def _(t):
    return ch.agent_patterns(t.clean)


@query("E11_version_patterns", "channelId:s version_diversity:i avg_version:f version_std:f outdated_browser_rate:f most_common_version:i",
       """SELECT * FROM (SELECT channelId, count(DISTINCT browserMajorVersion) AS version_diversity, avg(browserMajorVersion) AS avg_version, stddev_samp(browserMajorVersion) AS version_std,
    avg((browserMajorVersion < 50)::INT) AS outdated_browser_rate FROM hits GROUP BY channelId) JOIN (SELECT channelId, browserMajorVersion AS most_common_version FROM
    (SELECT channelId, browserMajorVersion, row_number() OVER (PARTITION BY channelId ORDER BY count(*) DESC, browserMajorVersion) AS r FROM hits GROUP BY channelId, browserMajorVersion) WHERE r = 1) USING (channelId)""")
def _(t):
    return ch.version_patterns(t.clean)


_BEHAVIOUR = """SELECT * FROM (SELECT channelId, coalesce(avg(gap), 0) AS avg_time_between_requests, coalesce(stddev_samp(gap), 0) AS time_variance, count(*) FILTER (WHERE gap < 1) AS rapid_requests FROM
      (SELECT channelId, epoch(date) - lag(epoch(date)) OVER (PARTITION BY channelId ORDER BY date, eventId) AS gap FROM hits) GROUP BY channelId)
    JOIN (SELECT channelId, count(DISTINCT keyword) AS keyword_diversity, coalesce(avg(length(keyword)), 0) AS avg_keyword_length, count(DISTINCT referrer) AS referrer_diversity,
      avg((referrer IS NULL)::INT) AS no_referrer_rate FROM hits GROUP BY channelId) USING (channelId)
    JOIN (SELECT channelId, max(c) / max(whole) AS dominant_keyword_pct FROM (SELECT channelId, keyword, count(keyword) AS c, sum(count(*)) OVER (PARTITION BY channelId) AS whole
      FROM hits GROUP BY channelId, keyword) GROUP BY channelId) USING (channelId)"""


@query("E12_behaviour", "channelId:s avg_time_between_requests:f time_variance:f rapid_requests:i keyword_diversity:i avg_keyword_length:f dominant_keyword_pct:f "
       "referrer_diversity:i no_referrer_rate:f", _BEHAVIOUR)
def _(t):
    return ch.behaviour(t.clean)


@query("E13_country_shape", "channelId:s country_diversity:i dominant_country_pct:f", """SELECT channelId, count(*) AS country_diversity, max(c) / sum(c) AS dominant_country_pct FROM
    (SELECT channelId, country, count(*) AS c FROM hits WHERE country IS NOT NULL GROUP BY channelId, country) GROUP BY channelId""")
def _(t):
    return ch.country_shape(t.clean)


@query("E13_channel_country_counts", "channelId:s country:s cnt:i", "SELECT channelId, country, count(*) AS cnt FROM hits WHERE country IS NOT NULL GROUP BY ALL")
def _(t):
    return pt.channel_country_counts(t.clean)


_PAIRS = [(d, b) for d in ["mobile", "notMobile", "tablet"] for b in ["chrome", "edge", "firefox", "safari"]]


@query("E14_device_browser_pivot", "channelId:s " + " ".join(f"dev_{d}_br_{b}:i" for d, b in _PAIRS),
       "SELECT channelId, " + ", ".join(f"count(*) FILTER (WHERE device = '{d}' AND browser = '{b}') AS dev_{d}_br_{b}" for d, b in _PAIRS) + " FROM hits GROUP BY channelId")
def _(t):
    return pt.device_browser_pivot(t.clean)


@query("E15_merge_partial_counts", "channelId:s device:s n:i", "SELECT channelId, device, count(*) AS n FROM hits GROUP BY ALL")
def _(t):
    rows = t.rows
    chunks = [rows.where(F.pmod(F.col("eventId"), F.lit(3)) == i) for i in range(3)]
    return pt.merge_counts([pt.shares(c, "device", "channelId").drop("share") for c in chunks], ["channelId", "device"], ["n"])


@query("E15_merge_partial_distincts", "channelId:s ip:i country:i", "SELECT channelId, count(DISTINCT ip) AS ip, count(DISTINCT country) AS country FROM hits GROUP BY channelId")
def _(t):
    rows = t.rows
    chunks = [rows.where(F.pmod(F.col("eventId"), F.lit(3)) == i) for i in range(3)]
    merged = pt.merge_sketches([pt.distinct_sketches(c, ["channelId"], ["ip", "country"]) for c in chunks], ["channelId"], ["ip", "country"])
    return pt.distinct_estimates(merged, ["ip", "country"])


@query("E17_moments_and_quantiles", "channelId:s var_samp:f std_pop:f q10:f median:f q95:f", """SELECT channelId, var_samp(weighted_fraud_score) AS var_samp,
    stddev_pop(weighted_fraud_score) AS std_pop, quantile_cont(weighted_fraud_score, 0.1) AS q10, median(weighted_fraud_score) AS median,
    quantile_cont(weighted_fraud_score, 0.95) AS q95 FROM hits GROUP BY channelId""")
def _(t):
    rows = t.rows.select("channelId", "weighted_fraud_score")
    q = quantiles(rows, ["weighted_fraud_score"], [0.1, 0.5, 0.95], by=["channelId"])
    pick = lambda p, n: F.max(F.when(F.col("p") == p, F.col("value"))).alias(n)
    wide = q.groupBy("channelId").agg(pick(0.1, "q10"), pick(0.5, "median"), pick(0.95, "q95"))
    moments = rows.groupBy("channelId").agg(F.var_samp("weighted_fraud_score").alias("var_samp"), F.stddev_pop("weighted_fraud_score").alias("std_pop"))
    return moments.join(wide, "channelId")


@query("F01_left_join_aggregate", "eventId:i volume:i", "SELECT eventId, volume FROM hits LEFT JOIN metrics USING (channelId)")
def _(t):
    return tb.lookup(t.rows, metrics(t).select("channelId", "volume"), "channelId")


@query("F02_outer_join_detectors", "channelId:s daily_anomaly:b daily_max_z_score:f ip_geo_anomaly:b multi_country_ips:i burst_count:i",
       """SELECT channelId, coalesce(daily_max_z_score > 2, false) AS daily_anomaly, coalesce(daily_max_z_score, 0) AS daily_max_z_score, coalesce(ip_geo_anomaly, false) AS ip_geo_anomaly,
    coalesce(multi_country_ips, 0) AS multi_country_ips, 0 AS burst_count FROM (SELECT * FROM daily WHERE daily_max_z_score > 1.5) FULL JOIN (SELECT * FROM ip_geo WHERE multi_country_ips > 50) USING (channelId)""")
def _(t):
    daily = an.daily_anomalies(ch.time_counts(t.rows)).where("daily_max_z_score > 1.5")
    geo = an.ip_geography(t.clean).where("multi_country_ips > 50").drop("country_diversity")
    burst = an.bursts(t.clean, "channelId", "faithful").select(F.col("entity_id").alias("channelId"), "burst_count")
    return an.combine([daily, geo, burst])


@query("F03_outer_join_blocks", "channelId:s ua_diversity:i version_diversity:i", """SELECT channelId, coalesce(u, 0) AS ua_diversity, coalesce(v, 0) AS version_diversity FROM
    (SELECT channelId, count(DISTINCT userAgent) AS u FROM hits GROUP BY channelId HAVING u > 20) FULL JOIN
    (SELECT channelId, count(DISTINCT browserMajorVersion) AS v FROM hits GROUP BY channelId HAVING v > 48) USING (channelId)""")
def _(t):
    agents = ch.agent_patterns(t.clean).select("channelId", "ua_diversity").where("ua_diversity > 20")
    versions = ch.version_patterns(t.clean).select("channelId", "version_diversity").where("version_diversity > 48")
    return tb.outer_blocks([agents, versions], "channelId")


@query("F04_lookup_join", "eventId:i country_count:i", "SELECT eventId, c AS country_count FROM hits LEFT JOIN (SELECT country, count(*) AS c FROM hits WHERE country IS NOT NULL GROUP BY country) USING (country)")
def _(t):
    counts = pt.country_counts(t.clean).select(F.col("value").alias("country"), F.col("n").alias("country_count"))
    return tb.lookup(t.rows, counts, "country")


@query("F05_semi_join", "eventId:i ip:s", "SELECT eventId, ip FROM hits WHERE ip IN (SELECT ip FROM suspect_ips)")
def _(t):
    return tb.keep_keys(t.clean, an.suspicious_ips(t.clean), "ip")


@query("F06_reindex", "channelId:s n:i", "SELECT channelId, count(*) FILTER (WHERE isIpTOR) AS n FROM hits GROUP BY channelId")
def _(t):
    counts = t.rows.where("isIpTOR").groupBy("channelId").agg(F.count("*").alias("n"))
    return tb.reindex(counts, an.channel_keys(t.clean), "channelId", {"n": 0})


@query("F07_overlay", "channelId:s volume_anomaly:b", "SELECT channelId, volume_anomaly FROM flags")
def _(t):
    base = an.channel_keys(t.clean).withColumn("volume_anomaly", F.lit(False))
    found = an.volume_anomalies(t.clean)
    raised = F.greatest(*[F.col(c) for c in found.columns if c != "channelId"])
    return an.overlay(base, found.select("channelId", raised.alias("volume_anomaly")), "volume_anomaly")


@query("F08_align", "doc_id:s quality:i toxic:i n_chars:i", "SELECT doc_id, quality, toxic, n_chars FROM documents JOIN labels USING (doc_id)")
def _(t):
    return tb.align(t.read("documents"), t.read("labels"), "doc_id")


@query("H01_append", "channelId:s n:i", "SELECT channelId, count(*) AS n FROM (SELECT * FROM hits UNION ALL SELECT * FROM hits WHERE isLikelyBot) GROUP BY channelId")
def _(t):
    return tb.append([t.clean, t.clean.where("isLikelyBot")]).groupBy("channelId").agg(F.count("*").alias("n"))


@query("H02_distinct_keys", "channelId:s", "SELECT DISTINCT channelId FROM hits")
def _(t):
    return tb.distinct_keys(t.clean, "channelId")


@query("H03_difference", "ip:s", "SELECT ip FROM hits EXCEPT SELECT ip FROM hits WHERE isLikelyBot")
def _(t):
    return tb.difference(t.clean, t.clean.where("isLikelyBot"), "ip")


@query("H04_union_keys", "userId:s", "SELECT userId FROM hits WHERE isIpTOR UNION SELECT userId FROM hits WHERE isIpVPN")
def _(t):
    return tb.union_keys([t.clean.where("isIpTOR"), t.clean.where("isIpVPN")], "userId")


@query("H05_intersection", "ip:s", "SELECT ip FROM hits WHERE isIpDatacenter INTERSECT SELECT ip FROM hits WHERE isIpAnonymous")
def _(t):
    return tb.common_keys(t.clean.where("isIpDatacenter"), t.clean.where("isIpAnonymous"), "ip")


@query("I01_rule_labels", "channelId:s label_band:s original_label:f", "SELECT channelId, label_band, quality_score AS original_label FROM labelled")
def _(t):
    return ql.quality_labels(metrics(t))


_SCALED = ["bot_rate", "ip_diversity", "volume", "fraud_score_avg"]


@query("I02_robust_scale", "channelId:s " + " ".join(f"{c}:f" for c in _SCALED), "SELECT channelId, " + ", ".join(
    f"({c} - median({c}) OVER ()) / coalesce(nullif(quantile_cont({c}, 0.75) OVER () - quantile_cont({c}, 0.25) OVER (), 0), 1) AS {c}" for c in _SCALED) + " FROM metrics")
def _(t):
    return ql.robust_scale(t.stored("metrics", lambda: metrics(t)), _SCALED)


@query("I03_standard_scale", "channelId:s " + " ".join(f"{c}:f" for c in _SCALED), "SELECT channelId, " + ", ".join(
    f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in _SCALED) + " FROM metrics")
def _(t):
    return ql.standard_scale(metrics(t), _SCALED)


@query("I04_split", "channelId:s is_test:b", f"SELECT channelId, {hash01(chr(39) + 'split:' + chr(39) + ' || channelId')} < 0.2 AS is_test FROM metrics")
def _(t):
    return ql.split(metrics(t))


def _prepared(t):
    return t.stored("prepared", lambda: ql.prepare(t.stored("metrics", lambda: metrics(t))))


def _model(t, name):
    return t.once(name, lambda: ql.fit_supervised(_prepared(t), names=(name,)))


def _scorer(t):
    a, b = _model(t, "gbt_a"), _model(t, "gbt_b")
    return ql.Scorer({**a.models, **b.models}, a.metrics + b.metrics, a.features)


@query("I05_boosted_regression", "model:s mse:f mae:f r2:f")
def _(t):
    return _model(t, "gbt_a").metric_table(t.spark)


@query("I06_second_boosted_model", "model:s mse:f mae:f r2:f")
def _(t):
    return _model(t, "gbt_b").metric_table(t.spark)


@query("I07_band_forest", "channelId:s predicted_band:s")
def _(t):
    prepared = _prepared(t)
    forest = ql.fit_supervised(prepared, names=("random_forest",)).models["random_forest"]
    bands = F.array(*[F.lit(b) for b in ql.BANDS])
    return forest.transform(prepared).select("channelId", F.get(bands, F.col("prediction").cast("int")).alias("predicted_band"))


def _graph_input(t):
    labelled = ql.derived_features(ql.quality_labels(t.stored("metrics", lambda: metrics(t)), label_fraction=0.6))
    scaled = ql.robust_scale(labelled, ql.FEATURES)
    return scaled.select(
        F.col("channelId").alias("id"), F.array(*ql.FEATURES).alias("vec"), ql.score_class(F.col("original_label")).alias("label")
    )


@query("I08_label_propagation", "channelId:s label:i")
def _(t):
    from ..operators.propagation import propagate
    from ..session import settle

    return propagate(settle(_graph_input(t)), "propagation").withColumnRenamed("id", "channelId")


@query("I09_label_spreading", "channelId:s label:i")
def _(t):
    from ..operators.propagation import propagate
    from ..session import settle

    return propagate(settle(_graph_input(t)), "spreading").withColumnRenamed("id", "channelId")


@query("I10_class_scores", "channelId:s score_class:i class_score:f", """SELECT channelId, score_class, CASE score_class WHEN 1 THEN 1.25 WHEN 2 THEN 3.75 WHEN 3 THEN 6.25 WHEN 4 THEN 8.75 ELSE 5.0 END AS class_score FROM
    (SELECT channelId, CASE WHEN quality_score <= 2.5 THEN 1 WHEN quality_score <= 5 THEN 2 WHEN quality_score <= 7.5 THEN 3 ELSE 4 END AS score_class FROM scores)""")
def _(t):
    labelled = ql.quality_labels(metrics(t)).withColumn("score_class", ql.score_class(F.col("original_label")))
    return labelled.withColumn("class_score", ql.class_score(F.col("score_class")))


@query("I11_ensemble", "channelId:s ensemble:f", """SELECT channelId, (0.4 * least(greatest(quality_score, 1), 10) + 0.4 * least(greatest(quality_score * 1.2, 1), 10)
    + 0.3 * least(greatest(quality_score - 2, 1), 10)) / 1.1 AS ensemble FROM scores""")
def _(t):
    s = F.col("quality_score")
    return scores(t).select("channelId", ql.ensemble({"gbt_a": s, "gbt_b": s * 1.2, "label_propagation": s - 2}).alias("ensemble"))


@query("I12_scored_channels", "channelId:s quality_score:f original_label:f volume:i bot_rate:f quality_category:s high_risk:b")
def _(t):
    table, _ = ql.score_channels(t.stored("metrics", lambda: metrics(t)), scorer=_scorer(t))
    return table.orderBy(F.desc("quality_score"), "channelId")


@query("I13_category_and_risk", "channelId:s quality_category:s high_risk:b", "SELECT channelId, quality_category, high_risk FROM scores")
def _(t):
    return scores(t)


@query("I14_feature_importance", "model:s feature:s importance:f")
def _(t):
    return _scorer(t).importance(t.spark)


_CLOSED = "channelId:s quality_score:f traffic_volume:i bot_ratio:f high_risk_ip_ratio:f datacenter_ratio:f anonymization_ratio:f temporal_anomaly_score:f"


@query("I15_closed_form_quality", _CLOSED, "SELECT * FROM closed")
def _(t):
    return ch.closed_form_quality(t.rows)


@query("I16_light_quality", "channelId:s quality_score:f traffic_volume:i bot_ratio:f high_risk_ratio:f datacenter_ratio:f", """SELECT channelId, traffic_volume, bot_ratio,
    high_risk_ip_ratio AS high_risk_ratio, datacenter_ratio, greatest(0, 100 - (bot_ratio * 30 + high_risk_ip_ratio * 25 + datacenter_ratio * 20)) AS quality_score FROM closed""")
def _(t):
    return ch.light_quality(t.rows)


@query("I17_low_quality", "channelId:s quality_score:f", "SELECT channelId, quality_score FROM closed WHERE quality_score < 90")
def _(t):
    return ch.low_quality(ch.closed_form_quality(t.rows), 90.0)


_RISK = """least(greatest(0.4 * (10 - q) / 10 + 0.3 * least(a / 5.0, 1) + 0.15 * isLikelyBot::INT + 0.15 * least(0.5 * isIpDatacenter::INT + 0.3 * isIpAnonymous::INT
    + 0.4 * (ipClassification IN ('suspicious', 'malicious'))::INT, 1), 0), 1)"""
_JUDGED = f"""SELECT *, array_to_string(list_filter(CASE WHEN len(found) = 0 AND classification = 'good_account' THEN ['clean_pattern'] ELSE found END, lambda x: x IS NOT NULL), ', ') AS reason_codes FROM
   (SELECT *, list_filter([reason, CASE WHEN temporal_anomaly THEN 'temporal_anomaly' END, CASE WHEN geographic_anomaly THEN 'geographic_anomaly' END,
     CASE WHEN device_anomaly THEN 'device_anomaly' END, CASE WHEN behavioral_anomaly THEN 'behavioral_anomaly' END, CASE WHEN volume_anomaly THEN 'volume_anomaly' END,
     CASE WHEN ipClassification IN ('suspicious', 'malicious') THEN 'suspicious_ip_pattern' END], lambda x: x IS NOT NULL) AS found FROM
    (SELECT *, q AS quality_score, a AS overall_anomaly_count, CASE rule WHEN 1 THEN 'good_account' WHEN 9 THEN 'good_account' ELSE 'fraud' END AS classification,
      CASE rule WHEN 1 THEN 0.8 WHEN 2 THEN 0.9 WHEN 3 THEN 0.8 WHEN 4 THEN 0.7 WHEN 5 THEN 0.6 WHEN 6 THEN least(0.5 + risk_score * 0.4, 0.9) WHEN 7 THEN 0.6 WHEN 8 THEN 0.7 ELSE 0.5 END AS confidence,
      CASE rule WHEN 1 THEN 'clean_pattern' WHEN 2 THEN 'multiple_indicators' WHEN 3 THEN 'high_bot_activity' WHEN 4 THEN 'datacenter_ip' WHEN 5 THEN 'anonymous_ip'
        WHEN 7 THEN 'low_quality_score' WHEN 8 THEN 'multiple_indicators' END AS reason FROM
     (SELECT *, CASE WHEN q >= 7 AND a <= 1 THEN 1 WHEN q <= 3 AND a >= 3 THEN 2 WHEN isLikelyBot THEN 3 WHEN isIpDatacenter THEN 4 WHEN isIpAnonymous THEN 5 WHEN risk_score >= 0.5 THEN 6
        WHEN q <= 3 THEN 7 WHEN a >= 3 THEN 8 ELSE 9 END AS rule FROM
      (SELECT *, {_RISK} AS risk_score FROM (SELECT hits.*, coalesce(s.quality_score, 5.0) AS q, coalesce(f.overall_anomaly_count, 0) AS a, coalesce(f.temporal_anomaly, false) AS temporal_anomaly,
        coalesce(f.geographic_anomaly, false) AS geographic_anomaly, coalesce(f.device_anomaly, false) AS device_anomaly, coalesce(f.behavioral_anomaly, false) AS behavioral_anomaly,
        coalesce(f.volume_anomaly, false) AS volume_anomaly FROM hits LEFT JOIN scores s USING (channelId) LEFT JOIN flags f USING (channelId)))))) """


def classified(t):
    return cf.classify(t.clean, scores(t), flags(t))


@query("L01_classified_rows", "eventId:i channelId:s keyword:s ip:s userAgent:s platform:s location:s classification:s quality_score:f risk_score:f confidence:f reason_codes:s "
       "temporal_anomaly:b geographic_anomaly:b device_anomaly:b behavioral_anomaly:b volume_anomaly:b overall_anomaly_count:i", _JUDGED)
def _(t):
    return classified(t)


@query("L02_risk_score", "eventId:i risk_score:f", _JUDGED)
def _(t):
    return classified(t)


@query("L03_rules", "eventId:i classification:s confidence:f", _JUDGED)
def _(t):
    return classified(t)


@query("L04_reason_codes", "eventId:i reason_codes:s", _JUDGED)
def _(t):
    return classified(t)


@query("F11_classification_join", "eventId:i quality_score:f overall_anomaly_count:i temporal_anomaly:b", _JUDGED)
def _(t):
    return cf.with_scores(t.clean, scores(t), flags(t))


@query("L07_defaults", "eventId:i quality_score:f overall_anomaly_count:i classification:s", """SELECT eventId, coalesce(quality_score, 5.0) AS quality_score, 0 AS overall_anomaly_count,
    CASE WHEN quality_score >= 7 THEN 'good_account' WHEN isLikelyBot OR isIpDatacenter OR isIpAnonymous THEN 'fraud' ELSE 'good_account' END AS classification
    FROM hits LEFT JOIN (SELECT * FROM scores WHERE quality_score >= 7) USING (channelId)""")
def _(t):
    good = scores(t).where("quality_score >= 7")
    return cf.classify(t.clean, good, flags(t).limit(0))


@query("L08_classification_summary", "total_rows:i fraud_rows:i fraud_pct:f avg_quality_score:f avg_risk_score:f", f"""SELECT count(*) AS total_rows,
    count(*) FILTER (WHERE classification = 'fraud') AS fraud_rows, 100.0 * count(*) FILTER (WHERE classification = 'fraud') / count(*) AS fraud_pct,
    avg(quality_score) AS avg_quality_score, avg(risk_score) AS avg_risk_score FROM ({_JUDGED})""")
def _(t):
    return cf.classification_summary(classified(t))


_LEVEL = """SELECT *, CASE WHEN p >= 5 THEN 'HIGH' WHEN p >= 3 THEN 'MEDIUM' WHEN p >= 1 THEN 'LOW' ELSE 'MINIMAL' END AS risk_level, a AS anomaly_score, a >= 2 AS is_anomalous FROM
    (SELECT s.*, a, CASE WHEN quality_score <= 3 THEN 3 WHEN quality_score <= 5 THEN 2 WHEN quality_score <= 7 THEN 1 ELSE 0 END + CASE WHEN high_risk THEN 2 ELSE 0 END
      + CASE WHEN a >= 3 THEN 3 WHEN a >= 2 THEN 2 WHEN a >= 1 THEN 1 ELSE 0 END AS p FROM
      (SELECT scores.*, coalesce(overall_anomaly_count, 0) AS a FROM scores LEFT JOIN flags USING (channelId)) s)"""


@query("L09_risk_level", "channelId:s risk_level:s", _LEVEL)
def _(t):
    joined = scores(t).join(flags(t), "channelId", "left")
    count = F.coalesce("overall_anomaly_count", F.lit(0))
    return joined.select("channelId", cf.risk_level(F.col("quality_score"), F.col("high_risk"), count).alias("risk_level"))


@query("L10_channel_predictions", "channelId:s quality_score:f quality_category:s high_risk:b fraud_score:f anomaly_score:i is_anomalous:b risk_level:s n_similar:i",
       f"SELECT *, fraud_score_avg AS fraud_score, 5 AS n_similar FROM ({_LEVEL})")
def _(t):
    from ..operators.similarity import to_points
    from ..session import settle

    points = to_points(ql.robust_scale(settle(metrics(t)), ql.METRICS), ql.METRICS)
    near = similar_channels(points, 5).groupBy(F.col("id").alias("channelId")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "neighbour", "similarity"))).alias("similar_channels")
    )
    records = cf.channel_predictions(scores(t), flags(t), near)
    return records.withColumn("n_similar", F.size("similar_channels"))


@query("F12_report_join", "channelId:s quality_score:f overall_anomaly_count:i", "SELECT channelId, quality_score, coalesce(overall_anomaly_count, 0) AS overall_anomaly_count FROM scores LEFT JOIN flags USING (channelId)")
def _(t):
    from ..operators.report import with_anomaly_count

    return with_anomaly_count(scores(t), flags(t))


