"""Entity features, windows, ordering and buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import channels as ch, entity as en, quality as ql, ranks, sequence as sq, tables as tb
from ..operators.anomaly import top_entities
from ..schema import ENTITIES
from .base import hash01, query


def _scores(t):
    return ql.rule_scores(ch.quality_metrics(t.rows))


_E = ENTITIES


@query("D01_daily_requests", "eventId:i " + " ".join(f"{e}_daily_requests:i" for e in _E),
       "SELECT eventId, " + ", ".join(f"count(date) OVER (PARTITION BY {e}, date::DATE) AS {e}_daily_requests" for e in _E) + " FROM hits")
def _(t):
    return en.add_entity_activity(t.clean, measures=("daily",))


@query("D02_hourly_requests", "eventId:i " + " ".join(f"{e}_hourly_requests:i" for e in _E),
       "SELECT eventId, " + ", ".join(f"count(date) OVER (PARTITION BY {e}, date_trunc('hour', date)) AS {e}_hourly_requests" for e in _E) + " FROM hits")
def _(t):
    return en.add_entity_activity(t.clean, measures=("hourly",))


@query("D03_country_diversity", "eventId:i " + " ".join(f"{e}_country_diversity:i" for e in _E),
       "SELECT eventId, " + ", ".join(f"count(DISTINCT country) OVER (PARTITION BY {e}) AS {e}_country_diversity" for e in _E) + " FROM hits")
def _(t):
    return en.add_entity_activity(t.clean, measures=("countries",))


@query("D04_hour_deviation", "eventId:i " + " ".join(f"{e}_hour_std:f" for e in _E),
       "SELECT eventId, " + ", ".join(f"coalesce(stddev_samp(hour) OVER (PARTITION BY {e}), 0) AS {e}_hour_std" for e in _E) + " FROM hits")
def _(t):
    return en.add_entity_activity(t.clean, measures=("hours",))


_D05 = """SELECT channelId, round_even(avg(isLikelyBot::INT), 4) AS channel_isLikelyBot_mean, count(isLikelyBot) AS channel_isLikelyBot_count,
    count(DISTINCT country) AS channel_country_nunique, count(DISTINCT browser) AS channel_browser_nunique, count(DISTINCT device) AS channel_device_nunique,
    round_even(stddev_samp(hour), 4) AS channel_hour_std FROM hits GROUP BY channelId"""


@query("D05_channel_stats", "eventId:i channel_isLikelyBot_mean:f channel_isLikelyBot_count:i channel_country_nunique:i channel_browser_nunique:i "
       "channel_device_nunique:i channel_hour_std:f", f"SELECT * FROM hits LEFT JOIN ({_D05}) USING (channelId)")
def _(t):
    return en.attach(t.rows, en.channel_stats(t.rows), "channelId")


@query("D06_combo_popularity", "eventId:i device_browser_popularity:i",
       "SELECT eventId, count(*) OVER (PARTITION BY device_browser_combo) AS device_browser_popularity FROM hits")
def _(t):
    return en.attach(t.rows, en.combo_popularity(t.rows), "device_browser_combo")


@query("D07_gaps_and_velocity", "eventId:i ip_time_gap:i ip_request_velocity:f userId_time_gap:i userId_request_velocity:f", """SELECT eventId,
    ip_time_gap, 1.0 / (ip_time_gap + 1) AS ip_request_velocity, userId_time_gap, 1.0 / (userId_time_gap + 1) AS userId_request_velocity FROM (SELECT eventId,
    coalesce("timestamp" - lag("timestamp") OVER (PARTITION BY ip ORDER BY date, eventId), 0) AS ip_time_gap,
    coalesce("timestamp" - lag("timestamp") OVER (PARTITION BY userId ORDER BY date, eventId), 0) AS userId_time_gap FROM hits)""")
def _(t):
    return sq.add_gaps(sq.add_gaps(t.clean.select("eventId", "date", "ip", "userId"), "ip"), "userId")


@query("D08_ip_burst", "eventId:i ip_burst_5min:i", """SELECT eventId, coalesce(sum(gap) OVER (PARTITION BY ip ORDER BY date, eventId ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) < 300, false)::INT
    AS ip_burst_5min FROM (SELECT *, epoch(date) - lag(epoch(date)) OVER (PARTITION BY ip ORDER BY date, eventId) AS gap FROM hits)""")
def _(t):
    return sq.add_gaps(t.clean.select("eventId", "date", "ip"), "ip", burst="ip_burst_5min")


@query("D09_country_switches", "eventId:i ip_country_switches:i", "SELECT eventId, countries - 1 AS ip_country_switches FROM hits JOIN ip_stats USING (ip)")
def _(t):
    return en.attach(t.clean, en.ip_countries(t.clean), "ip")


@query("D10_ip_usage", "eventId:i ip_frequency:i channel_ip_diversity:f", """SELECT eventId, count(*) OVER (PARTITION BY ip) AS ip_frequency,
    count(DISTINCT ip) OVER (PARTITION BY channelId) / count(*) OVER (PARTITION BY channelId) AS channel_ip_diversity FROM hits""")
def _(t):
    return en.add_ip_usage(t.clean)


@query("D11_channel_bot_rate", "eventId:i is_bot:i channel_bot_rate:f",
       "SELECT eventId, isLikelyBot::INT AS is_bot, avg(isLikelyBot::INT) OVER (PARTITION BY channelId) AS channel_bot_rate FROM hits")
def _(t):
    return en.add_bot_rate(t.clean)


@query("D12_volume_percentile", "eventId:i channel_volume:i volume_percentile:f", """SELECT eventId, channel_volume,
    (rank() OVER (ORDER BY channel_volume) + (count(*) OVER (PARTITION BY channel_volume) - 1) / 2.0) / count(*) OVER () AS volume_percentile FROM
    (SELECT eventId, count(*) OVER (PARTITION BY channelId) AS channel_volume FROM hits)""")
def _(t):
    return en.add_volume(t.clean)


@query("D12_volume_decile", "eventId:i volume_percentile:i", """SELECT eventId, len(list_filter(e[2:len(e) - 1], lambda x: x < channel_volume)) AS volume_percentile FROM
    (SELECT eventId, count(*) OVER (PARTITION BY channelId) AS channel_volume FROM hits),
    (SELECT list_sort(list_distinct(quantile_cont(channel_volume, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM
      (SELECT count(*) OVER (PARTITION BY channelId) AS channel_volume FROM hits))""")
def _(t):
    return en.add_volume(t.clean, approximate=True)


@query("D13_global_stats", "eventId:i fraud_score_mean:f fraud_score_std:f",
       "SELECT eventId, (SELECT avg(weighted_fraud_score) FROM hits) AS fraud_score_mean, (SELECT stddev_samp(weighted_fraud_score) FROM hits) AS fraud_score_std FROM hits")
def _(t):
    return en.add_global_stats(t.rows, "weighted_fraud_score", "fraud_score")


@query("D13_sampled_stats", "eventId:i fraud_score_mean:f fraud_score_std:f", f"""SELECT eventId, m AS fraud_score_mean, s AS fraud_score_std FROM hits,
    (SELECT avg(w) AS m, stddev_samp(w) AS s FROM (SELECT weighted_fraud_score AS w FROM hits ORDER BY {hash01('eventId::VARCHAR')}, eventId LIMIT 1000))""")
def _(t):
    return en.add_global_stats(t.rows, "weighted_fraud_score", "fraud_score", sample=1000)


@query("D14_column_stats", "column:s mean:f std:f median:f", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", avg({c}) AS mean, stddev_pop({c}) AS std, median({c}) AS median FROM hits"
    for c in ["weighted_fraud_score", "ip_entropy", "browserMajorVersion"]))
def _(t):
    return en.column_stats(t.rows, ["weighted_fraud_score", "ip_entropy", "browserMajorVersion"])


@query("G01_ordered_gap", "entity:s n:i total:f largest:f", """SELECT channelId AS entity, count(gap) AS n, sum(gap) AS total, max(gap) AS largest FROM
    (SELECT channelId, epoch(date) - lag(epoch(date)) OVER (PARTITION BY channelId ORDER BY date, eventId) AS gap FROM hits) WHERE gap IS NOT NULL GROUP BY channelId""")
def _(t):
    found = sq.gaps(t.clean, "channelId")
    return found.groupBy(F.col("channelId").alias("entity")).agg(
        F.count("gap").alias("n"), F.sum("gap").alias("total"), F.max("gap").alias("largest")
    )


def _rolling_sql(minimum: int) -> str:
    return f"""SELECT eventId, gap, CASE WHEN n >= {minimum} THEN m END AS rolling_mean, CASE WHEN n >= {minimum} THEN s END AS rolling_std FROM
    (SELECT eventId, gap, count(gap) OVER w AS n, avg(gap) OVER w AS m, stddev_samp(gap) OVER w AS s FROM
      (SELECT *, epoch(date) - lag(epoch(date)) OVER (PARTITION BY channelId ORDER BY date, eventId) AS gap FROM hits)
     WINDOW w AS (PARTITION BY channelId ORDER BY date, eventId ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"""


@query("G03_rolling_full", "eventId:i gap:f rolling_mean:f rolling_std:f", _rolling_sql(5))
def _(t):
    return sq.rolling(t.clean, "channelId", min_periods=5)


@query("G03_rolling_partial", "eventId:i gap:f rolling_mean:f rolling_std:f", _rolling_sql(1))
def _(t):
    return sq.rolling(t.clean, "channelId", min_periods=1)


@query("G05_top_and_bottom", "side:s channelId:s quality_score:f", """(SELECT 'top' AS side, channelId, quality_score FROM scores ORDER BY quality_score DESC, channelId LIMIT 20)
    UNION ALL (SELECT 'bottom', channelId, quality_score FROM scores ORDER BY quality_score, channelId LIMIT 20)""")
def _(t):
    scores = _scores(t)
    best = tb.top(scores, "quality_score", 20, "channelId").withColumn("side", F.lit("top"))
    return best.unionByName(tb.top(scores, "quality_score", 20, "channelId", lowest=True).withColumn("side", F.lit("bottom")))


@query("G06_head_of_filtered", "channelId:s quality_score:f", "SELECT channelId, quality_score FROM scores WHERE high_risk ORDER BY quality_score DESC, channelId LIMIT 50")
def _(t):
    return tb.head_where(_scores(t), F.col("high_risk"), [F.desc("quality_score"), F.col("channelId")], 50)


@query("G07_global_sort", "channelId:s quality_score:f", "SELECT channelId, quality_score FROM scores ORDER BY quality_score DESC")
def _(t):
    return _scores(t).orderBy(F.desc("quality_score"), "channelId")


@query("G08_top_entities", "eventId:i", """SELECT eventId FROM hits WHERE ip IN (SELECT ip FROM hits GROUP BY ip ORDER BY count(*) DESC, ip LIMIT 100)""")
def _(t):
    return tb.keep_keys(t.clean, top_entities(t.clean, "ip", 100), "ip")


def _qcut(q: int) -> str:
    probs = ", ".join(str(i / q) for i in range(q + 1))
    return f"""SELECT channelId, len(list_filter(e[2:len(e) - 1], lambda x: x < quality_score)) AS bucket FROM scores,
    (SELECT list_sort(list_distinct(quantile_cont(quality_score, [{probs}]))) AS e FROM scores) edges"""


@query("G09_quartiles", "channelId:s bucket:i", _qcut(4))
def _(t):
    return ranks.quantile_bins(_scores(t), "quality_score", 4, "bucket")


@query("G09_quintiles", "channelId:s bucket:i", _qcut(5))
def _(t):
    return ranks.quantile_bins(_scores(t), "quality_score", 5, "bucket")


@query("G10_fixed_bins", "channelId:s category:s score_class:i", """SELECT channelId, quality_category AS category, CASE WHEN quality_score < 0 THEN NULL
    WHEN quality_score <= 2.5 THEN 1 WHEN quality_score <= 5 THEN 2 WHEN quality_score <= 7.5 THEN 3 WHEN quality_score <= 10 THEN 4 END AS score_class FROM scores""")
def _(t):
    scores = _scores(t)
    return scores.select("channelId", ql.category(F.col("quality_score")).alias("category"), ql.score_class(F.col("quality_score")).alias("score_class"))
