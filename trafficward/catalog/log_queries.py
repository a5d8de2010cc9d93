"""Scans, cleaning, profiling and row features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import address, agent, calendar, text
from ..functions.fraud import bot_flag
from ..operators import clean as cl
from ..operators.quality import derived_features
from ..schema import IP_FLAGS, TRAFFIC
from ..session import new_folder
from ..sources import sinks, traffic as src
from .base import Tables, entropy, hash01, query, words

_LOG = "eventId:i at:s channelId:s country:s ip:s referrer:s isLikelyBot:b isIpVPN:b browserMajorVersion:i platform:s location:s userAgent:s"
_LOG_SQL = """SELECT *, strftime(date, '%Y-%m-%d %H:%M:%S') AS at FROM traffic"""


def _stamped(df):
    return df.withColumn("at", F.date_format("date", "yyyy-MM-dd HH:mm:ss"))


def _as_csv(t: Tables, strict_time: bool) -> str:
    """The log written as CSV in the shared folder, to be scanned again."""
    form = "yyyy-MM-dd HH:mm:ss.SSSSSS 'UTC'" if strict_time else "yyyy-MM-dd'T'HH:mm:ss.SSS"
    path = new_folder(t.spark, "log-csv")
    rows = t.traffic.withColumn("date", F.date_format("date", form))
    rows.write.option("header", True).option("escape", '"').option("nullValue", "\\N").csv(path)
    return path


@query("A01_csv_scan", _LOG, _LOG_SQL)
def _(t):
    return _stamped(src.read_csv(t.spark, _as_csv(t, False), nullValue="\\N"))


@query("A02_strict_time_scan", "eventId:i epoch:i channelId:s", "SELECT eventId, floor(epoch(date))::BIGINT AS epoch, channelId FROM traffic")
def _(t):
    rows = src.read_csv_strict_time(t.spark, _as_csv(t, True), nullValue="\\N")
    return rows.withColumn("epoch", calendar.epoch_seconds(F.col("date")))


@query("A03_capped_scan", "n:i columns:i", "SELECT least(count(*), 500) AS n, 31 AS columns FROM traffic")
def _(t):
    rows = src.read_csv_rows(t.spark, _as_csv(t, False), 500, nullValue="\\N")
    return rows.agg(F.count("*").alias("n")).withColumn("columns", F.lit(len(rows.columns)))


@query("A04_map_chunks", "channelId:s requests:i bots:i", """SELECT channelId, count(*) AS requests,
    sum(coalesce(isLikelyBot, false)::INT) AS bots FROM traffic GROUP BY channelId""")
def _(t):
    def per_chunk(rows):
        return rows.groupby("channelId", as_index=False).agg(requests=("eventId", "count"), bots=("bot", "sum"))

    slim = t.traffic.select("eventId", "channelId", F.coalesce("isLikelyBot", F.lit(False)).cast("int").alias("bot"))
    partial = src.map_chunks(slim, per_chunk, "channelId string, requests bigint, bots bigint")
    return partial.groupBy("channelId").agg(F.sum("requests").alias("requests"), F.sum("bots").alias("bots"))


@query("A05_hashed_sample", "eventId:i channelId:s", f"SELECT eventId, channelId FROM traffic WHERE {hash01('eventId::VARCHAR')} < 0.1")
def _(t):
    return src.sample_rows(t.traffic, 0.1)


@query("A06_lenient_coercion", "eventId:i isLikelyBot:b isIpVPN:b browserMajorVersion:i epoch:i", """SELECT eventId,
    isLikelyBot, coalesce(isIpVPN, false) AS isIpVPN, CASE WHEN eventId % 3 = 0 THEN 0 ELSE browserMajorVersion END AS browserMajorVersion,
    CASE WHEN eventId % 5 <> 0 THEN floor(epoch(date))::BIGINT END AS epoch FROM traffic""")
def _(t):
    # text columns with mixed case, blanks and an unreadable time, as lenient inputs have them
    texts = t.traffic.select(
        "eventId",
        *[F.initcap(F.col(c).cast("string")).alias(c) for c in ["isLikelyBot", *IP_FLAGS]],
        F.when(F.col("eventId") % 3 == 0, "").otherwise(F.col("browserMajorVersion").cast("string")).alias("browserMajorVersion"),
        F.when(F.col("eventId") % 5 == 0, "yesterday").otherwise(F.date_format("date", "yyyy-MM-dd HH:mm:ss.SSSSSS 'UTC'")).alias("date"),
    )
    return src.coerce_text(texts).withColumn("epoch", F.unix_seconds("date"))


@query("A07_partitioned_table", "dt:s channelId:s requests:i bots:i", """SELECT strftime(date, '%Y-%m-%d') AS dt, channelId,
    count(*) AS requests, sum(coalesce(isLikelyBot, false)::INT) AS bots FROM traffic GROUP BY ALL""")
def _(t):
    path = new_folder(t.spark, "traffic-table")
    sinks.write_table(t.traffic, path)
    stored = t.spark.read.parquet(path)
    return stored.groupBy(F.col("dt").cast("string").alias("dt"), "channelId").agg(
        F.count("*").alias("requests"), F.count_if(F.coalesce("isLikelyBot", F.lit(False))).alias("bots")
    )


@query("A08_csv_sink", "channelId:s quality_score:f volume:i", "SELECT channelId, quality_score, volume FROM scores")
def _(t):
    from ..operators.channels import quality_metrics
    from ..operators.quality import rule_scores

    path = new_folder(t.spark, "scores-csv")
    sinks.write_csv(rule_scores(quality_metrics(t.rows)), path)
    return sinks.read_or_empty(
        t.spark, path, "channelId string, quality_score double, original_label double, volume bigint, bot_rate double, "
        "fraud_score_avg double, ip_diversity bigint, country_diversity bigint, quality_category string, high_risk boolean",
    )


@query("B01_distinct_rows", "channelId:s n:i", """SELECT channelId, count(*) AS n FROM
    (SELECT DISTINCT * EXCLUDE (eventId) FROM (SELECT * FROM traffic UNION ALL SELECT * FROM traffic)) GROUP BY channelId""")
def _(t):
    doubled = t.traffic.unionByName(t.traffic)
    return cl.drop_duplicates(doubled).groupBy("channelId").agg(F.count("*").alias("n"))


@query("B02_fill_flags", "eventId:i isIpVPN:b isLikelyBot:b", "SELECT eventId, coalesce(isIpVPN, false) AS isIpVPN, isLikelyBot FROM traffic")
def _(t):
    return cl.fill_flags(t.traffic)


@query("B03_fill_zero", "eventId:i country:s isIpVPN:b browserMajorVersion:i", """SELECT eventId, coalesce(country, '0') AS country,
    coalesce(isIpVPN, false) AS isIpVPN, coalesce(browserMajorVersion, 0) AS browserMajorVersion FROM traffic""")
def _(t):
    return cl.fill_zero(t.traffic)


@query("B04_drop_bad_ips", "eventId:i ip:s", "SELECT eventId, ip FROM clean")
def _(t):
    return cl.drop_bad_ips(t.traffic)


@query("B05_summary", "total_records:i date_start:s date_end:s channels:i publishers:i advertisers:i countries:i ips:i users:i "
       "likely_bots:i datacenter_ips:i anonymous_ips:i vpn_ips:i tor_ips:i", """SELECT count(*) AS total_records,
    strftime(min(date), '%Y-%m-%d %H:%M:%S') AS date_start, strftime(max(date), '%Y-%m-%d %H:%M:%S') AS date_end,
    count(DISTINCT channelId) AS channels, count(DISTINCT publisherId) AS publishers, count(DISTINCT advertiserId) AS advertisers,
    count(DISTINCT country) AS countries, count(DISTINCT ip) AS ips, count(DISTINCT userId) AS users,
    sum(isLikelyBot::INT) AS likely_bots, sum(isIpDatacenter::INT) AS datacenter_ips, sum(isIpAnonymous::INT) AS anonymous_ips,
    sum(isIpVPN::INT) AS vpn_ips, sum(isIpTOR::INT) AS tor_ips FROM clean""")
def _(t):
    return cl.summary(t.clean)


@query("B05_top_values", "field:s value:s n:i", """(SELECT 'country' AS field, country AS value, count(*) AS n FROM clean WHERE country IS NOT NULL
    GROUP BY country ORDER BY n DESC, value LIMIT 10) UNION ALL (SELECT 'browser', browser, count(*) AS n FROM clean WHERE browser IS NOT NULL
    GROUP BY browser ORDER BY n DESC, browser LIMIT 5) UNION ALL (SELECT 'device', device, count(*) FROM clean WHERE device IS NOT NULL GROUP BY device)""")
def _(t):
    return cl.top_values(t.clean)


@query("B06_missing_values", "column:s missing:i", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing FROM traffic"
    for c in [f.name for f in TRAFFIC]))
def _(t):
    return cl.missing_values(t.traffic.select([f.name for f in TRAFFIC]))


@query("B07_duplicate_count", "duplicate_rows:i", """SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (eventId) FROM traffic)) AS duplicate_rows
    FROM (SELECT * FROM traffic UNION ALL SELECT * FROM traffic WHERE isIpVPN)
    """)
def _(t):
    # the log with its VPN rows logged twice
    return cl.duplicate_count(t.traffic.unionByName(t.traffic.where("isIpVPN")))


@query("B08_invalid_dates", "invalid_dates:i", "SELECT count(*) FILTER (WHERE eventId % 5 = 0) AS invalid_dates FROM traffic")
def _(t):
    text_dates = t.traffic.select(
        F.when(F.col("eventId") % 5 == 0, "not a date").otherwise(F.col("date").cast("string")).alias("date")
    )
    return cl.invalid_dates(text_dates)


@query("B09_heavy_hitters", "pattern:s n:i", """SELECT 'high_volume_ips' AS pattern, count(*) FILTER (WHERE c > 1000) AS n FROM
    (SELECT count(*) AS c FROM clean GROUP BY ip) UNION ALL SELECT 'high_volume_users', count(*) FILTER (WHERE c > 100) FROM
    (SELECT count(*) AS c FROM clean GROUP BY userId)""")
def _(t):
    return cl.heavy_hitters(t.clean)


@query("B11_risk_summary", "total_records:i high_risk_ips:i bot_traffic:i high_risk_ratio:f bot_ratio:f", """SELECT count(*) AS total_records,
    sum(is_high_risk_ip::INT) AS high_risk_ips, sum(isLikelyBot::INT) AS bot_traffic, avg(is_high_risk_ip::INT) AS high_risk_ratio,
    avg(isLikelyBot::INT) AS bot_ratio FROM hits""")
def _(t):
    return cl.risk_summary(t.rows)


@query("B11_hourly_distribution", "hour:i n:i", "SELECT hour, count(*) AS n FROM hits GROUP BY hour")
def _(t):
    return cl.hourly_distribution(t.rows)


@query("B12_varying_columns", "column:s", """SELECT "column" FROM (UNPIVOT (SELECT var_samp(bot_rate) AS bot_rate, var_samp(fraud_flags_avg) AS fraud_flags_avg,
    var_samp(ip_diversity) AS ip_diversity, var_samp(browser_diversity) AS browser_diversity, var_samp(volume) AS volume,
    var_samp(commercial_intent_rate) AS commercial_intent_rate FROM metrics) ON COLUMNS(*) INTO NAME "column" VALUE v) WHERE v > 0.01""")
def _(t):
    from ..operators.channels import quality_metrics

    table = quality_metrics(t.rows).select(
        "channelId", "bot_rate", "fraud_flags_avg", "ip_diversity", "browser_diversity", "volume", "commercial_intent_rate"
    )
    kept = set(cl.varying_columns(table, "channelId", 0.01))
    names = [c for c in table.columns if c in kept]
    shape = table.agg(*[F.var_samp(c).alias(c) for c in names])
    return shape.unpivot([], names, "column", "v").select("column")


@query("C01_calendar_parts", "eventId:i hour:i day_of_week:i day_of_month:i month:i quarter:i year:i",
       "SELECT * FROM calendar")
def _(t):
    return t.clean.withColumns(calendar.parts(F.col("date")))


@query("C02_periods", "eventId:i is_weekend:i is_night:i is_business_hours:i is_peak_hour:i is_office_hour_any_day:i",
       "SELECT *, is_business_hours AS is_peak_hour, (hour BETWEEN 9 AND 17)::INT AS is_office_hour_any_day FROM feat")
def _(t):
    return t.rows


@query("C03_epoch_seconds", "eventId:i timestamp:i", "SELECT * FROM calendar")
def _(t):
    return t.rows


@query("C04_cycles", "eventId:i sin_hour:f cos_hour:f sin_day_of_week:f cos_day_of_week:f", """SELECT eventId, sin(2 * pi() * hour / 24) AS sin_hour,
    cos(2 * pi() * hour / 24) AS cos_hour, sin(2 * pi() * day_of_week / 7) AS sin_day_of_week, cos(2 * pi() * day_of_week / 7) AS cos_day_of_week FROM calendar""")
def _(t):
    return t.rows


@query("C05_time_segment", "eventId:i time_segment:s", "SELECT * FROM feat")
def _(t):
    return t.rows


_V4 = "regexp_matches(ip, '^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$')"


@query("C06_ip_type", "eventId:i ip_type:s", f"""SELECT eventId, CASE WHEN {_V4} THEN 'ipv4'
    WHEN regexp_matches(ip, '^[0-9a-f]{{1,4}}(:[0-9a-f]{{1,4}})*::[0-9a-f]{{1,4}}$') THEN 'ipv6' ELSE 'invalid' END AS ip_type FROM clean""")
def _(t):
    return t.clean.withColumn("ip_type", address.ip_type(F.col("ip")))


@query("C07_ip_family", "eventId:i ip_family:s", """SELECT eventId, CASE WHEN contains(ip, ':') THEN 'ipv6' WHEN contains(ip, '.') THEN 'ipv4'
    ELSE 'unknown' END AS ip_family FROM traffic""")
def _(t):
    return t.traffic.withColumn("ip_family", address.ip_type_loose(F.col("ip")))


@query("C08_network_class", "eventId:i ip_network_class:s", f"""SELECT eventId, CASE WHEN NOT {_V4} THEN 'Unknown' WHEN o <= 127 THEN 'A'
    WHEN o <= 191 THEN 'B' WHEN o <= 223 THEN 'C' ELSE 'Other' END AS ip_network_class FROM
    (SELECT *, try_cast(split_part(ip, '.', 1) AS INT) AS o FROM clean)""")
def _(t):
    return t.rows


@query("C09_private_ip", "eventId:i is_private_ip:i", f"""SELECT eventId, CASE WHEN contains(ip, ':') THEN 1 WHEN NOT {_V4} THEN 0
    WHEN o[1] IN (0, 10, 127) OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR (o[1] = 192 AND o[2] = 168) OR (o[1] = 169 AND o[2] = 254)
      OR (o[1] = 198 AND o[2] IN (18, 19)) OR (o[1] = 198 AND o[2] = 51 AND o[3] = 100) OR (o[1] = 203 AND o[2] = 0 AND o[3] = 113)
      OR (o[1] = 192 AND o[2] = 0 AND o[3] IN (0, 2)) OR o[1] >= 240 THEN 1 ELSE 0 END AS is_private_ip FROM
    (SELECT *, [try_cast(x AS INT) FOR x IN string_split(ip, '.')] AS o FROM clean)""")
def _(t):
    return t.rows


@query("C10_entropy", "eventId:i ip_entropy:f ua_entropy:f", "SELECT * FROM feat")
def _(t):
    return t.rows


@query("C10_document_entropy", "doc_id:s entropy:f", f"SELECT doc_id, {entropy('text')} AS entropy FROM documents")
def _(t):
    return t.read("documents").select("doc_id", text.entropy(F.col("text")).alias("entropy"))


@query("C11_ip_flag_totals", "eventId:i total_ip_flags:i ip_risk_score:f", "SELECT *, total_ip_flags / 8.0 AS ip_risk_score FROM feat")
def _(t):
    return t.rows


@query("C12_ip_risk_points", "eventId:i ip_risk_points:i is_high_risk_ip:b", "SELECT * FROM feat")
def _(t):
    return t.rows


@query("C13_agent_size", "eventId:i ua_length:i ua_word_count:i", "SELECT * FROM feat")
def _(t):
    return t.rows


@query("C14_version_match", "eventId:i browser_version_match:i", "SELECT * FROM feat")
def _(t):
    return t.rows


@query("C15_bot_tokens", "eventId:i ua_bot_indicators:i", "SELECT * FROM feat")
def _(t):
    return t.rows


@query("C16_agent_suspicion", "eventId:i ua_has_version:i ua_suspicious:i", "SELECT * FROM feat")
def _(t):
    return t.rows


@query("C17_referrer_domain", "eventId:i referrer_domain:s", "SELECT * FROM feat")
def _(t):
    return t.rows


@query("C17_page_domain", "page_id:s domain:s", """SELECT page_id, CASE WHEN url IS NULL OR url = '' THEN 'unknown' ELSE regexp_replace(
    lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)), '^www\\.', '') END AS domain FROM pages""")
def _(t):
    return t.read("pages").select("page_id", text.domain(F.col("url")).alias("domain"))


@query("C18_referrer_kind", "eventId:i referrer_is_social:i referrer_is_search:i referrer_is_ad_network:i", """SELECT eventId, referrer_is_ad_network,
    (referrer_domain IN ('facebook.com', 'twitter.com', 'instagram.com', 'linkedin.com', 'tiktok.com', 'youtube.com', 'pinterest.com'))::INT AS referrer_is_social,
    (referrer_domain IN ('google.com', 'bing.com', 'yahoo.com', 'duckduckgo.com'))::INT AS referrer_is_search FROM hits""")
def _(t):
    return t.rows


@query("C19_keyword", "eventId:i keyword_length:i keyword_word_count:i keyword_has_brand:i keyword_commercial_intent:i", "SELECT * FROM feat")
def _(t):
    return t.rows


@query("C20_combo", "eventId:i device_browser_combo:s", "SELECT * FROM feat")
def _(t):
    return t.rows


@query("C21_fraud_scores", "eventId:i total_fraud_flags:i weighted_fraud_score:f", "SELECT * FROM feat")
def _(t):
    return t.rows


@query("C22_platform_json", "eventId:i cpu_architecture:s engine_name:s engine_version:s os_name:s os_version:s", """SELECT eventId,
    j->>'$.cpu.architecture' AS cpu_architecture, j->>'$.engine.name' AS engine_name, j->>'$.engine.version' AS engine_version,
    j->>'$.os.name' AS os_name, j->>'$.os.version' AS os_version FROM
    (SELECT eventId, CASE WHEN json_valid(platform) THEN platform::JSON END AS j FROM traffic)""")
def _(t):
    return text.add_platform(t.traffic)


@query("C23_location_json", "eventId:i city_name:s country_code:s timezone:s timezone_offset:i", """SELECT eventId, j->>'$.cityName' AS city_name,
    j->>'$.countryCode' AS country_code, j->>'$.timezone' AS timezone, try_cast(j->>'$.timezoneOffset' AS SMALLINT) AS timezone_offset FROM
    (SELECT eventId, CASE WHEN json_valid(location) THEN location::JSON END AS j FROM traffic)""")
def _(t):
    return text.add_location(t.traffic)


@query("C24_parsed_agent", "eventId:i ua_browser_family:s ua_browser_version:s ua_os_family:s ua_os_version:s ua_device_family:s ua_device_brand:s "
       "ua_is_mobile:b ua_is_tablet:b ua_is_pc:b ua_is_bot:b", """SELECT eventId,
    CASE WHEN userAgent = 'curl' THEN 'curl' WHEN userAgent LIKE 'python%' THEN 'Python Requests' WHEN userAgent LIKE '%Chrome%' THEN 'Chrome' END AS ua_browser_family,
    nullif(CASE WHEN userAgent LIKE 'python%' THEN regexp_extract(userAgent, 'requests/([0-9.]+)', 1) WHEN userAgent LIKE '%Chrome%' THEN regexp_extract(userAgent, 'Chrome/([0-9.]+)', 1) END, '') AS ua_browser_version,
    CASE WHEN userAgent = 'curl' THEN 'Other' WHEN userAgent LIKE 'python%' THEN 'Linux' WHEN userAgent LIKE '%Windows NT%' THEN 'Windows' END AS ua_os_family,
    CASE WHEN userAgent LIKE '%Windows NT%' THEN '10.0' END AS ua_os_version,
    CASE WHEN userAgent IS NOT NULL THEN 'Other' END AS ua_device_family, NULL AS ua_device_brand,
    false AS ua_is_mobile, false AS ua_is_tablet, coalesce(userAgent LIKE '%Windows NT%', false) AS ua_is_pc, false AS ua_is_bot FROM traffic""")
def _(t):
    return agent.add_parsed_agent(t.traffic)


@query("C26_bot_flag", "eventId:i bot:b", "SELECT eventId, coalesce(isLikelyBot, false) OR (eventId % 7 = 0) AS bot FROM traffic")
def _(t):
    both = t.traffic.withColumn("isBot", F.col("eventId") % 7 == 0)
    return both.withColumn("bot", bot_flag(both))


@query("C27_derived_features", "channelId:s requests_per_ip:f combined_fraud_risk:f log_volume:f", """SELECT channelId,
    volume / (ip_diversity + 1) AS requests_per_ip, bot_rate * 0.6 + fraud_score_avg * 0.4 AS combined_fraud_risk, ln(1 + volume) AS log_volume FROM metrics""")
def _(t):
    from ..operators.channels import quality_metrics

    return derived_features(quality_metrics(t.rows))


@query("C13_document_words", "doc_id:s words:i", f"SELECT doc_id, {words('text')} AS words FROM documents")
def _(t):
    return t.read("documents").select("doc_id", text.words(F.col("text")).alias("words"))
