"""Traffic log derived from the provided `events` table.

The expressions are plain SQL with the same meaning in Spark and in other engines, so the
SQL twins of the queries use this very text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import configure

TRAFFIC_FROM_EVENTS = {
    "date": "ts",
    "eventId": "event_id",
    "channelId": "'ch_' || user_id",
    "publisherId": "'pub_' || (user_id % 20)",
    "advertiserId": "'adv_' || (k % 15)",
    "feedId": "'feed_' || (k % 25)",
    "userId": "'u_' || ((event_id * 7) % 211)",
    "keyword": "CASE event_type WHEN 'click' THEN 'buy cheap phone' WHEN 'view' THEN 'samsung galaxy review' "
    "WHEN 'purchase' THEN 'best price deal' WHEN 'signup' THEN 'newsletter' END",
    "country": "CASE (k + user_id) % 6 WHEN 0 THEN 'US' WHEN 1 THEN 'CA' WHEN 2 THEN 'GB' WHEN 3 THEN 'DE' "
    "WHEN 4 THEN 'FR' END",
    "browser": "CASE k % 4 WHEN 0 THEN 'chrome' WHEN 1 THEN 'firefox' WHEN 2 THEN 'safari' ELSE 'edge' END",
    "device": "CASE event_id % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'notMobile' ELSE 'tablet' END",
    "browserMajorVersion": "40 + k",
    "referrer": "CASE k % 5 WHEN 0 THEN 'https://www.google.com/search?q=x' WHEN 1 THEN 'http://facebook.com/p' "
    "WHEN 2 THEN 'https://taboola.com:8080/a' WHEN 3 THEN 'direct' END",
    "ip": "CASE WHEN k = 99 THEN 'unknown' WHEN k = 98 THEN 'null' "
    "WHEN k < 4 THEN '2001:db8::' || (event_id % 5) "
    "ELSE (k * 2) || '.' || (user_id % 4) || '.' || (event_id % 3) || '.7' END",
    "isLikelyBot": "(event_type = 'error' AND k < 50) OR (user_id % 7 = 0 AND k < 60)",
    "ipClassification": "CASE WHEN k % 11 = 0 THEN 'malicious' WHEN k % 7 = 0 THEN 'suspicious' ELSE 'clean' END",
    "isIpDatacenter": "k % 10 = 0 OR (user_id % 9 = 0 AND k > 40)",
    "isIpAnonymous": "k % 13 = 0",
    "isIpCrawler": "k % 17 = 0",
    "isIpPublicProxy": "k % 19 = 0",
    "isIpVPN": "CASE WHEN k <> 50 THEN k % 23 = 0 END",
    "isIpHostingService": "k % 29 = 0",
    "isIpTOR": "k = 77",
    "isIpResidentialProxy": "k % 31 = 0",
    "datacenterName": "CASE WHEN k % 10 = 0 THEN 'dc' || (k % 3) END",
    "ipHostName": "CASE WHEN k % 3 = 0 THEN 'host' || k || '.example.com' END",
    "performance": "'p' || (k % 4)",
    "detection": "CASE k % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'suspicious' ELSE 'fraud' END",
    "platform": "CASE WHEN k = 3 THEN '{bad' WHEN k = 4 THEN NULL ELSE "
    "'{\"cpu\":{\"architecture\":\"amd64\"},\"engine\":{\"name\":\"Blink\",\"version\":\"' || k || "
    "'\"},\"os\":{\"name\":\"os' || (k % 5) || '\",\"version\":\"10\"}}' END",
    "location": "CASE WHEN k = 6 THEN '' ELSE '{\"cityName\":\"city' || (k % 40) || "
    "'\",\"countryCode\":\"US\",\"timezone\":\"tz' || (k % 8) || '\",\"timezoneOffset\":\"' || (k - 50) || '\"}' END",
    "userAgent": "CASE WHEN user_id % 11 = 0 THEN 'curl' WHEN k % 9 = 0 THEN 'python-requests/2.31 (linux)' "
    "WHEN k = 8 THEN NULL ELSE 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/' || "
    "(40 + k) || '.0 Safari/537.36' END",
}


def events_as_traffic(events: DataFrame) -> DataFrame:
    """The 30 log columns and the row id from event rows."""
    numbered = events.selectExpr("*", "CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k")
    return numbered.selectExpr(*[f"{expr} AS `{name}`" for name, expr in TRAFFIC_FROM_EVENTS.items()])


def load_traffic(spark: SparkSession, folder: str) -> DataFrame:
    configure(spark)
    return events_as_traffic(spark.read.parquet(f"{folder}/events.parquet"))
