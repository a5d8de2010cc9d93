"""Registry of named queries and the SQL fragments their twins share."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.clean import clean
from ..plans.features import row_features
from ..session import settle
from ..sources.events import TRAFFIC_FROM_EVENTS, load_traffic

_SPARK = {"s": "string", "i": "bigint", "b": "boolean", "f": "double"}
_SQL = {"s": "VARCHAR", "i": "BIGINT", "b": "BOOLEAN", "f": "DOUBLE"}


@dataclass(frozen=True)
class Query:
    name: str
    columns: list[tuple[str, str]]
    build: Callable[["Tables"], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.shape(self.build(Tables(spark, folder)))

    def shape(self, df: DataFrame) -> DataFrame:
        """Named, typed output; doubles rounded to six places (and no negative zero)."""
        out = []
        for name, kind in self.columns:
            value = F.col(f"`{name}`").cast(_SPARK[kind])
            out.append((F.round(value, 6) + F.lit(0.0) if kind == "f" else value).alias(name))
        return df.select(*out)

    def twin(self) -> str | None:
        if self.sql is None:
            return None
        out = []
        for name, kind in self.columns:
            value = f'CAST("{name}" AS {_SQL[kind]})'
            out.append((f"round({value}, 6) + 0.0" if kind == "f" else value) + f' AS "{name}"')
        return f"WITH {_needed(self.sql)}answer AS ({self.sql.strip()}) SELECT {', '.join(out)} FROM answer"


REGISTRY: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    """Register a query; `columns` lists name:kind with kinds s, i, b, f."""

    def add(build: Callable[["Tables"], DataFrame]) -> Callable:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        spec = [tuple(c.rsplit(":", 1)) for c in columns.split()]
        REGISTRY[name] = Query(name, spec, build, sql)
        return build

    return add


_CACHE: dict[tuple, object] = {}


@dataclass(frozen=True)
class Tables:
    """The provided tables of one folder, and inputs derived from them."""

    spark: SparkSession
    folder: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def traffic(self) -> DataFrame:
        return self.once("traffic", lambda: load_traffic(self.spark, self.folder))

    @property
    def clean(self) -> DataFrame:
        return self.once("clean", lambda: clean(self.traffic))

    @property
    def rows(self) -> DataFrame:
        return self.once("rows", lambda: row_features(self.clean))

    def once(self, name: str, build: Callable[[], object]) -> object:
        """Analysed plans and fitted models shared by several queries of one session (no result data)."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _CACHE:
            _CACHE[key] = build()
        return _CACHE[key]

    @property
    def points(self) -> DataFrame:
        """Embeddings as (id, vec)."""
        return self.read("embeddings").select(
            F.concat(F.lit("v"), F.col("vec_id")).alias("id"), F.col("embedding").cast("array<double>").alias("vec")
        )

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return self.once(name, lambda: settle(build()))


def hash01(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def entropy(text: str) -> str:
    share = f"((length({text}) - length(replace({text}, c, '')))::DOUBLE / length({text}))"
    return (
        f"CASE WHEN length({text}) > 0 THEN -list_sum([{share} * log2({share}) "
        f"FOR c IN list_distinct(string_split({text}, ''))]) ELSE 0 END"
    )


def words(text: str) -> str:
    return f"CASE WHEN trim({text}) <> '' THEN len(regexp_split_to_array(trim({text}), '\\s+')) ELSE 0 END"


_FLAGS = [
    "isLikelyBot", "isIpDatacenter", "isIpAnonymous", "isIpCrawler", "isIpPublicProxy", "isIpVPN",
    "isIpHostingService", "isIpTOR", "isIpResidentialProxy",
]
_num = lambda c: f"coalesce({c}, false)::INT"
_band = lambda c: f"CASE WHEN {c} > 0 AND {c} <= 3 THEN 'Low' WHEN {c} > 3 AND {c} <= 5 THEN 'Medium-Low' " \
    f"WHEN {c} > 5 AND {c} <= 7 THEN 'Medium-High' WHEN {c} > 7 AND {c} <= 10 THEN 'High' END"
band = _band

SHARED = f"""
traffic AS (SELECT {', '.join(f'{e} AS "{n}"' for n, e in TRAFFIC_FROM_EVENTS.items())}
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events)),
clean AS (SELECT * REPLACE ({', '.join(f'coalesce({c}, false) AS {c}' for c in _FLAGS)})
  FROM traffic WHERE ip IS NOT NULL AND NOT regexp_matches(ip, '(?i)nan|none|null')),
calendar AS (SELECT *, hour(date) AS hour, isodow(date) - 1 AS day_of_week, day(date) AS day_of_month,
  month(date) AS month, quarter(date) AS quarter, year(date) AS year, floor(epoch(date))::BIGINT AS "timestamp"
  FROM clean),
feat AS (SELECT *,
  (day_of_week >= 5)::INT AS is_weekend, (hour >= 22 OR hour <= 6)::INT AS is_night,
  (hour BETWEEN 9 AND 17 AND day_of_week < 5)::INT AS is_business_hours,
  CASE WHEN hour <= 6 THEN 'night' WHEN hour <= 12 THEN 'morning' WHEN hour <= 18 THEN 'afternoon' ELSE 'evening' END AS time_segment,
  {entropy('ip')} AS ip_entropy,
  {' + '.join(_num(c) for c in _FLAGS if c != 'isLikelyBot')} AS total_ip_flags,
  {' + '.join(_num(c) for c in _FLAGS if c not in ('isLikelyBot', 'isIpHostingService'))} AS ip_risk_points,
  {' + '.join(_num(c) for c in _FLAGS if c not in ('isLikelyBot', 'isIpHostingService'))} >= 2 AS is_high_risk_ip,
  coalesce(length(userAgent), 0) AS ua_length, {words('userAgent')} AS ua_word_count,
  CASE WHEN browser = 'chrome' AND (browserMajorVersion < 70 OR browserMajorVersion > 130) THEN 0 ELSE 1 END AS browser_version_match,
  coalesce(regexp_matches(lower(userAgent), 'bot|crawler|spider|scraper|curl|wget|python|java|scrapy|requests'), false)::INT AS ua_bot_indicators,
  {entropy('userAgent')} AS ua_entropy,
  coalesce(regexp_matches(userAgent, '[0-9]+\\.[0-9]+'), false)::INT AS ua_has_version,
  (coalesce(length(userAgent), 0) < 10 OR length(userAgent) > 500 OR {words('userAgent')} < 2)::INT AS ua_suspicious,
  CASE WHEN referrer IS NULL OR referrer = '' THEN 'unknown' ELSE
    regexp_replace(lower(regexp_extract(referrer, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)), '^www\\.', '') END AS referrer_domain,
  coalesce(length(keyword), 0) AS keyword_length, {words('keyword')} AS keyword_word_count,
  coalesce(regexp_matches(lower(keyword), 'samsung|apple|microsoft|google|amazon'), false)::INT AS keyword_has_brand,
  coalesce(regexp_matches(lower(keyword), 'buy|price|deal|discount|sale|cheap|best'), false)::INT AS keyword_commercial_intent,
  coalesce(device, 'nan') || '_' || coalesce(browser, 'nan') AS device_browser_combo,
  {' + '.join(_num(c) for c in _FLAGS)} AS total_fraud_flags,
  3.0::DOUBLE * {_num('isLikelyBot')} + 2.5::DOUBLE * {_num('isIpTOR')} + 2.0::DOUBLE * {_num('isIpDatacenter')}
    + 1.5::DOUBLE * {_num('isIpVPN')} + 1.5::DOUBLE * {_num('isIpAnonymous')} + 1.8::DOUBLE * {_num('isIpPublicProxy')}
    + 2.0::DOUBLE * {_num('isIpHostingService')} + 1.2::DOUBLE * {_num('isIpResidentialProxy')}
    + 2.2::DOUBLE * {_num('isIpCrawler')} AS weighted_fraud_score
  FROM calendar),
hits AS (SELECT *, (referrer_domain IN ('taboola.com', 'outbrain.com', 'googleadservices.com'))::INT AS referrer_is_ad_network FROM feat),
metrics AS (SELECT channelId, avg(isLikelyBot::INT) AS bot_rate, avg(total_fraud_flags) AS fraud_flags_avg,
  avg(weighted_fraud_score) AS fraud_score_avg, count(DISTINCT ip) AS ip_diversity,
  count(DISTINCT country) AS country_diversity, count(DISTINCT browser) AS browser_diversity,
  avg(ua_suspicious) AS ua_suspicious_rate, count(date) AS volume, avg(is_business_hours) AS business_hours_rate,
  avg(is_weekend) AS weekend_rate, coalesce(stddev_samp(hour), 0) AS time_pattern_diversity,
  avg(keyword_commercial_intent) AS commercial_intent_rate, avg(referrer_is_ad_network) AS ad_network_rate
  FROM hits GROUP BY channelId),
banded AS (SELECT *, CASE
  WHEN bot_rate > 0.5 OR fraud_score_avg > 3.0 OR ua_suspicious_rate > 0.3 OR (ip_diversity = 1 AND volume > 100) THEN 'low'
  WHEN (bot_rate > 0.25 AND bot_rate <= 0.5) OR (fraud_score_avg > 1.5 AND fraud_score_avg <= 3.0) OR ip_diversity < 3 OR time_pattern_diversity < 1.0 THEN 'medium_low'
  WHEN bot_rate < 0.05 AND fraud_score_avg < 0.5 AND ip_diversity >= 10 AND country_diversity >= 2 AND business_hours_rate > 0.3 AND volume >= 50 THEN 'high'
  WHEN bot_rate < 0.15 AND fraud_score_avg < 1.0 AND ip_diversity >= 5 AND volume >= 20 THEN 'good'
  WHEN bot_rate <= 0.25 AND fraud_score_avg <= 1.5 AND ip_diversity >= 3 THEN 'medium' END AS label_band FROM metrics),
labelled AS (SELECT *, CASE label_band WHEN 'low' THEN 1.0 + 2.0 * {hash01('channelId')}
  WHEN 'medium_low' THEN 3.0 + 2.0 * {hash01('channelId')} WHEN 'medium' THEN 5.0 + 2.0 * {hash01('channelId')}
  WHEN 'good' THEN 7.0 + 1.5 * {hash01('channelId')} WHEN 'high' THEN 8.5 + 1.5 * {hash01('channelId')} END AS quality_score
  FROM banded),
scores AS (SELECT *, {_band('quality_score')} AS quality_category,
  (bot_rate > 0.3 OR fraud_score_avg > 2.0 OR quality_score < 3.0) AS high_risk FROM labelled),
closed AS (SELECT channelId, traffic_volume, bot_ratio, high_risk_ip_ratio, datacenter_ratio, anonymization_ratio,
  temporal_anomaly_score, CASE WHEN temporal_anomaly_score IS NULL THEN 0 ELSE greatest(0, 100 - (bot_ratio * 30
    + high_risk_ip_ratio * 25 + datacenter_ratio * 20 + anonymization_ratio * 15 + temporal_anomaly_score * 10)) END AS quality_score
  FROM (SELECT channelId, count(*) AS traffic_volume, avg(isLikelyBot::INT) AS bot_ratio, avg(is_high_risk_ip::INT) AS high_risk_ip_ratio,
    avg(isIpDatacenter::INT) AS datacenter_ratio,
    avg(isIpAnonymous::INT + isIpVPN::INT + isIpTOR::INT + isIpPublicProxy::INT) AS anonymization_ratio FROM hits GROUP BY channelId)
  JOIN (SELECT channelId, stddev_samp(share) AS temporal_anomaly_score FROM
    (SELECT channelId, count(*) / (sum(count(*)) OVER (PARTITION BY channelId)) AS share FROM hits GROUP BY channelId, hour)
    GROUP BY channelId) USING (channelId)),
dow AS (SELECT channelId, d, (count(r.eventId))::DOUBLE AS n FROM (SELECT DISTINCT channelId FROM hits) CROSS JOIN range(7) t(d)
  LEFT JOIN hits r USING (channelId) WHERE r.day_of_week = d GROUP BY channelId, d),
daily_full AS (SELECT c.channelId, t.d, coalesce(dow.n, 0) AS n FROM (SELECT DISTINCT channelId FROM hits) c CROSS JOIN range(7) t(d)
  LEFT JOIN dow ON dow.channelId = c.channelId AND dow.d = t.d),
daily AS (SELECT channelId, coalesce(max(abs(s - m) / nullif(sd, 0)), 0) AS daily_max_z_score FROM
  (SELECT channelId, s, avg(s) OVER w AS m, stddev_pop(s) OVER w AS sd FROM
    (SELECT channelId, n / sum(n) OVER (PARTITION BY channelId) AS s FROM daily_full) WINDOW w AS (PARTITION BY channelId)) GROUP BY channelId),
ip_stats AS (SELECT ip, count(*) AS requests_per_ip, count(DISTINCT channelId) AS channels_per_ip, count(DISTINCT country) AS countries FROM hits GROUP BY ip),
ip_geo AS (SELECT *, multi_country_ips > (quantile_cont(multi_country_ips, 0.9) OVER ()) AS ip_geo_anomaly FROM
  (SELECT channelId, count(*) FILTER (WHERE countries > 1) AS multi_country_ips, count(DISTINCT country) AS country_diversity
   FROM hits JOIN ip_stats USING (ip) GROUP BY channelId)),
suspect_ips AS (SELECT * FROM ip_stats WHERE requests_per_ip > (SELECT quantile_cont(requests_per_ip, 0.95) FROM ip_stats)),
volumes AS (SELECT channelId, count(date) AS total_requests, count(DISTINCT ip) AS unique_ips, count(DISTINCT userId) AS unique_users,
  count(*) FILTER (WHERE ip IN (SELECT ip FROM suspect_ips)) AS suspicious_ip_requests FROM hits GROUP BY channelId),
volume_flags AS (SELECT channelId,
  {', '.join(f'coalesce(abs({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0) > 3 AS {c}_anomaly' for c in ['total_requests', 'unique_ips', 'unique_users', 'suspicious_ip_requests'])}
  FROM volumes),
flags AS (SELECT *, temporal_anomaly::INT + geographic_anomaly::INT + volume_anomaly::INT AS overall_anomaly_count,
  temporal_anomaly::INT + geographic_anomaly::INT + volume_anomaly::INT >= 2 AS overall_anomaly_flag FROM
  (SELECT channelId, daily_max_z_score > 2 AS temporal_anomaly, ip_geo_anomaly AS geographic_anomaly, false AS device_anomaly,
    false AS behavioral_anomaly, total_requests_anomaly OR unique_ips_anomaly OR unique_users_anomaly OR suspicious_ip_requests_anomaly AS volume_anomaly
   FROM daily JOIN ip_geo USING (channelId) JOIN volume_flags USING (channelId)))
"""

_PARTS = dict(re.findall(r"^(\w+) AS (\(.*?\)),?$(?=\n\w+ AS \(|\s*\Z)", SHARED.strip(), re.M | re.S))


def _needed(sql: str) -> str:
    """The shared fragments a text uses, directly or through others, in order of definition."""
    uses = lambda text: {n for n in _PARTS if re.search(rf"\b{n}\b", text)}
    found, fresh = set(), uses(sql)
    while fresh:
        found |= fresh
        fresh = set().union(*(uses(_PARTS[n]) for n in fresh)) - found
    return "".join(f"{n} AS MATERIALIZED {body}, " for n, body in _PARTS.items() if n in found)
