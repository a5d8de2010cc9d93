"""The traffic log schema and the rule that makes tolerant inputs strict."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# The 30 columns of the traffic log.
TRAFFIC = T.StructType(
    [
        T.StructField("date", T.TimestampType()),
        T.StructField("keyword", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("browser", T.StringType()),
        T.StructField("device", T.StringType()),
        T.StructField("referrer", T.StringType()),
        T.StructField("ip", T.StringType()),
        T.StructField("publisherId", T.StringType()),
        T.StructField("channelId", T.StringType()),
        T.StructField("advertiserId", T.StringType()),
        T.StructField("feedId", T.StringType()),
        T.StructField("browserMajorVersion", T.IntegerType()),
        T.StructField("userId", T.StringType()),
        T.StructField("isLikelyBot", T.BooleanType()),
        T.StructField("ipClassification", T.StringType()),
        T.StructField("isIpDatacenter", T.BooleanType()),
        T.StructField("datacenterName", T.StringType()),
        T.StructField("ipHostName", T.StringType()),
        T.StructField("isIpAnonymous", T.BooleanType()),
        T.StructField("isIpCrawler", T.BooleanType()),
        T.StructField("isIpPublicProxy", T.BooleanType()),
        T.StructField("isIpVPN", T.BooleanType()),
        T.StructField("isIpHostingService", T.BooleanType()),
        T.StructField("isIpTOR", T.BooleanType()),
        T.StructField("isIpResidentialProxy", T.BooleanType()),
        T.StructField("performance", T.StringType()),
        T.StructField("detection", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("userAgent", T.StringType()),
    ]
)

BOOLEANS = [f.name for f in TRAFFIC if f.dataType == T.BooleanType()]
IP_FLAGS = [c for c in BOOLEANS if c.startswith("isIp")]
# The shorter list used by the traffic-quality score: no hosting-service flag.
RISK_FLAGS = [c for c in IP_FLAGS if c != "isIpHostingService"]
ANONYMISERS = ["isIpAnonymous", "isIpVPN", "isIpTOR", "isIpPublicProxy"]
ENTITIES = ["channelId", "publisherId", "ip", "userId"]
TIE = "eventId"
ANOMALY_FLAGS = [
    "temporal_anomaly",
    "geographic_anomaly",
    "device_anomaly",
    "behavioral_anomaly",
    "volume_anomaly",
]


def ensure_columns(df: DataFrame, schema: T.StructType = TRAFFIC) -> DataFrame:
    """Cast the declared columns to their types and add absent ones as typed nulls.

    Columns outside the schema are kept, so later operators may assume the full log.
    A log without a row id gets `eventId` from its content, used only to order ties.
    """
    present = set(df.columns)
    declared = [
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ]
    names = {f.name for f in schema}
    extra = [F.col(c) for c in df.columns if c not in names]
    out = df.select(*declared, *extra)
    if TIE not in present:
        out = out.withColumn(TIE, F.xxhash64(*[F.col(f.name) for f in schema]))
    return out


def numeric_columns(df: DataFrame, skip: tuple[str, ...] = ()) -> list[str]:
    """Names of the numeric columns, in schema order."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]
