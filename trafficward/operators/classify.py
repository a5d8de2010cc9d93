"""Row-level fraud classification as column expressions over two left joins."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.fraud import bot_flag
from ..schema import ANOMALY_FLAGS, TIE

# Address classes that add risk, and the reason of each anomaly flag.
SUSPECT_CLASSES = ["suspicious", "malicious"]
ANOMALY_REASONS = {flag: flag for flag in ANOMALY_FLAGS}


@dataclass(frozen=True)
class Thresholds:
    """Decision limits and risk weights; `asdict` gives them back for documentation."""

    quality_low: float = 3.0
    quality_high: float = 7.0
    anomaly_high: int = 3
    risk: float = 0.5
    weights: dict[str, float] = field(
        default_factory=lambda: {
            "quality_score": 0.4,
            "anomaly_count": 0.3,
            "bot_indicator": 0.15,
            "ip_risk": 0.15,
        }
    )
    name_high_risk: bool = False

    def describe(self) -> dict:
        return asdict(self)


def risk_score(quality: Column, anomalies: Column, bot: Column, address: Column, t: Thresholds) -> Column:
    """Weighted risk in [0,1] from quality, anomaly count, bot flag and address risk."""
    w = t.weights
    raw = (
        F.lit(w["quality_score"]) * (F.lit(10.0) - quality) / F.lit(10.0)
        + F.lit(w["anomaly_count"]) * F.least(anomalies / F.lit(5.0), F.lit(1.0))
        + F.lit(w["bot_indicator"]) * bot.cast("double")
        + F.lit(w["ip_risk"]) * address
    )
    return F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))


def address_risk(datacenter: Column, anonymous: Column, suspect: Column) -> Column:
    """0.5 datacenter + 0.3 anonymous + 0.4 suspicious class, at most 1."""
    return F.least(
        datacenter.cast("double") * 0.5 + anonymous.cast("double") * 0.3 + suspect.cast("double") * 0.4,
        F.lit(1.0),
    )


def verdict(t: Thresholds, quality: Column, anomalies: Column, risk: Column, bot: Column, dc: Column, anon: Column) -> Column:
    """Struct (classification, confidence, reason) of the first matching rule."""
    outcome = lambda label, confidence, reason: F.struct(
        F.lit(label).alias("classification"),
        confidence.cast("double").alias("confidence"),
        (F.lit(reason) if reason else F.lit(None).cast("string")).alias("reason"),
    )
    weak, many = quality <= t.quality_low, anomalies >= t.anomaly_high
    by_risk = F.least(F.lit(0.5) + risk * F.lit(0.4), F.lit(0.9))
    return (
        F.when(
            (quality >= t.quality_high) & (anomalies <= 1),
            outcome("good_account", F.lit(0.8), "clean_pattern"),
        )
        .when(weak & many, outcome("fraud", F.lit(0.9), "multiple_indicators"))
        .when(bot, outcome("fraud", F.lit(0.8), "high_bot_activity"))
        .when(dc, outcome("fraud", F.lit(0.7), "datacenter_ip"))
        .when(anon, outcome("fraud", F.lit(0.6), "anonymous_ip"))
        .when(risk >= t.risk, outcome("fraud", by_risk, "high_risk_score" if t.name_high_risk else None))
        .when(weak, outcome("fraud", F.lit(0.6), "low_quality_score"))
        .when(many, outcome("fraud", F.lit(0.7), "multiple_indicators"))
        .otherwise(outcome("good_account", F.lit(0.5), None))
    )


def with_scores(df: DataFrame, quality: DataFrame, anomalies: DataFrame, level: str = "channel") -> DataFrame:
    """Rows with the channel's quality (default 5) and the anomaly flags (default false / 0).

    `level` says whether anomalies are keyed by channelId or by the row id. Both score tables
    are far smaller than the rows; Spark broadcasts them when their measured size allows and
    otherwise joins on the key with skew splitting.
    """
    key = "channelId" if level == "channel" else TIE
    have = set(anomalies.columns)
    absent = lambda name, kind: F.lit(None).cast(kind).alias(name)
    flags = anomalies.select(
        key,
        *[F.col(c).cast("boolean").alias(c) if c in have else absent(c, "boolean") for c in ANOMALY_FLAGS],
        F.col("overall_anomaly_count").cast("int").alias("overall_anomaly_count")
        if "overall_anomaly_count" in have
        else absent("overall_anomaly_count", "int"),
    )
    # one row per key: a repeated key must not multiply the rows it meets
    flags = flags.groupBy(key).agg(
        *[F.bool_or(c).alias(c) for c in ANOMALY_FLAGS], F.max("overall_anomaly_count").alias("overall_anomaly_count")
    )
    joined = df.join(quality.select("channelId", "quality_score"), "channelId", "left").join(flags, key, "left")
    return joined.withColumns(
        {
            "quality_score": F.coalesce(F.col("quality_score").cast("double"), F.lit(5.0)),
            **{c: F.coalesce(F.col(c), F.lit(False)) for c in ANOMALY_FLAGS},
            "overall_anomaly_count": F.coalesce("overall_anomaly_count", F.lit(0)),
        }
    )


def judge(df: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Risk score, class, confidence and reasons for rows that carry quality and anomaly columns."""
    t = thresholds
    truth = lambda c: F.coalesce(F.col(c), F.lit(False))
    suspect = F.coalesce(F.col("ipClassification").isin(SUSPECT_CLASSES), F.lit(False))
    bot, dc, anon = bot_flag(df), truth("isIpDatacenter"), truth("isIpAnonymous")
    quality, count = F.col("quality_score"), F.col("overall_anomaly_count")
    scored = df.withColumn("risk_score", risk_score(quality, count, bot, address_risk(dc, anon, suspect), t))
    ruled = scored.withColumn("_verdict", verdict(t, quality, count, F.col("risk_score"), bot, dc, anon))
    named = F.array(
        F.col("_verdict.reason"),
        *[F.when(F.col(flag), F.lit(reason)) for flag, reason in ANOMALY_REASONS.items()],
        F.when(suspect, F.lit("suspicious_ip_pattern")),
    )
    found = F.filter(named, lambda r: r.isNotNull())
    lonely = (F.size(found) == 0) & (F.col("_verdict.classification") == "good_account")
    reasons = F.when(lonely, F.array(F.lit("clean_pattern"))).otherwise(found)
    return ruled.withColumns(
        {
            "classification": F.col("_verdict.classification"),
            "confidence": F.col("_verdict.confidence"),
            "reason_list": reasons,
            "reason_codes": F.array_join(reasons, ", "),
        }
    ).drop("_verdict")


def classify(
    df: DataFrame,
    quality: DataFrame,
    anomalies: DataFrame,
    thresholds: Thresholds = Thresholds(),
    level: str = "channel",
) -> DataFrame:
    """Every input row and column, with class, scores, confidence, reasons and flags added.

    A row without a channel finds no scores and keeps the defaults; null flags read false.
    """
    judged = judge(with_scores(df, quality, anomalies, level), thresholds)
    return judged.withColumn("_original_index", F.col(TIE))


def classification_summary(classified: DataFrame) -> DataFrame:
    fraud = F.count_if(F.col("classification") == "fraud")
    return classified.agg(
        F.count("*").alias("total_rows"),
        fraud.alias("fraud_rows"),
        F.coalesce(F.try_divide(fraud * 100.0, F.count("*")), F.lit(0.0)).alias("fraud_pct"),
        F.avg("quality_score").alias("avg_quality_score"),
        F.avg("risk_score").alias("avg_risk_score"),
    )


def risk_level(quality: Column, high_risk: Column, anomalies: Column) -> Column:
    """HIGH / MEDIUM / LOW / MINIMAL from points for quality band, risk flag and anomaly count."""
    points = (
        F.when(quality <= 3, 3).when(quality <= 5, 2).when(quality <= 7, 1).otherwise(0)
        + F.when(high_risk, 2).otherwise(0)
        + F.when(anomalies >= 3, 3).when(anomalies >= 2, 2).when(anomalies >= 1, 1).otherwise(0)
    )
    return F.when(points >= 5, "HIGH").when(points >= 3, "MEDIUM").when(points >= 1, "LOW").otherwise("MINIMAL")


def channel_predictions(quality: DataFrame, anomalies: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """One record per channel: quality, anomaly flags, verdict and, if given, similar channels.

    `similar` holds (channelId, similar_channels array).
    """
    joined = quality.join(
        anomalies.select("channelId", *ANOMALY_FLAGS, "overall_anomaly_count"), "channelId", "left"
    )
    if similar is not None:
        joined = joined.join(similar, "channelId", "left")
    count = F.coalesce(F.col("overall_anomaly_count"), F.lit(0))
    return joined.select(
        "channelId",
        "quality_score",
        "quality_category",
        "high_risk",
        "bot_rate",
        F.col("fraud_score_avg").alias("fraud_score"),
        F.struct(*[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ANOMALY_FLAGS]).alias("anomaly_flags"),
        count.alias("anomaly_score"),
        (count >= 2).alias("is_anomalous"),
        risk_level(F.col("quality_score"), F.col("high_risk"), count).alias("risk_level"),
        *(["similar_channels"] if similar is not None else []),
    )
