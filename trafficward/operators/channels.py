"""Channel tables: one row per channel, aggregated with partial sums before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.common import as_int, count_where, hash01, rate, safe_ratio
from ..schema import ANONYMISERS, TIE
from .sequence import gaps


def _channels(df: DataFrame) -> DataFrame:
    return df.where(F.col("channelId").isNotNull())


def channel_features(df: DataFrame) -> DataFrame:
    """23 aggregates and two ratios per channel, rounded half-even to four places."""
    mean = lambda c: F.bround(F.avg(F.col(c).cast("double")), 4)
    std = lambda c: F.bround(F.stddev_samp(c), 4)
    bots = count_where(F.col("isLikelyBot"))
    out = _channels(df).groupBy("channelId").agg(
        F.count("date").alias("channel_date_count"),
        F.bround(rate(F.col("isLikelyBot")), 4).alias("channel_isLikelyBot_mean"),
        bots.alias("channel_isLikelyBot_sum"),
        mean("total_fraud_flags").alias("channel_total_fraud_flags_mean"),
        F.sum("total_fraud_flags").alias("channel_total_fraud_flags_sum"),
        mean("weighted_fraud_score").alias("channel_weighted_fraud_score_mean"),
        F.bround(F.max("weighted_fraud_score"), 4).alias("channel_weighted_fraud_score_max"),
        *[F.count_distinct(c).alias(f"channel_{c}_nunique") for c in ["country", "browser", "device", "ip"]],
        mean("hour").alias("channel_hour_mean"),
        std("hour").alias("channel_hour_std"),
        mean("day_of_week").alias("channel_day_of_week_mean"),
        std("day_of_week").alias("channel_day_of_week_std"),
        *[mean(c).alias(f"channel_{c}_mean") for c in ["is_weekend", "is_night", "is_business_hours"]],
        *[
            mean(c).alias(f"channel_{c}_mean")
            for c in ["ua_length", "ua_entropy", "ip_entropy", "keyword_length", "keyword_commercial_intent"]
        ],
    )
    share = lambda top: F.bround(safe_ratio(F.col(top), F.col("channel_date_count")), 4)
    return out.withColumns(
        {
            "channel_bot_ratio": share("channel_isLikelyBot_sum"),
            "channel_unique_ip_ratio": share("channel_ip_nunique"),
        }
    )


def _exact_mean(column: str) -> F.Column:
    """Mean of decimal fractions: the sum is exact, so a mean on a threshold does not depend on the order of rows."""
    return F.try_divide(F.sum(F.col(column).cast("decimal(28,12)")).cast("double"), F.count(column).cast("double"))


def _whole_std(column: str) -> F.Column:
    """Sample deviation of whole numbers from exact sums."""
    n = F.count(column).cast("decimal(18,0)")
    x = F.col(column).cast("bigint")
    s = F.sum(x).cast("decimal(18,0)")
    spread = (n * F.sum(x * x).cast("decimal(18,0)")).cast("decimal(38,0)") - (s * s).cast("decimal(38,0)")
    return F.sqrt(F.try_divide(spread.cast("double"), (n * (n - 1)).cast("double")))


def quality_metrics(df: DataFrame) -> DataFrame:
    """The 13 metrics the quality labels and models use; missing values read 0.

    Those that rules compare with thresholds come from exact sums.
    """
    return (
        _channels(df)
        .groupBy("channelId")
        .agg(
            rate(F.col("isLikelyBot")).alias("bot_rate"),
            F.avg("total_fraud_flags").alias("fraud_flags_avg"),
            _exact_mean("weighted_fraud_score").alias("fraud_score_avg"),
            F.count_distinct("ip").alias("ip_diversity"),
            F.count_distinct("country").alias("country_diversity"),
            F.count_distinct("browser").alias("browser_diversity"),
            F.avg("ua_suspicious").alias("ua_suspicious_rate"),
            F.count("date").alias("volume"),
            F.avg("is_business_hours").alias("business_hours_rate"),
            F.avg("is_weekend").alias("weekend_rate"),
            _whole_std("hour").alias("time_pattern_diversity"),
            F.avg("keyword_commercial_intent").alias("commercial_intent_rate"),
            F.avg("referrer_is_ad_network").alias("ad_network_rate"),
        )
        .fillna(0)
    )


def light_features(df: DataFrame, approximate: bool = False, sample: int = 1000) -> DataFrame:
    """Volume, bot rate and diversities per channel.

    `approximate` computes all but the volume from at most `sample` hashed rows per channel.
    Absent columns read as their defaults (bot rate 0, diversities 1).
    """
    has = set(df.columns)
    base = _channels(df)
    bot = F.avg(as_int(F.col("isLikelyBot")).cast("double")) if "isLikelyBot" in has else F.lit(0.0)
    measures = [bot.alias("bot_rate")]
    for column, name in [
        ("ip", "ip_diversity"),
        ("hour", "hour_diversity"),
        ("day_of_week", "day_diversity"),
        ("device", "device_diversity"),
        ("browser", "browser_diversity"),
    ]:
        value = F.count_distinct(column) if column in has else F.lit(1)
        measures.append(value.alias(name))
    if not approximate:
        return base.groupBy("channelId").agg(F.count("*").alias("volume"), *measures)
    volumes = base.groupBy("channelId").agg(F.count("*").alias("volume"))
    turn = Window.partitionBy("channelId").orderBy(hash01(F.col(TIE)), TIE)
    drawn = base.withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= sample)
    return volumes.join(drawn.groupBy("channelId").agg(*measures), "channelId")


def profiles(df: DataFrame) -> DataFrame:
    """24 hourly counts, mobile / weekend / bot shares, country diversity and mean address risk."""
    return (
        _channels(df)
        .groupBy("channelId")
        .agg(
            *[F.count_if(F.col("hour") == h).alias(f"hour_{h}_traffic") for h in range(24)],
            rate(F.col("device") == "mobile").alias("mobile_ratio"),
            F.count_distinct("country").alias("top_countries_diversity"),
            rate(F.col("is_weekend") == 1).alias("weekend_ratio"),
            F.avg("ip_risk_points").alias("avg_ip_risk_score"),
            rate(F.col("isLikelyBot")).alias("bot_ratio"),
        )
        .fillna(0)
    )


def time_counts(df: DataFrame) -> DataFrame:
    """hour_0…hour_23 and dow_0…dow_6 counts in one aggregate."""
    return _channels(df).groupBy("channelId").agg(
        *[F.count_if(F.col("hour") == h).alias(f"hour_{h}") for h in range(24)],
        *[F.count_if(F.col("day_of_week") == d).alias(f"dow_{d}") for d in range(7)],
    )


def _weighted_std(n: str, x, total) -> F.Column:
    """Sample deviation of integer values x that each occur n times."""
    count = F.col(n)
    sq, s = F.sum(count * x * x), F.sum(count * x)
    variance = F.try_divide(sq - s * s / F.nullif(total, F.lit(0)), F.nullif(total - 1, F.lit(0)))
    return F.sqrt(F.greatest(variance, F.lit(0.0)))


def agent_patterns(df: DataFrame) -> DataFrame:
    """User-agent diversity, length mean and deviation, short share and dominant share.

    Agents are counted per (channel, agent) first, so the second step sees one row per agent.
    """
    pairs = _channels(df).groupBy("channelId", "userAgent").agg(F.count("*").alias("_n"))
    known = F.col("userAgent").isNotNull()
    n = F.when(known, F.col("_n")).otherwise(F.lit(0))
    size = F.length("userAgent").cast("double")
    pairs = pairs.withColumns({"_k": n, "_len": F.coalesce(size, F.lit(0.0))})
    seen = F.sum("_k")
    return pairs.groupBy("channelId").agg(
        F.count("userAgent").alias("ua_diversity"),
        F.try_divide(F.sum(F.col("_k") * F.col("_len")), seen).alias("ua_avg_length"),
        _weighted_std("_k", F.col("_len"), seen).alias("ua_length_std"),
        (F.sum(F.when(known & (F.col("_len") < 50), F.col("_n")).otherwise(0)) / F.sum("_n")).alias("short_ua_rate"),
        (F.max("_k") / F.sum("_n")).alias("dominant_ua_pct"),
    )


def version_patterns(df: DataFrame) -> DataFrame:
    """Browser-version diversity, mean, deviation, share below 50, most common (smallest on ties)."""
    pairs = _channels(df).groupBy("channelId", "browserMajorVersion").agg(F.count("*").alias("_n"))
    version = F.col("browserMajorVersion")
    pairs = pairs.withColumns(
        {
            "_k": F.when(version.isNotNull(), F.col("_n")).otherwise(F.lit(0)),
            "_v": F.coalesce(version.cast("double"), F.lit(0.0)),
        }
    )
    seen = F.sum("_k")
    return pairs.groupBy("channelId").agg(
        F.count("browserMajorVersion").alias("version_diversity"),
        F.try_divide(F.sum(F.col("_k") * F.col("_v")), seen).alias("avg_version"),
        _weighted_std("_k", F.col("_v"), seen).alias("version_std"),
        (F.sum(F.when(version < 50, F.col("_n")).otherwise(0)) / F.sum("_n")).alias("outdated_browser_rate"),
        F.coalesce(F.max_by(version, F.struct(F.col("_k"), -version)), F.lit(0)).alias("most_common_version"),
    )


def _dominant(df: DataFrame, column: str, prefix: str) -> DataFrame:
    pairs = _channels(df).groupBy("channelId", column).agg(F.count("*").alias("_n"))
    known = F.col(column).isNotNull()
    seen = F.when(known, F.col("_n")).otherwise(F.lit(0))
    return pairs.groupBy("channelId").agg(
        F.count(column).alias(f"{prefix}_diversity"),
        F.try_divide(F.sum(seen * F.length(column)), F.sum(seen)).alias(f"avg_{prefix}_length"),
        (F.max(seen) / F.sum("_n")).alias(f"dominant_{prefix}_pct"),
        (F.sum(F.when(~known, F.col("_n")).otherwise(0)) / F.sum("_n")).alias(f"no_{prefix}_rate"),
    )


def behaviour(df: DataFrame) -> DataFrame:
    """Gap mean, deviation and sub-second count; keyword and referrer patterns."""
    timing = (
        gaps(df, "channelId")
        .groupBy("channelId")
        .agg(
            F.avg("gap").alias("avg_time_between_requests"),
            F.stddev_samp("gap").alias("time_variance"),
            F.count_if(F.col("gap") < 1).alias("rapid_requests"),
        )
    )
    keywords = _dominant(df, "keyword", "keyword").drop("no_keyword_rate")
    referrers = _dominant(df, "referrer", "referrer").select("channelId", "referrer_diversity", "no_referrer_rate")
    return keywords.join(referrers, "channelId").join(timing, "channelId", "left").fillna(0)


def country_shape(df: DataFrame) -> DataFrame:
    """Country diversity and the share of the dominant country, from the long (channel, country) counts."""
    pairs = (
        _channels(df)
        .where(F.col("country").isNotNull())
        .groupBy("channelId", "country")
        .agg(F.count("*").alias("cnt"))
    )
    return pairs.groupBy("channelId").agg(
        F.count("*").alias("country_diversity"),
        (F.max("cnt") / F.sum("cnt")).alias("dominant_country_pct"),
    )


def closed_form_quality(df: DataFrame) -> DataFrame:
    """0–100 score: 100 minus weighted shares of bots, risky addresses, datacenters, anonymisers
    and the deviation of the hourly shares.

    Rows are first summed per (channel, hour). The anonymiser share adds four flags and may
    exceed 1. A channel seen in one hour only has no deviation and scores 0.
    """
    # Weights of the five components.
    weights = {
        "bot_ratio": 0.3,
        "high_risk_ip_ratio": 0.25,
        "datacenter_ratio": 0.2,
        "anonymization_ratio": 0.15,
        "temporal_anomaly_score": 0.1,
    }
    anonymised = sum((as_int(F.col(c)) for c in ANONYMISERS[1:]), as_int(F.col(ANONYMISERS[0])))
    hourly = (
        _channels(df)
        .groupBy("channelId", "hour")
        .agg(
            F.count("*").alias("_n"),
            count_where(F.col("isLikelyBot")).alias("_bot"),
            count_where(F.col("is_high_risk_ip")).alias("_risk"),
            count_where(F.col("isIpDatacenter")).alias("_dc"),
            F.sum(anonymised).alias("_anon"),
        )
    )
    n = F.sum("_n")
    per_channel = hourly.groupBy("channelId").agg(
        n.alias("traffic_volume"),
        (F.sum("_bot") / n).alias("bot_ratio"),
        (F.sum("_risk") / n).alias("high_risk_ip_ratio"),
        (F.sum("_dc") / n).alias("datacenter_ratio"),
        (F.sum("_anon") / n).alias("anonymization_ratio"),
        # deviation of counts over the total equals the deviation of the shares
        (F.stddev_samp("_n") / n).alias("temporal_anomaly_score"),
    )
    penalty = sum((F.col(c) * F.lit(w * 100) for c, w in weights.items()), F.lit(0.0))
    score = F.coalesce(F.greatest(F.lit(0.0), F.lit(100.0) - penalty), F.lit(0.0))
    score = F.when(F.col("temporal_anomaly_score").isNull(), F.lit(0.0)).otherwise(score)
    return per_channel.withColumn("quality_score", score)


def light_quality(df: DataFrame) -> DataFrame:
    """100 − (30·bot + 25·high risk + 20·datacenter), floored at 0."""
    shares = _channels(df).groupBy("channelId").agg(
        F.count("*").alias("traffic_volume"),
        rate(F.col("isLikelyBot")).alias("bot_ratio"),
        rate(F.col("is_high_risk_ip")).alias("high_risk_ratio"),
        rate(F.col("isIpDatacenter")).alias("datacenter_ratio"),
    )
    penalty = F.col("bot_ratio") * 30 + F.col("high_risk_ratio") * 25 + F.col("datacenter_ratio") * 20
    return shares.withColumn("quality_score", F.greatest(F.lit(0.0), F.lit(100.0) - penalty))


def low_quality(scores: DataFrame, threshold: float = 30.0) -> DataFrame:
    """Channels scoring below the threshold, worst first."""
    return scores.where(F.col("quality_score") < threshold).orderBy("quality_score", "channelId")
