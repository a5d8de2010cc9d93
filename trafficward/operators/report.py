"""The tables behind the reports, from the score table and the anomaly flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.common import correlation, right_closed, slope
from ..schema import ANOMALY_FLAGS
from .quality import BANDS, standard_scale
from .ranks import quantile_bins, quantile_struct, quantiles, row_bands
from .similarity import correlations, kmeans, to_points
from .tables import head_where, top

# Bands of the risk matrix.
BOT_EDGES, BOT_LABELS = [0, 0.1, 0.3, 0.5, 0.7, 1.0], ["0-10%", "10-30%", "30-50%", "50-70%", "70-100%"]
VOLUME_EDGES, VOLUME_LABELS = [0, 10, 100, 1000, 10000], ["0-10", "10-100", "100-1K", "1K-10K", "10K+"]


def best_and_worst(scores: DataFrame, n: int = 20) -> DataFrame:
    """Top and bottom channels in one table, side = top or bottom."""
    fields = ["channelId", "quality_score", "quality_category", "volume", "bot_rate", "high_risk"]
    best = top(scores, "quality_score", n, "channelId").select(F.lit("top").alias("side"), *fields)
    worst = top(scores, "quality_score", n, "channelId", lowest=True).select(F.lit("bottom").alias("side"), *fields)
    return best.unionByName(worst)


def high_risk_channels(scores: DataFrame, n: int = 50) -> DataFrame:
    """High-risk channels, best score first (the order of the score table)."""
    order = [F.desc("quality_score"), F.col("channelId")]
    return head_where(scores, F.col("high_risk"), order, n).select(
        "channelId", "quality_score", "quality_category", "volume", "bot_rate"
    )


def most_anomalous(flags: DataFrame, n: int = 20) -> DataFrame:
    return top(flags, "overall_anomaly_count", n, "channelId").select("channelId", "overall_anomaly_count")


def cluster_summary(labelled: DataFrame) -> DataFrame:
    return labelled.agg(F.count_distinct("cluster").alias("total_clusters"))


def summary_stats(scores: DataFrame, mode: str = "full") -> DataFrame:
    return scores.agg(
        F.count("*").alias("total_channels"),
        F.count_if("high_risk").alias("high_risk_count"),
        F.avg("quality_score").alias("avg_quality_score"),
    ).withColumn("processing_mode", F.lit(mode))


def _records(df: DataFrame, order: list[Column]) -> Column:
    """Scalar subquery: the rows of a bounded top-k table as an array of structs, in order."""
    keyed = df.select(F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*df.columns).alias("row")).alias("r"))
    return keyed.agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["row"]).alias("rows")).scalar()


def final_document(scores: DataFrame, flags: DataFrame, classified_summary: DataFrame, mode: str = "full") -> DataFrame:
    """One-row document: ten best, ten worst, fifty high-risk, twenty most anomalous, summaries."""
    best = top(scores, "quality_score", 10, "channelId")
    worst = top(scores, "quality_score", 10, "channelId", lowest=True)
    risky = high_risk_channels(scores, 50)
    odd = most_anomalous(flags, 20)
    down = [-F.col("quality_score"), F.col("channelId")]
    fraud = classified_summary.select(F.struct(*classified_summary.columns).alias("s")).agg(F.first("s")).scalar()
    stats = summary_stats(scores, mode)
    return stats.select(
        _records(best, down).alias("top_quality_channels"),
        _records(worst, [F.col("quality_score"), F.col("channelId")]).alias("bottom_quality_channels"),
        _records(risky, down).alias("high_risk_channels"),
        _records(odd, [-F.col("overall_anomaly_count"), F.col("channelId")]).alias("most_anomalous_channels"),
        fraud.alias("fraud_classification_summary"),
        F.struct(*stats.columns).alias("summary_stats"),
    )


def kpis(scores: DataFrame, flags: DataFrame) -> DataFrame:
    """Executive figures in one row."""
    joined = with_anomaly_count(scores, flags)
    n, pct = F.count("*"), lambda c: F.count_if(c) * 100.0 / F.count("*")
    odd = F.col("overall_anomaly_count") > 0
    return joined.agg(
        n.alias("total_channels"),
        F.count_if("high_risk").alias("high_risk_channels"),
        pct(F.col("high_risk")).alias("high_risk_pct"),
        F.count_if(odd).alias("anomalous_channels"),
        pct(odd).alias("anomalous_pct"),
        F.avg("quality_score").alias("avg_quality_score"),
        F.avg("bot_rate").alias("avg_bot_rate"),
        F.sum("volume").alias("total_volume"),
    )


def with_anomaly_count(scores: DataFrame, flags: DataFrame) -> DataFrame:
    """Score table with the anomaly count, 0 where no detector saw the channel."""
    return scores.join(flags.select("channelId", "overall_anomaly_count"), "channelId", "left").fillna(
        0, subset=["overall_anomaly_count"]
    )


def score_statistics(scores: DataFrame) -> DataFrame:
    """Describe, IQR outliers and the three score bands, in one row."""
    q = quantile_struct(scores, ["quality_score"], [0.25, 0.5, 0.75])
    s = F.col("quality_score")
    low, mid, high = (F.col("_q.quality_score")[i] for i in range(3))
    spread = high - low
    out = (s < low - 1.5 * spread) | (s > high + 1.5 * spread)
    return scores.withColumn("_q", q).agg(
        F.count("*").alias("n"),
        F.avg(s).alias("mean"),
        F.stddev_samp(s).alias("std"),
        F.min(s).alias("min"),
        F.max(low).alias("q1"),
        F.max(mid).alias("median"),
        F.max(high).alias("q3"),
        F.max(s).alias("max"),
        F.max(spread).alias("iqr"),
        F.count_if(out).alias("outliers"),
        F.count_if(s > 6.5).alias("high_quality"),
        F.count_if(s.between(3.5, 6.5)).alias("medium_quality"),
        F.count_if(s < 3.5).alias("low_quality"),
    )


def trends(scores: DataFrame, flags: DataFrame) -> DataFrame:
    """Slope, intercept and correlation of the three trend lines."""
    rows = with_composite_risk(scores, flags).withColumn("log_volume", F.log10(F.col("volume") + 1))
    lines = [
        ("bot_rate~quality_score", "bot_rate", "quality_score"),
        ("quality_score~ip_diversity", "quality_score", "ip_diversity"),
        ("composite_risk~log_volume", "composite_risk", "log_volume"),
    ]
    d = lambda c: F.col(c).cast("double")
    parts = rows.agg(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("line"),
                    slope(d(y), d(x)).alias("slope"),
                    (F.avg(d(y)) - slope(d(y), d(x)) * F.avg(d(x))).alias("intercept"),
                    correlation(d(y), d(x)).alias("correlation"),
                )
                for name, y, x in lines
            ]
        ).alias("rows")
    )
    return parts.select(F.inline("rows"))


def flag_correlations(flags: DataFrame) -> DataFrame:
    """Correlation of every pair of anomaly flags, long form; null for a constant flag."""
    numeric = flags.select(*[F.col(c).cast("int").alias(c) for c in ANOMALY_FLAGS])
    return correlations(numeric, ANOMALY_FLAGS)


def anomalies_by_type(flags: DataFrame) -> DataFrame:
    counts = flags.agg(*[F.count_if(F.col(c)).alias(c) for c in ANOMALY_FLAGS])
    return counts.unpivot([], ANOMALY_FLAGS, "anomaly_type", "n")


def with_composite_risk(scores: DataFrame, flags: DataFrame) -> DataFrame:
    """0.4·(10 − quality) + 0.3·anomalies + 3·bot rate."""
    joined = with_anomaly_count(scores, flags)
    risk = (F.lit(10.0) - F.col("quality_score")) * 0.4 + F.col("overall_anomaly_count") * 0.3 + F.col("bot_rate") * 10 * 0.3
    return joined.withColumn("composite_risk", risk)


def volume_band(volume: Column) -> Column:
    return F.when(volume > VOLUME_EDGES[-1], VOLUME_LABELS[-1]).otherwise(
        right_closed(volume, VOLUME_EDGES, VOLUME_LABELS[:-1], include_lowest=True)
    )


def risk_matrix(scores: DataFrame) -> DataFrame:
    """Channels per bot-rate band (rows) and volume band (columns)."""
    banded = scores.select(
        right_closed(F.col("bot_rate"), BOT_EDGES, BOT_LABELS, include_lowest=True).alias("bot_rate_band"),
        volume_band(F.col("volume")).alias("volume_band"),
    ).where(F.col("bot_rate_band").isNotNull())
    return banded.groupBy("bot_rate_band").pivot("volume_band", VOLUME_LABELS).count().fillna(0)


def anomaly_matrix(flags: DataFrame, n: int = 20) -> DataFrame:
    """0/1 flags of the most anomalous channels."""
    chosen = top(flags.where(F.col("overall_anomaly_count") > 0), "overall_anomaly_count", n, "channelId")
    return chosen.select("channelId", *[F.col(c).cast("int").alias(c) for c in ANOMALY_FLAGS])


def score_clusters(scores: DataFrame, tries: int = 10) -> DataFrame:
    """K-means clusters on standardised score, bot rate and log volume: k = min(5, n/10)."""
    columns = ["quality_score", "bot_rate", "log_volume"]
    rows = scores.withColumn("log_volume", F.log1p(F.col("volume")))
    k = max(1, min(5, scores.count() // 10))
    if k == 1:
        return scores.withColumn("cluster", F.lit(0))
    labelled, _ = kmeans(to_points(standard_scale(rows, columns), columns), k, tries)
    return scores.join(labelled.select(F.col("id").alias("channelId"), "cluster"), "channelId")


def quality_by_cluster(labelled: DataFrame) -> DataFrame:
    """Mean quality per cluster, best first; noise left out."""
    return (
        labelled.where(F.col("cluster") != -1)
        .groupBy("cluster")
        .agg(F.avg("quality_score").alias("avg_quality"), F.count("*").alias("size"))
        .orderBy(F.desc("avg_quality"), "cluster")
    )


def quality_by_quantile(scores: DataFrame, q: int = 5) -> DataFrame:
    """Mean quality per quantile bucket of the score, the stand-in when no clusters exist."""
    binned = quantile_bins(scores, "quality_score", q, "cluster")
    return binned.groupBy("cluster").agg(F.avg("quality_score").alias("avg_quality"), F.count("*").alias("size"))


def quality_trend(scores: DataFrame, periods: int = 10) -> DataFrame:
    """Mean and deviation of the score over equal-count periods of the score order."""
    banded = row_bands(scores.select("channelId", "quality_score"), [F.desc("quality_score"), F.col("channelId")], periods, "period")
    return banded.groupBy("period").agg(F.avg("quality_score").alias("mean"), F.stddev_samp("quality_score").alias("std"))


def bot_rate_boxes(scores: DataFrame) -> DataFrame:
    """Box statistics of the bot rate per quality category, lowest category first."""
    known = scores.where(F.col("quality_category").isNotNull())
    probs = {0.0: "low", 0.25: "q1", 0.5: "median", 0.75: "q3", 1.0: "high"}
    found = quantiles(known, ["bot_rate"], list(probs), by=["quality_category"])
    wide = found.groupBy("quality_category").agg(
        *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in probs.items()]
    )
    sizes = known.groupBy("quality_category").agg(F.count("*").alias("n"))
    rank = F.array_position(F.array(*[F.lit(b) for b in BANDS]), F.col("quality_category"))
    return wide.join(sizes, "quality_category").orderBy(rank)


def _labels(tests: dict[str, Column]) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()])), ", ")


def risk_factors(scores: DataFrame, n: int = 5) -> DataFrame:
    """The lowest-scoring high-risk channels with what speaks against them."""
    factors = _labels(
        {
            "High bot rate": F.col("bot_rate") > 0.5,
            "Low volume": F.col("volume") < 10,
            "High fraud score": F.coalesce(F.col("fraud_score_avg"), F.lit(0.0)) > 0.5,
        }
    )
    return top(scores.where("high_risk"), "quality_score", n, "channelId", lowest=True).select(
        "channelId", "quality_score", "bot_rate", "volume", factors.alias("risk_factors")
    )


def strengths(scores: DataFrame, n: int = 5) -> DataFrame:
    """The best channels with what speaks for them."""
    found = _labels(
        {
            "Low bot rate": F.col("bot_rate") < 0.05,
            "High volume": F.col("volume") > 100,
            "Diverse IPs": F.coalesce(F.col("ip_diversity").cast("double"), F.lit(0.0)) > 0.5,
        }
    )
    return top(scores, "quality_score", n, "channelId").select(
        "channelId", "quality_score", "bot_rate", "volume", found.alias("strengths")
    )


def recommendations(scores: DataFrame, flags: DataFrame) -> DataFrame:
    """Counts behind the recommendations and the revenue at risk (0.1 per high-risk request)."""
    joined = with_anomaly_count(scores, flags)
    risky = F.when(F.col("high_risk"), F.col("volume")).otherwise(0)
    return joined.agg(
        F.count_if("high_risk").alias("block_or_investigate"),
        F.avg(F.when(F.col("high_risk"), F.col("bot_rate"))).alias("high_risk_bot_rate"),
        (F.sum(risky) * F.lit(0.1)).alias("revenue_at_risk"),
        F.count_if(F.col("overall_anomaly_count") > 0).alias("review_anomalous"),
        F.count_if(F.col("quality_category") == "Medium-Low").alias("improve_medium_low"),
        F.count_if(F.col("quality_category") == "Low").alias("consider_removal"),
    )


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, n) over equal widths between minimum and maximum; the top edge belongs to the last bin."""
    edges = df.agg(F.struct(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))).scalar()
    x = F.col(column).cast("double")
    place = F.floor(F.try_divide((x - F.col("_e.lo")) * bins, F.col("_e.hi") - F.col("_e.lo")))
    slot = F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int")
    return (
        df.where(F.col(column).isNotNull()).withColumn("_e", edges).groupBy(slot.alias("bin")).agg(F.count("*").alias("n"))
    )
