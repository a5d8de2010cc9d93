"""The three batch jobs: channel scoring, row classification, traffic analysis."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import anomaly, channels, patterns, quality, report, similarity
from ..operators.classify import Thresholds, classification_summary, classify
from ..operators.clean import clean
from ..session import settle, side_by_side, written
from ..sources.traffic import require_columns
from .features import nested_features, row_features


@dataclass
class Results:
    """Named tables of a job."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def score_log(df: DataFrame, approximate: bool = False, contamination: float = 0.1) -> Results:
    """Features → channel scores → similarity → anomalies → report tables.

    The cleaned log with its row features and the channel tables are written once to the shared
    folder: scoring and all five anomaly families read them instead of the raw log, each the columns
    it needs. Scoring, clustering and the anomaly families do not need each other and run side by side.
    """
    rows = written(row_features(clean(require_columns(df))), "rows")
    metrics = settle(channels.quality_metrics(rows))

    def score() -> tuple[DataFrame, quality.Scorer]:
        scores, scorer = quality.score_channels(metrics, approximate=approximate)
        return settle(scores), scorer

    def cluster() -> DataFrame | None:
        points, columns = similarity.robust_points(settle(channels.channel_features(rows)))
        if not columns:
            return None
        points = settle(points)
        return similarity.kmeans(points, min(10, max(1, points.count() - 1)))[0]

    def flag() -> DataFrame:
        found = anomaly.detect(rows, contamination, approximate).complete()
        return settle(anomaly.canonical_flags(found, anomaly.channel_keys(rows)))

    (scores, scorer), clusters, flags = side_by_side(df.sparkSession, [score, cluster, flag])
    tables = {
        "metrics": metrics,
        "scores": scores,
        "importance": scorer.importance(df.sparkSession),
        "flags": flags,
        "kpis": report.kpis(scores, flags),
        "best_and_worst": report.best_and_worst(scores),
        "high_risk": report.high_risk_channels(scores),
        "most_anomalous": report.most_anomalous(flags),
    }
    if clusters is not None:
        tables["clusters"] = clusters
    return Results(tables)


def classify_log(
    df: DataFrame, scores: DataFrame, flags: DataFrame, thresholds: Thresholds = Thresholds(), level: str = "channel"
) -> Results:
    """Every log row with its class, and the summary."""
    rows = classify(require_columns(df), scores, flags, thresholds, level)
    return Results({"rows": rows, "summary": classification_summary(rows)})


def analyse_log(df: DataFrame) -> Results:
    """Pattern tables, closed-form channel quality, low scores, quality clusters and similarity."""
    from ..operators.density import dbscan

    rows = nested_features(row_features(clean(df)))
    scores = settle(channels.closed_form_quality(rows))
    parts = ["bot_ratio", "high_risk_ip_ratio", "datacenter_ratio", "anonymization_ratio", "temporal_anomaly_score"]
    points = similarity.to_points(quality.standard_scale(scores.fillna(0), parts), parts)
    profiles = similarity.scaled_profiles(settle(channels.profiles(rows)))
    return Results(
        {
            "hourly": patterns.hourly_pivot(rows),
            "weekday": patterns.weekday_pivot(rows),
            "devices": patterns.shares(rows, "device"),
            "devices_by_channel": patterns.shares(rows, "device", "channelId"),
            "countries": patterns.country_counts(rows),
            "cities": patterns.top_cities(rows),
            "browsers": patterns.browser_versions(rows),
            "scores": scores,
            "low_scores": channels.low_quality(scores),
            "clusters": dbscan(points, eps=0.5, min_samples=5),
            "most_similar": similarity.most_similar(profiles),
            "mean_similarity": similarity.mean_similarity(profiles),
        }
    )
