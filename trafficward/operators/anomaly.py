"""The five anomaly families and their combination per channel."""

from __future__ import annotations

import logging
from collections.abc import Callable
from decimal import Decimal
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import settle, side_by_side
from ..schema import ANOMALY_FLAGS, numeric_columns
from . import channels as ch
from . import detectors as det
from .clean import varying_columns
from .patterns import channel_country_counts, device_browser_pivot
from .quality import robust_scale, standard_scale
from .ranks import histogram_quantile
from .sequence import bursts
from .similarity import to_points

log = logging.getLogger(__name__)


def channel_keys(df: DataFrame) -> DataFrame:
    return df.where(F.col("channelId").isNotNull()).select("channelId").distinct()


def _shares(columns: list[str]) -> Column:
    """Array of the columns divided by their sum; zeros for an empty row."""
    whole = sum((F.col(c) for c in columns), F.lit(0))
    return F.array(*[F.coalesce(F.try_divide(F.col(c).cast("double"), whole.cast("double")), F.lit(0.0)) for c in columns])


def hourly_anomalies(counts: DataFrame, contamination: float = 0.1, trees: int = 100) -> DataFrame:
    """Isolation forest over the 24 hourly shares."""
    points = counts.select(F.col("channelId").alias("id"), _shares([f"hour_{h}" for h in range(24)]).alias("vec"))
    found = det.isolation_forest(points, contamination, trees, "hourly_anomaly")
    return found.select(F.col("id").alias("channelId"), "hourly_anomaly", "hourly_anomaly_score")


def daily_anomalies(counts: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Largest population z-score among the seven weekday shares of a channel.

    Shares and counts have the same z-scores. With S the sum of the counts, (7x - S)² and 7·Σx² - S² are whole
    numbers whose ratio is z², so a score that equals the threshold is never taken for a larger one.
    """
    whole = F.array(*[F.coalesce(F.col(f"dow_{d}"), F.lit(0)).cast("decimal(18,0)") for d in range(7)])
    add = lambda values, kind: F.aggregate(values, F.lit(0).cast(kind), lambda a, x: (a + x).cast(kind))
    parts = counts.select("channelId", whole.alias("_x")).withColumn("_sum", add("_x", "decimal(18,0)"))
    square = F.transform("_x", lambda x: (x * x).cast("decimal(36,0)"))
    variance = F.lit(7) * add(square, "decimal(36,0)") - F.col("_sum") * F.col("_sum")
    apart = F.transform("_x", lambda x: (F.lit(7) * x - F.col("_sum")).cast("decimal(19,0)"))
    parts = parts.withColumns({"_v": variance.cast("decimal(38,0)"), "_far": F.array_max(F.transform(apart, F.abs))})
    far = (F.col("_far") * F.col("_far")).cast("decimal(38,0)")
    z = F.coalesce(F.try_divide(F.col("_far").cast("double"), F.sqrt(F.col("_v").cast("double"))), F.lit(0.0))
    limit = F.lit(Decimal(str(threshold)) ** 2)
    above = (F.col("_v") > 0) & (far > (limit * F.col("_v")))
    return parts.withColumn("daily_max_z_score", z).select("channelId", above.alias("daily_anomaly"), "daily_max_z_score")


def top_entities(df: DataFrame, column: str, n: int = 10000) -> DataFrame:
    """The n most frequent values of a column, ties by value."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("requests"))
        .orderBy(F.desc("requests"), column)
        .limit(n)
    )


def burst_anomalies(df: DataFrame, mode: str = "baseline", approximate: bool = False, n: int = 10000) -> DataFrame:
    """Burst rows of channels and addresses; `approximate` looks at the busiest n of each only."""
    out = None
    for entity in ["channelId", "ip"]:
        rows = df
        if approximate:
            rows = df.join(top_entities(df, entity, n).select(entity), entity, "left_semi")
        found = bursts(rows, entity, mode)
        out = found if out is None else out.unionByName(found)
    return out


def busy_channels(df: DataFrame, min_volume: int = 10) -> DataFrame:
    """Rows of channels with enough requests."""
    counts = df.groupBy("channelId").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_volume)
    return df.join(counts.select("channelId"), "channelId", "left_semi")


def _neutral(kind: T.DataType, column: Column) -> Column:
    if kind == T.BooleanType():
        return F.coalesce(column, F.lit(False))
    if isinstance(kind, T.NumericType):
        return F.coalesce(column, F.lit(0).cast(kind))
    return column


def combine(parts: list[DataFrame], key: str = "channelId") -> DataFrame:
    """Full outer join of detector tables; missing flags read false and numbers 0."""
    joined = parts[0]
    for part in parts[1:]:
        joined = joined.join(part, key, "full_outer")
    kinds = {f.name: f.dataType for f in joined.schema}
    return joined.select(key, *[_neutral(kinds[c], F.col(c)).alias(c) for c in joined.columns if c != key])


def with_defaults(found: DataFrame, keys: DataFrame, key: str = "channelId") -> DataFrame:
    """Adds default rows (false / 0) for keys the detector did not see."""
    kinds = {f.name: f.dataType for f in found.schema}
    absent = keys.join(found.select(key), key, "left_anti")
    rows = absent.select(key, *[_neutral(kinds[c], F.lit(None).cast(kinds[c])).alias(c) for c in found.columns if c != key])
    return found.unionByName(rows)


def temporal_anomalies(
    df: DataFrame, contamination: float = 0.1, trees: int = 100, approximate: bool = False, min_volume: int = 10, mode: str = "baseline"
) -> DataFrame:
    """Hourly, daily and burst findings per channel (rows need hour and day_of_week).

    `approximate` skips channels below `min_volume` and gives them default rows.
    """
    rows = busy_channels(df, min_volume) if approximate else df
    counts = ch.time_counts(rows)
    burst = (
        burst_anomalies(rows, mode, approximate)
        .where(F.col("level") == "channelId")
        .select(F.col("entity_id").alias("channelId"), "burst_count", "min_time_diff")
    )
    combined = combine([hourly_anomalies(counts, contamination, trees), daily_anomalies(counts), burst])
    return with_defaults(combined, channel_keys(df)) if approximate else combined


def ip_geography(df: DataFrame) -> DataFrame:
    """Requests from addresses seen in several countries, per channel; flags the top tenth."""
    multi = (
        df.where(F.col("ip").isNotNull())
        .groupBy("ip")
        .agg(F.count_distinct("country").alias("_c"))
        .where(F.col("_c") > 1)
        .select("ip")
    )
    used = df.join(multi, "ip", "left_semi").groupBy("channelId").agg(F.count("*").alias("_used"))
    base = df.where(F.col("channelId").isNotNull()).groupBy("channelId").agg(
        F.count_distinct("country").alias("country_diversity")
    )
    counted = base.join(used, "channelId", "left").select(
        "channelId", F.coalesce("_used", F.lit(0)).alias("multi_country_ips"), "country_diversity"
    )
    limit = histogram_quantile(counted, "multi_country_ips", 0.9)
    return counted.withColumn("ip_geo_anomaly", F.col("multi_country_ips") > limit)


def _pivot_points(pivoted: DataFrame) -> DataFrame:
    columns = [c for c in pivoted.columns if c != "channelId"]
    return to_points(standard_scale(pivoted, columns), columns)


def geographic_anomalies(df: DataFrame, contamination: float = 0.1, trees: int = 100) -> DataFrame:
    """Isolation forest over standardised country counts, country shape, and address geography."""
    pivoted = channel_country_counts(df).groupBy("channelId").pivot("country").sum("cnt").fillna(0)
    found = det.isolation_forest(_pivot_points(pivoted), contamination, trees, "geo_anomaly")
    forest = found.select(
        F.col("id").alias("channelId"), "geo_anomaly_score", F.col("geo_anomaly").alias("geo_is_anomaly")
    )
    shape = ch.country_shape(df).select("channelId", "country_diversity", "dominant_country_pct")
    return forest.join(shape, "channelId").join(ip_geography(df).drop("country_diversity"), "channelId", "left")


def device_features(df: DataFrame) -> DataFrame:
    """Device-browser counts, agent patterns and version patterns for every channel; null → 0."""
    blocks = [device_browser_pivot(df), ch.agent_patterns(df), ch.version_patterns(df)]
    joined = channel_keys(df)
    for block in blocks:
        joined = joined.join(block, "channelId", "left")
    return joined.fillna(0)


def _votes(points: DataFrame, parts: dict[str, DataFrame], prefix: str) -> DataFrame:
    """One flag column per detector and the two-vote ensemble."""
    joined = points.select(F.col("id").alias("channelId"))
    flags = []
    for name, found in parts.items():
        flag = f"{prefix}_{name}_anomaly"
        joined = joined.join(found.toDF("channelId", flag), "channelId", "left")
        flags.append(flag)
    filled = joined.select("channelId", *[F.coalesce(F.col(f), F.lit(False)).alias(f) for f in flags])
    votes = sum((F.col(f).cast("int") for f in flags), F.lit(0))
    return filled.withColumn(f"{prefix}_anomaly_ensemble", votes >= 2)


def device_anomalies(df: DataFrame, contamination: float = 0.1, trees: int = 100) -> DataFrame:
    """Two of three votes of isolation forest, local outlier factor and one-class machine."""
    from ..session import settle

    features = settle(device_features(df))
    columns = varying_columns(features, "channelId", 0.0, keep_all=False)
    if not columns:
        return features.select("channelId", F.lit(False).alias("device_anomaly_ensemble"))
    points = settle(to_points(robust_scale(features, columns), columns))
    parts = {
        "isolation_forest": det.isolation_forest(points, contamination, trees).select("id", "anomaly"),
        "lof": det.local_outlier_factor(points, 20, contamination).select("id", "lof_anomaly"),
        "one_class_svm": det.one_class_svm(points, contamination).select("id", "svm_anomaly"),
    }
    return _votes(points, parts, "device")


def behavioural_anomalies(df: DataFrame, contamination: float = 0.1, trees: int = 100) -> DataFrame:
    """Two of three votes of isolation forest, elliptic envelope and one-class machine."""
    from ..session import settle

    features = settle(ch.behaviour(df))
    columns = numeric_columns(features, skip=("channelId",))
    points = settle(to_points(standard_scale(features, columns), columns))
    parts = {
        "isolation_forest": det.isolation_forest(points, contamination, trees).select("id", "anomaly"),
        "elliptic_envelope": det.elliptic_envelope(points, contamination).select("id", "envelope_anomaly"),
        "one_class_svm": det.one_class_svm(points, contamination).select("id", "svm_anomaly"),
    }
    return _votes(points, parts, "behavioral")


def suspicious_ips(df: DataFrame, share: float = 0.95) -> DataFrame:
    """Addresses with more requests than the given quantile of per-address counts."""
    counts = (
        df.where(F.col("ip").isNotNull())
        .groupBy("ip")
        .agg(F.count("*").alias("requests_per_ip"), F.count_distinct("channelId").alias("channels_per_ip"))
    )
    return counts.where(F.col("requests_per_ip") > histogram_quantile(counts, "requests_per_ip", share))


def volume_features(df: DataFrame) -> DataFrame:
    """Requests, distinct addresses and users, and requests from suspicious addresses per channel."""
    base = df.where(F.col("channelId").isNotNull()).groupBy("channelId").agg(
        F.count("date").alias("total_requests"),
        F.count_distinct("ip").alias("unique_ips"),
        F.count_distinct("userId").alias("unique_users"),
    )
    flooded = (
        df.join(suspicious_ips(df).select("ip"), "ip", "left_semi")
        .groupBy("channelId")
        .agg(F.count("*").alias("suspicious_ip_requests"))
    )
    return base.join(flooded, "channelId", "left").fillna(0, subset=["suspicious_ip_requests"])


def volume_anomalies(df: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Population z-score above the threshold on any of the four volume measures."""
    measures = ["total_requests", "unique_ips", "unique_users", "suspicious_ip_requests"]
    scored = standard_scale(volume_features(df), measures)
    return scored.select("channelId", *[(F.abs(F.col(m)) > threshold).alias(f"{m}_anomaly") for m in measures])


def hourly_traffic_anomalies(df: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Hours whose total traffic deviates by more than the threshold (24 rows at most)."""
    counts = df.groupBy("hour").agg(F.count("*").alias("traffic_count"))
    stats = counts.agg(
        F.struct(F.avg("traffic_count").alias("m"), F.stddev_pop("traffic_count").alias("s"))
    ).scalar()
    z = F.coalesce(F.try_divide(F.abs(F.col("traffic_count") - F.col("_s.m")), F.col("_s.s")), F.lit(0.0))
    return (
        counts.withColumn("_s", stats)
        .withColumn("z_score", z)
        .select("hour", "traffic_count", "z_score", (F.col("z_score") > threshold).alias("is_anomaly"))
    )


# How each family's table yields its canonical flag.
CANONICAL: dict[str, tuple[str, list[str]]] = {
    "temporal": ("temporal_anomaly", ["temporal_anomaly", "hourly_anomaly", "daily_anomaly"]),
    "geographic": ("geographic_anomaly", ["geo_anomaly", "geographic_anomaly", "geo_is_anomaly"]),
    "device": ("device_anomaly", ["device_anomaly_ensemble", "device_anomaly"]),
    "behavioral": ("behavioral_anomaly", ["behavioral_anomaly_ensemble", "behavioral_anomaly"]),
    "volume": (
        "volume_anomaly",
        [
            "volume_anomaly",
            "total_requests_anomaly",
            "unique_ips_anomaly",
            "unique_users_anomaly",
            "suspicious_ip_requests_anomaly",
        ],
    ),
}


def overlay(base: DataFrame, new: DataFrame, column: str, key: str = "channelId") -> DataFrame:
    """Non-null values of `new` replace the column of `base`."""
    fresh = new.select(key, F.col(column).alias("_new"))
    return base.join(fresh, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def canonical_flags(results: dict[str, DataFrame], keys: DataFrame) -> DataFrame:
    """Five flags for every channel of the log or of any detector, their count and the ≥2 flag.

    Any temporal or volume sign raises its family; families without a result stay false, those
    that failed (see `detect`) are null and not counted, and the ≥2 flag is null where they could raise it.
    """
    failed = {CANONICAL[f][0] for f in getattr(results, "failed", {})}

    def votes(rows: DataFrame, flag: str | None, raised: Column) -> DataFrame:
        return rows.select("channelId", *[(raised if f == flag else F.lit(False)).alias(f) for f in ANOMALY_FLAGS])

    stacked = votes(keys, None, F.lit(False))
    for family, found in results.items():
        flag, candidates = CANONICAL[family]
        present = [c for c in candidates if c in found.columns]
        if family in ("geographic", "device", "behavioral"):
            present = present[:1]
        raised = F.lit(False)
        for c in present:
            raised = raised | F.coalesce(F.col(c), F.lit(False))
        stacked = stacked.unionByName(votes(found, flag, raised))
    # one aggregate overlays every family's flags on the default row of each channel
    table = stacked.groupBy("channelId").agg(
        *[(F.lit(None).cast("boolean") if f in failed else F.bool_or(f)).alias(f) for f in ANOMALY_FLAGS]
    )
    count = sum((F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in ANOMALY_FLAGS), F.lit(0))
    raised = F.when(count >= 2, True).when(count + len(failed) < 2, False)
    return table.withColumn("overall_anomaly_count", count).withColumn("overall_anomaly_flag", raised)


def wide_flags(results: list[DataFrame]) -> DataFrame:
    """Outer join of every detector column; counts all boolean columns named *anomaly*."""
    joined = combine(results)
    flags = [
        f.name
        for f in joined.schema
        if "anomaly" in f.name and "overall" not in f.name and "_score" not in f.name and f.dataType == T.BooleanType()
    ]
    count = sum((F.col(c).cast("int") for c in flags), F.lit(0))
    return joined.withColumn("overall_anomaly_count", count).withColumn(
        "overall_anomaly_flag", F.col("overall_anomaly_count") >= 2
    )


class DetectionError(RuntimeError):
    """Families of anomalies that gave no result."""


class Findings(dict):
    """Results per family; `failed` names the families without one, and why."""

    failed: dict[str, str]

    def complete(self) -> Findings:
        """These results, if no family failed: a table of flags must not pass for one of all five."""
        if self.failed:
            raise DetectionError("; ".join(f"{name}: {why}" for name, why in self.failed.items()))
        return self


def detect(df: DataFrame, contamination: float = 0.1, approximate: bool = False) -> Findings:
    """Run the five families to the end, each on its own, side by side.

    One that fails, when planned or when run, is logged and named in `failed`; the others
    stand, and `canonical_flags` leaves its flag null. `complete()` raises what failed.
    """
    trees = 50 if approximate else 100
    families: dict[str, Callable[[], DataFrame]] = {
        "temporal": lambda: temporal_anomalies(df, contamination, trees, approximate),
        "geographic": lambda: geographic_anomalies(df, contamination, trees),
        "device": lambda: device_anomalies(df, contamination, trees),
        "behavioral": lambda: behavioural_anomalies(df, contamination, trees),
        "volume": lambda: volume_anomalies(df),
    }

    def attempt(name: str) -> DataFrame | str:
        try:
            return settle(families[name]())
        except Exception as error:  # noqa: BLE001 - the other families must still report
            log.exception("%s anomaly detection failed", name)
            return f"{type(error).__name__}: {error}"

    outcomes = dict(zip(families, side_by_side(df.sparkSession, [partial(attempt, name) for name in families])))
    results = Findings({name: found for name, found in outcomes.items() if not isinstance(found, str)})
    results.failed = {name: error for name, error in outcomes.items() if isinstance(error, str)}
    return results
