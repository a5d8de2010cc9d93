"""Pattern tables: counts and shares by time, device, place and browser, kept in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.calendar import SEGMENTS
from .clean import value_counts


def pivot_counts(df: DataFrame, key: str, column: str, values: list, prefix: str) -> DataFrame:
    """One count column per listed value, 0 where a key never shows it."""
    counted = df.where(F.col(key).isNotNull()).groupBy(key).pivot(column, values).count().fillna(0)
    return counted.withColumnsRenamed({str(v): f"{prefix}{v}" for v in values})


def hourly_pivot(df: DataFrame, key: str = "channelId") -> DataFrame:
    return pivot_counts(df, key, "hour", list(range(24)), "hour_")


def weekday_pivot(df: DataFrame, key: str = "channelId") -> DataFrame:
    return pivot_counts(df, key, "day_of_week", list(range(7)), "dow_")


def segment_pivot(df: DataFrame, key: str = "channelId") -> DataFrame:
    return pivot_counts(df, key, "time_segment", SEGMENTS, "segment_")


def shares(df: DataFrame, value: str, within: str | None = None) -> DataFrame:
    """Count and share of each value, overall or within a key.

    The share divides by a sum over the small counted table, not over the rows.
    """
    keys = [within] if within else []
    rows = df.where(F.col(value).isNotNull())
    if within:
        rows = rows.where(F.col(within).isNotNull())
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    if within:
        whole = F.sum("n").over(Window.partitionBy(within))
        return counts.withColumn("share", F.col("n") / whole)
    return counts.withColumn("share", F.col("n") / rows.agg(F.count("*")).scalar())


def country_counts(df: DataFrame) -> DataFrame:
    return value_counts(df, "country")


def top_cities(df: DataFrame, limit: int = 50) -> DataFrame:
    return value_counts(df, "city_name", limit)


def timezone_counts(df: DataFrame) -> DataFrame:
    return value_counts(df, "timezone")


def country_diversity(df: DataFrame) -> DataFrame:
    """Countries per channel, most diverse first."""
    return (
        df.where(F.col("channelId").isNotNull())
        .groupBy("channelId")
        .agg(F.count_distinct("country").alias("country_diversity"))
        .orderBy(F.desc("country_diversity"), "channelId")
    )


def browser_versions(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("browser").isNotNull() & F.col("browserMajorVersion").isNotNull())
        .groupBy("browser", "browserMajorVersion")
        .agg(F.count("*").alias("n"))
    )


def family_counts(df: DataFrame) -> DataFrame:
    """Counts of parsed browser families and operating systems in one table."""
    browsers = value_counts(df, "ua_browser_family").select(F.lit("browser_family").alias("field"), "value", "n")
    systems = value_counts(df, "os_name").select(F.lit("os_name").alias("field"), "value", "n")
    return browsers.unionByName(systems)


def channel_country_counts(df: DataFrame) -> DataFrame:
    """Long (channelId, country, cnt)."""
    return (
        df.where(F.col("channelId").isNotNull() & F.col("country").isNotNull())
        .groupBy("channelId", "country")
        .agg(F.count("*").alias("cnt"))
    )


def device_browser_pivot(df: DataFrame, values: list[str] | None = None) -> DataFrame:
    """Counts per channel of every device-browser pair; without `values` the pairs are looked up first."""
    pairs = df.where(
        F.col("channelId").isNotNull() & F.col("device").isNotNull() & F.col("browser").isNotNull()
    ).withColumn("_pair", F.concat(F.lit("dev_"), F.col("device"), F.lit("_br_"), F.col("browser")))
    grouped = pairs.groupBy("channelId")
    pivoted = grouped.pivot("_pair", values) if values else grouped.pivot("_pair")
    return pivoted.count().fillna(0)


def merge_counts(parts: list[DataFrame], keys: list[str], measures: list[str]) -> DataFrame:
    """Add up partial count tables of the same shape (ratios have to be formed afterwards)."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def distinct_sketches(df: DataFrame, keys: list[str], columns: list[str], precision: int = 12) -> DataFrame:
    """Keys and one mergeable sketch (`<column>_sketch`) of the distinct non-null values of each column.

    Sketches of parts can be merged in any order, unlike distinct counts. The relative standard
    error is about 0.83 / sqrt(2**precision) (1.3 % by default); small sets are counted exactly.
    """
    return df.groupBy(*keys).agg(*[F.hll_sketch_agg(c, precision).alias(f"{c}_sketch") for c in columns])


def merge_sketches(parts: list[DataFrame], keys: list[str], columns: list[str]) -> DataFrame:
    """The sketches of partial tables merged per key, as if all rows had been read at once."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy(*keys).agg(*[F.hll_union_agg(f"{c}_sketch").alias(f"{c}_sketch") for c in columns])


def distinct_estimates(sketches: DataFrame, columns: list[str]) -> DataFrame:
    """Each sketch replaced by its estimated number of distinct values, under the column's name."""
    kept = [c for c in sketches.columns if c not in {f"{c}_sketch" for c in columns}]
    return sketches.select(*kept, *[F.hll_sketch_estimate(f"{c}_sketch").alias(c) for c in columns])
