"""Cleaning, profiling and schema-level filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.common import as_int, count_where
from ..schema import BOOLEANS, TIE, numeric_columns


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Exact duplicates of the logged columns go; the technical row id does not make rows differ."""
    logged = [c for c in df.columns if c != TIE]
    return df.groupBy(*logged).agg(F.min(TIE).alias(TIE)) if TIE in df.columns else df.dropDuplicates()


def fill_flags(df: DataFrame) -> DataFrame:
    return df.fillna(False, subset=[c for c in BOOLEANS if c in df.columns])


def fill_zero(df: DataFrame, texts: bool = True) -> DataFrame:
    """Null → 0 in numeric, false in boolean and '0' in text columns."""
    out = df.fillna(0).fillna(False)
    return out.fillna("0") if texts else out


def drop_bad_ips(df: DataFrame) -> DataFrame:
    """Rows whose address is missing or spells nan, none or null in any case are dropped."""
    return df.where(F.col("ip").isNotNull() & ~F.col("ip").rlike("(?i)nan|none|null"))


def clean(df: DataFrame, distinct: bool = False) -> DataFrame:
    """Flags filled and bad addresses dropped; `distinct` adds the global duplicate removal."""
    return drop_bad_ips(fill_flags(drop_duplicates(df) if distinct else df))


def summary(df: DataFrame) -> DataFrame:
    """One row: size, date range, distinct counts and flag sums."""
    distinct = {
        "channels": "channelId",
        "publishers": "publisherId",
        "advertisers": "advertiserId",
        "countries": "country",
        "ips": "ip",
        "users": "userId",
    }
    flags = {
        "likely_bots": "isLikelyBot",
        "datacenter_ips": "isIpDatacenter",
        "anonymous_ips": "isIpAnonymous",
        "vpn_ips": "isIpVPN",
        "tor_ips": "isIpTOR",
    }
    return df.agg(
        F.count("*").alias("total_records"),
        F.date_format(F.min("date"), "yyyy-MM-dd HH:mm:ss").alias("date_start"),
        F.date_format(F.max("date"), "yyyy-MM-dd HH:mm:ss").alias("date_end"),
        *[F.count_distinct(F.col(c)).alias(n) for n, c in distinct.items()],
        *[count_where(F.col(c)).alias(n) for n, c in flags.items()],
    )


def value_counts(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """(value, n) of non-null values, most frequent first; ties by value."""
    counted = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count("*").alias("n"))
    )
    return counted.orderBy(F.desc("n"), "value").limit(limit) if limit else counted


def top_values(df: DataFrame) -> DataFrame:
    """Ten countries, five browsers and all devices, in one long table."""
    parts = [("country", 10), ("browser", 5), ("device", None)]
    out = None
    for column, limit in parts:
        part = value_counts(df, column, limit).select(F.lit(column).alias("field"), "value", "n")
        out = part if out is None else out.unionByName(part)
    return out


def missing_values(df: DataFrame) -> DataFrame:
    """(column, missing) for every column, from one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column", "missing")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Number of rows beyond the first of each set of equal rows."""
    logged = [c for c in df.columns if c != TIE]
    return (
        df.groupBy(*logged)
        .agg(F.count("*").alias("_n"))
        .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))
    )


def invalid_dates(df: DataFrame, column: str = "date") -> DataFrame:
    return df.agg(
        F.count_if(F.try_to_timestamp(F.col(column).cast("string")).isNull()).alias("invalid_dates")
    )


def heavy_hitters(df: DataFrame, ip_limit: int = 1000, user_limit: int = 100) -> DataFrame:
    """How many addresses and users exceed their request limits."""
    out = None
    for column, limit, name in [("ip", ip_limit, "high_volume_ips"), ("userId", user_limit, "high_volume_users")]:
        heavy = (
            df.where(F.col(column).isNotNull())
            .groupBy(column)
            .agg(F.count("*").alias("_n"))
            .agg(F.count_if(F.col("_n") > limit).alias("n"))
            .select(F.lit(name).alias("pattern"), "n")
        )
        out = heavy if out is None else out.unionByName(heavy)
    return out


def risk_summary(df: DataFrame) -> DataFrame:
    """Counts and shares of high-risk addresses and bots (needs `is_high_risk_ip`)."""
    return df.agg(
        F.count("*").alias("total_records"),
        count_where(F.col("is_high_risk_ip")).alias("high_risk_ips"),
        count_where(F.col("isLikelyBot")).alias("bot_traffic"),
        F.coalesce(F.avg(as_int(F.col("is_high_risk_ip"))), F.lit(0.0)).alias("high_risk_ratio"),
        F.coalesce(F.avg(as_int(F.col("isLikelyBot"))), F.lit(0.0)).alias("bot_ratio"),
    )


def hourly_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("hour").agg(F.count("*").alias("n"))


def column_variances(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Sample variance of each numeric column: one row comes back to plan the projection."""
    row = df.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in columns]).first()
    return {c: (row[c] if row[c] is not None else 0.0) for c in columns}


def varying_columns(df: DataFrame, key: str, threshold: float = 0.0, keep_all: bool = True) -> list[str]:
    """Numeric columns with variance above the threshold; all of them if none passes."""
    columns = numeric_columns(df, skip=(key, TIE))
    if not columns:
        return []
    variances = column_variances(df, columns)
    kept = [c for c in columns if variances[c] > threshold]
    return kept or (columns if keep_all else [])


def numeric_only(df: DataFrame, key: str) -> DataFrame:
    """The key and the numeric columns."""
    return df.select(key, *[f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != key])
