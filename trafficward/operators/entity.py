"""Entity statistics attached to rows.

Counts come from partial aggregates joined back on (entity, hour). The hour in the
join key spreads a hot entity over many partitions, and adaptive skew joins can split
what is left; a window over the entity could not be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.common import as_int, hash01
from ..schema import ENTITIES, TIE
from .ranks import average_rank_share, quantile_bins, quantiles


MEASURES = ("daily", "hourly", "countries", "hours")


def _hourly(known: DataFrame, entity: str) -> DataFrame:
    return known.groupBy(entity, F.date_trunc("hour", "date").alias("_slot")).agg(
        F.count("date").alias("_n"), F.first(F.hour("date").cast("double")).alias("_hour")
    )


def _hour_spread(hourly: DataFrame, entity: str) -> DataFrame:
    """(entity, hour_std): sample deviation of the hour of day, from counts per hour slot."""
    n, h = F.col("_n"), F.col("_hour")
    spread = hourly.groupBy(entity).agg(
        F.sum(n).alias("_t"), F.sum(n * h).alias("_s"), F.sum(n * h * h).alias("_q")
    )
    variance = F.try_divide(
        F.col("_q") - F.col("_s") * F.col("_s") / F.nullif(F.col("_t"), F.lit(0)), F.col("_t") - 1
    )
    return spread.select(
        entity, F.coalesce(F.sqrt(F.greatest(variance, F.lit(0.0))), F.lit(0.0)).alias(f"{entity}_hour_std")
    )


def entity_activity(df: DataFrame, entity: str, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """The measures asked for: per entity and hour slot if requests per day or hour are among them, else per entity."""
    known = df.where(F.col(entity).isNotNull())
    tables = []
    if "countries" in measures:
        tables.append(known.groupBy(entity).agg(F.count_distinct("country").alias(f"{entity}_country_diversity")))
    hourly = _hourly(known, entity)
    if "hours" in measures:
        tables.append(_hour_spread(hourly, entity))
    if {"daily", "hourly"} & set(measures):
        dated = F.col("_slot").isNotNull()
        day = Window.partitionBy(entity, F.to_date("_slot"))
        counts = {
            "daily": F.when(dated, F.sum("_n").over(day)).alias(f"{entity}_daily_requests"),
            "hourly": F.when(dated, F.col("_n")).alias(f"{entity}_hourly_requests"),
        }
        tables.insert(0, hourly.select(entity, "_slot", *[c for m, c in counts.items() if m in measures]))
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, entity)
    return out


def add_entity_activity(df: DataFrame, entities: list[str] = ENTITIES, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """The activity columns asked for of every entity, one join each; null entities get nulls."""
    log = df
    for entity in entities:
        found = entity_activity(log.select(entity, "date", "country"), entity, measures).withColumnRenamed(entity, "_entity")
        if "_slot" in found.columns:
            rows = df.withColumn("_slot", F.date_trunc("hour", "date"))
            match = (F.col(entity) == F.col("_entity")) & F.col("_slot").eqNullSafe(F.col("_at"))
            df = rows.join(found.withColumnRenamed("_slot", "_at"), match, "left").drop("_slot", "_entity", "_at")
        else:
            df = df.join(found, F.col(entity) == F.col("_entity"), "left").drop("_entity")
    return df


def channel_stats(df: DataFrame) -> DataFrame:
    """Bot mean and count, diversities and hour deviation per channel, rounded to four places."""
    return (
        df.where(F.col("channelId").isNotNull())
        .groupBy("channelId")
        .agg(
            F.bround(F.avg(F.col("isLikelyBot").cast("double")), 4).alias("channel_isLikelyBot_mean"),
            F.count("isLikelyBot").alias("channel_isLikelyBot_count"),
            F.count_distinct("country").alias("channel_country_nunique"),
            F.count_distinct("browser").alias("channel_browser_nunique"),
            F.count_distinct("device").alias("channel_device_nunique"),
            F.bround(F.stddev_samp("hour"), 4).alias("channel_hour_std"),
        )
    )


def attach(df: DataFrame, stats: DataFrame, on: str) -> DataFrame:
    """Left join of an aggregate onto rows."""
    return df.join(stats, on, "left")


def combo_popularity(df: DataFrame) -> DataFrame:
    return df.groupBy("device_browser_combo").agg(F.count("*").alias("device_browser_popularity"))


def ip_countries(df: DataFrame) -> DataFrame:
    """Countries beyond the first per address."""
    return (
        df.where(F.col("ip").isNotNull())
        .groupBy("ip")
        .agg((F.count_distinct("country") - 1).alias("ip_country_switches"))
    )


def add_ip_usage(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Request count of the address, and the channel's distinct addresses per request."""
    distinct = F.approx_count_distinct("ip", 0.01) if approximate else F.count_distinct("ip")
    by_ip = df.groupBy("ip").agg(F.count("*").alias("ip_frequency"))
    by_channel = df.groupBy("channelId").agg(
        (distinct / F.count("*")).alias("channel_ip_diversity")
    )
    return df.join(by_ip, "ip", "left").join(by_channel, "channelId", "left")


def add_bot_rate(df: DataFrame) -> DataFrame:
    rates = df.groupBy("channelId").agg(F.avg(as_int(F.col("isLikelyBot")).cast("double")).alias("channel_bot_rate"))
    return df.withColumn("is_bot", as_int(F.col("isLikelyBot"))).join(rates, "channelId", "left")


def add_volume(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Channel volume and its percentile over rows (average rank), or its decile."""
    volumes = df.where(F.col("channelId").isNotNull()).groupBy("channelId").agg(F.count("*").alias("channel_volume"))
    if approximate:
        rows = df.join(volumes, "channelId", "left")
        return quantile_bins(rows, "channel_volume", 10, "volume_percentile")
    # ranks are taken over rows: every channel weighs its own volume
    shares = average_rank_share(volumes, "channel_volume", F.col("channel_volume"), "volume_percentile")
    return df.join(volumes.join(shares, "channel_volume"), "channelId", "left")


def add_global_stats(df: DataFrame, column: str, prefix: str, sample: int | None = None) -> DataFrame:
    """Mean and sample deviation of a column on every row, optionally from a hashed sample."""
    base = df
    if sample:
        base = df.select(column, TIE).orderBy(hash01(F.col(TIE)), TIE).limit(sample)
    stats = base.agg(F.struct(F.avg(column).alias("m"), F.stddev_samp(column).alias("s"))).scalar()
    return (
        df.withColumn("_stats", stats)
        .withColumns({f"{prefix}_mean": F.col("_stats.m"), f"{prefix}_std": F.col("_stats.s")})
        .drop("_stats")
    )


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, mean, std, median) with the population deviation and the exact median."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    moments = long.groupBy("column").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    medians = quantiles(df, columns, [0.5]).select("column", F.col("value").alias("median"))
    return moments.join(medians, "column", "left")
