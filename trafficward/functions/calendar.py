"""Calendar features of one request time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import right_closed

# Day segments as right-closed hour bins.
SEGMENT_EDGES = [0, 6, 12, 18, 24]
SEGMENTS = ["night", "morning", "afternoon", "evening"]


def parts(ts: Column) -> dict[str, Column]:
    """Hour, Monday-based weekday, day of month, month, quarter, year."""
    return {
        "hour": F.hour(ts),
        "day_of_week": F.weekday(ts),
        "day_of_month": F.dayofmonth(ts),
        "month": F.month(ts),
        "quarter": F.quarter(ts),
        "year": F.year(ts),
    }


def periods(hour: Column, day_of_week: Column) -> dict[str, Column]:
    """0/1 flags for weekend, night, business hours, and the two peak-hour variants."""
    weekend = day_of_week >= 5
    working = hour.between(9, 17)
    return {
        "is_weekend": weekend.cast("int"),
        "is_night": ((hour >= 22) | (hour <= 6)).cast("int"),
        "is_business_hours": (working & ~weekend).cast("int"),
        "is_peak_hour": (working & ~weekend).cast("int"),
        "is_office_hour_any_day": working.cast("int"),
    }


def cycles(hour: Column, day_of_week: Column) -> dict[str, Column]:
    """Sine and cosine of the position in the day and in the week."""
    day = hour * F.lit(2.0) * F.pi() / F.lit(24.0)
    week = day_of_week * F.lit(2.0) * F.pi() / F.lit(7.0)
    return {
        "sin_hour": F.sin(day),
        "cos_hour": F.cos(day),
        "sin_day_of_week": F.sin(week),
        "cos_day_of_week": F.cos(week),
    }


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def segment(hour: Column) -> Column:
    return right_closed(hour, SEGMENT_EDGES, SEGMENTS, include_lowest=True)


def add_calendar(df: DataFrame) -> DataFrame:
    df = df.withColumns(parts(F.col("date")))
    hour, dow = F.col("hour"), F.col("day_of_week")
    return df.withColumns(
        {
            **periods(hour, dow),
            **cycles(hour, dow),
            "timestamp": epoch_seconds(F.col("date")),
            "time_segment": segment(hour),
        }
    )
