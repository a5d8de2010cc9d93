"""Feature plans: which column families are added, in which order, and where rows shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.address import add_address
from ..functions.agent import add_agent, add_parsed_agent
from ..functions.calendar import add_calendar
from ..functions.fraud import add_fraud
from ..functions.text import add_context, add_location, add_platform
from ..operators.entity import (
    add_bot_rate,
    add_entity_activity,
    add_ip_usage,
    add_volume,
    attach,
    channel_stats,
    combo_popularity,
    ip_countries,
)
from ..operators.sequence import add_gaps


def row_features(df: DataFrame) -> DataFrame:
    """Everything that needs one row only: no shuffle, and unused columns are pruned away."""
    for step in (add_calendar, add_address, add_agent, add_context, add_fraud):
        df = df.transform(step)
    return df


def nested_features(df: DataFrame) -> DataFrame:
    """Platform and location JSON and the parsed user agent."""
    for step in (add_platform, add_location, add_parsed_agent):
        df = df.transform(step)
    return df


def all_features(df: DataFrame) -> DataFrame:
    """Row features, entity activity, channel statistics, popularity, gaps and bursts."""
    df = row_features(df)
    # aggregates read the row features, never each other's joins
    stats, popularity, switches = channel_stats(df), combo_popularity(df), ip_countries(df)
    df = add_entity_activity(df)
    df = attach(df, stats, "channelId")
    df = attach(df, popularity, "device_browser_combo")
    df = attach(df, switches, "ip")
    df = add_gaps(df, "ip", burst="ip_burst_5min")
    return add_gaps(df, "userId")


def volume_features(df: DataFrame, approximate: bool = False) -> DataFrame:
    """The lighter set: address usage, bot rate and volume percentile per row."""
    return df.transform(lambda d: add_ip_usage(d, approximate)).transform(add_bot_rate).transform(
        lambda d: add_volume(d, approximate)
    )
