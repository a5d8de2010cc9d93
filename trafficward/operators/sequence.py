"""Time-ordered neighbours of a request within its entity, safe for hot entities.

A window partitioned by entity alone puts a hot address into one task. Here one range sort by
(entity, time) cuts the rows into parts of about equal size, so a hot entity spans as many parts
as its rows call for, even if all its requests fall into one second. Windows run inside
(part, entity); the few rows that a frame can reach across the border of a part are carried in
and dropped afterwards, so the result equals the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.common import as_int, seconds
from ..schema import TIE
from ..session import written


def with_neighbours(df: DataFrame, entity: str, before: int, after: int = 0, parts: int | None = None) -> tuple[DataFrame, WindowSpec]:
    """Rows plus carried rows (`_carry`), and the window to compute frames on.

    Frames may reach `before` rows back and `after` rows ahead. The sorted rows are written once,
    so that every reader sees the same `parts` (default: the session's shuffle partitions). Rows
    without an entity or a time are sorted apart: their values have to be overwritten by the caller.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = ["_orphan", entity, "date", TIE]
    marked = df.withColumn("_orphan", F.col(entity).isNull() | F.col("date").isNull())
    placed = marked.repartitionByRange(parts, *key).sortWithinPartitions(*key).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, "sequence").withColumns(
        {"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND(2**33 - 1), "_carry": F.lit(False)}
    ).drop("_at")

    # the rows next to a border: before + after of each part, at most
    sizes = placed.groupBy("_part").agg((F.max("_row") + 1).alias("_n"))
    near = placed.select("_part", "_row", *key).join(F.broadcast(sizes), "_part")
    near = near.where((F.col("_row") >= F.col("_n") - before) | (F.col("_row") < after))
    row = F.struct("_row", *key)
    borders = near.groupBy("_part").agg(
        F.array_sort(F.collect_list(F.when(F.col("_row") >= F.col("_n") - before, row))).alias("_tail"),
        F.array_sort(F.collect_list(F.when(F.col("_row") < after, row))).alias("_head"),
    )
    # one row per part meets in one task; a part may hold fewer rows than a frame reaches
    order = Window.orderBy("_part")
    history = F.flatten(F.collect_list("_tail").over(order.rowsBetween(-before, -1)))
    carried = F.slice(history, F.greatest(F.size(history) - before, F.lit(0)) + 1, before)
    if after:
        carried = F.concat(carried, F.slice(F.flatten(F.collect_list("_head").over(order.rowsBetween(1, after))), 1, after))
    extra = borders.select("_part", carried.alias("_rows")).select("_part", F.explode("_rows").alias("_r"))
    extra = extra.select("_part", *[F.col(f"_r.{c}").alias(c) for c in key], F.lit(True).alias("_carry"))
    rows = placed.drop("_row").unionByName(extra, allowMissingColumns=True)
    # parts are equally large, so dealing them out by range keeps tasks equally large
    window = Window.partitionBy("_part", entity, "_orphan").orderBy("date", TIE)
    return rows.repartitionByRange(parts, "_part"), window


def without_carried(df: DataFrame) -> DataFrame:
    return df.where(~F.col("_carry")).drop("_part", "_orphan", "_carry")


def add_gaps(df: DataFrame, entity: str, burst: str | None = None, first: int | None = 0) -> DataFrame:
    """Whole-second gap to the previous request of the entity and the velocity 1/(gap+1).

    First requests and rows without an entity get the gap `first`. With `burst` a flag of that name
    tells whether the last five gaps add up to less than five minutes (first request: 0).
    """
    rows, w = with_neighbours(df, entity, before=5 if burst else 1)
    stamp = F.unix_seconds(F.col("date").cast("timestamp"))
    lost = F.col(entity).isNull()
    start = F.lit(first).cast("bigint")
    gap = F.when(lost, start).otherwise(F.coalesce(stamp - F.lag(stamp).over(w), start))
    out = {f"{entity}_time_gap": gap}
    if burst:
        now = seconds(F.col("date"))
        # the last five gaps telescope to the distance from the request five back
        span = now - F.min(now).over(w.rowsBetween(-5, 0))
        has_previous = F.lag(now).over(w).isNotNull() & ~lost
        out[burst] = as_int(has_previous & (span < 300))
    rows = rows.withColumns(out)
    rows = rows.withColumn(f"{entity}_request_velocity", F.lit(1.0) / (F.col(f"{entity}_time_gap") + 1))
    return without_carried(rows)


def gaps(df: DataFrame, entity: str) -> DataFrame:
    """(entity, gap in seconds with the fraction) for every request that has a predecessor."""
    rows, w = with_neighbours(df.select(entity, "date", TIE), entity, before=1)
    now = seconds(F.col("date"))
    return (
        without_carried(rows.withColumn("gap", now - F.lag(now).over(w)))
        .where(F.col("gap").isNotNull() & F.col(entity).isNotNull())
        .select(entity, "gap")
    )


def rolling(df: DataFrame, entity: str, min_periods: int = 5) -> DataFrame:
    """Gap and its centred five-row rolling mean and sample deviation per entity."""
    rows, w = with_neighbours(df.select(entity, "date", TIE), entity, before=3, after=2)
    now = seconds(F.col("date"))
    rows = rows.withColumn("gap", now - F.lag(now).over(w))
    near = w.rowsBetween(-2, 2)
    enough = F.count("gap").over(near) >= min_periods
    rows = rows.withColumns(
        {
            "rolling_mean": F.when(enough, F.avg("gap").over(near)),
            "rolling_std": F.when(enough, F.stddev_samp("gap").over(near)),
            "_others": F.count("gap").over(near) - 1,
            "_sum": F.sum("gap").over(near) - F.col("gap"),
            "_square": F.sum(F.col("gap") * F.col("gap")).over(near) - F.col("gap") * F.col("gap"),
        }
    )
    return without_carried(rows).where(F.col(entity).isNotNull())


def bursts(df: DataFrame, entity: str, mode: str = "baseline") -> DataFrame:
    """Requests that follow unusually fast: (level, entity_id, burst_count, min_time_diff).

    `faithful` tests gap < mean - 2·std over a five-row frame that contains the gap itself;
    no five numbers can satisfy it, so it reports nothing. `baseline` compares with the mean
    and deviation of the other four rows of the frame.
    """
    rows = rolling(df, entity, min_periods=5)
    if mode == "faithful":
        # the margin keeps rounding noise of equal gaps from counting as a burst
        hit = F.col("gap") < F.col("rolling_mean") - 2 * F.col("rolling_std") - F.lit(1e-6)
    elif mode == "baseline":
        mean = F.col("_sum") / F.col("_others")
        spread = (F.col("_square") - F.col("_others") * mean * mean) / (F.col("_others") - 1)
        hit = (F.col("_others") == 4) & (F.col("gap") < mean - 2 * F.sqrt(F.greatest(spread, F.lit(0.0))))
    else:
        raise ValueError(f"unknown burst mode {mode!r}")
    return (
        rows.where(hit)
        .groupBy(F.col(entity).alias("entity_id"))
        .agg(F.count("*").alias("burst_count"), F.min("gap").alias("min_time_diff"))
        .select(F.lit(entity).alias("level"), "entity_id", "burst_count", "min_time_diff")
    )
