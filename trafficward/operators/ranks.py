"""Exact ranks, quantiles and cumulative counts without gathering a column in one task.

A single ordered window over a whole column would run in one task. Here each
distinct value first becomes one row with its frequency, the value range is cut
into bins at approximate quantiles, bin totals give every bin its offset, and the
running sum inside a bin starts from that offset. The cuts only steer the work;
the counts are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle


def cumulative(
    df: DataFrame, keys: Sequence[str], value: str, measures: dict[str, Column], bins: int = 128
) -> DataFrame:
    """Per key and distinct value: each measure, its sum before the value, and its key total."""
    keys = list(keys)
    names = list(measures)
    freq = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(*[F.sum(m).alias(n) for n, m in measures.items()])
    )
    probs = [i / bins for i in range(1, bins)]
    cuts = freq.groupBy(*keys).agg(F.percentile_approx(value, probs, 10 * bins).alias("_cuts"))
    binned = freq.join(cuts, keys).withColumn(
        "_bin", F.size(F.filter("_cuts", lambda e: e < F.col(value)))
    ).drop("_cuts")
    earlier = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = (
        binned.groupBy(*keys, "_bin")
        .agg(*[F.sum(n).alias(n) for n in names])
        .select(
            *keys,
            "_bin",
            *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_offset_{n}") for n in names],
            *[F.sum(n).over(whole).alias(f"total_{n}") for n in names],
        )
    )
    inside = Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return binned.join(offsets, [*keys, "_bin"]).select(
        *keys,
        value,
        *names,
        *[
            (F.coalesce(F.sum(n).over(inside), F.lit(0)) + F.col(f"_offset_{n}")).alias(f"before_{n}")
            for n in names
        ],
        *[f"total_{n}" for n in names],
    )


def melt(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long form (by…, column, value) of numeric columns; nulls left out."""
    wide = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns])
    return wide.unpivot(list(by), list(columns), "column", "value").where(F.col("value").isNotNull())


def quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact linearly interpolated quantiles: (by…, column, p, value)."""
    keys = [*by, "column"]
    ranked = cumulative(melt(df, columns, by), keys, "value", {"n": F.lit(1)})
    position = F.col("p") * (F.col("total_n") - 1)
    low = F.floor(position)
    upto = F.col("before_n") + F.col("n")
    holds = lambda rank: (F.col("before_n") <= rank) & (rank < upto)
    return (
        ranked.withColumn("p", F.explode(F.array([F.lit(float(p)) for p in probs])))
        .withColumn("_low", low)
        .withColumn("_part", position - low)
        .where(holds(F.col("_low")) | (holds(F.col("_low") + 1) & (F.col("_part") > 0)))
        .groupBy(*keys, "p")
        .agg(F.min("value").alias("_a"), F.max("value").alias("_b"), F.first("_part").alias("_part"))
        .select(*keys, "p", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).alias("value"))
    )


def quantile_struct(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> Column:
    """Scalar subquery: struct of arrays, one array of quantiles (in the order of probs) per column."""
    found = quantiles(df, columns, probs)
    pick = lambda c, p: F.max(F.when((F.col("column") == c) & (F.col("p") == float(p)), F.col("value")))
    return found.agg(
        F.struct(*[F.array(*[pick(c, p) for p in probs]).alias(c) for c in columns]).alias("_q")
    ).scalar()


def quantile(df: DataFrame, column: str, prob: float) -> Column:
    """Scalar subquery holding one exact quantile."""
    return quantiles(df, [column], [prob]).agg(F.max("value")).scalar()


def histogram_quantile(df: DataFrame, column: str, prob: float) -> Column:
    """Scalar subquery: exact quantile of a count column.

    The distinct values of counts that add up to N rows number at most sqrt(2N), so the
    frequency table, and with it the final aggregate, stays small.
    """
    freq = df.groupBy(column).agg(F.count("*").alias("_n"))
    return freq.agg(F.expr(f"percentile(`{column}`, {prob}D, _n)")).scalar()


def quantile_bins(df: DataFrame, column: str, q: int, name: str) -> DataFrame:
    """Right-closed quantile buckets 0…q-1; equal edges are merged, the lowest value included."""
    probs = [i / q for i in range(q + 1)]
    edges = (
        quantiles(df, [column], probs).agg(F.sort_array(F.collect_set("value")).alias("_edges")).scalar()
    )
    inner = lambda e: F.slice(e, 2, F.greatest(F.size(e) - 2, F.lit(0)))
    return (
        df.withColumn("_edges", edges)
        .withColumn(name, F.size(F.filter(inner(F.col("_edges")), lambda e: e < F.col(column))))
        .drop("_edges")
    )


def average_rank_share(df: DataFrame, column: str, weight: Column, name: str) -> DataFrame:
    """Distinct values of a column with their average rank over all rows, as a share of the rows."""
    ranked = cumulative(
        df.select(F.lit("all").alias("_all"), F.col(column), weight.alias("_w")),
        ["_all"],
        column,
        {"n": F.col("_w")},
    )
    rank = F.col("before_n") + (F.col("n") + 1) / F.lit(2.0)
    return ranked.select(column, (rank / F.col("total_n")).alias(name))


def row_positions(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Zero-based position of every row in a global sort, with the row total in `total_<name>`.

    The sorted rows are written once to the shared folder, which fixes their partitions; the
    position is then the row's place in its partition plus the rows of earlier partitions.
    """
    placed = settle(df.orderBy(*order)).withColumn("_id", F.monotonically_increasing_id())
    placed = placed.withColumns(
        {"_part": F.shiftright("_id", 33), "_row": F.col("_id").bitwiseAND(F.lit(2**33 - 1))}
    )
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per partition of the sort
    every = Window.orderBy("_part")
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("_n").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.sum("_n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(
            f"total_{name}"
        ),
    )
    return (
        placed.join(offsets, "_part")
        .withColumn(name, F.col("_row") + F.col("_offset"))
        .drop("_id", "_part", "_row", "_offset")
    )


def row_bands(df: DataFrame, order: Sequence[Column], bands: int, name: str) -> DataFrame:
    """Equal-count bands 1…bands along a unique ordering; the first bands take the remainder."""
    ranked = row_positions(df, order, "_at")
    position, whole = F.col("_at"), F.col("total__at")
    size = F.floor(whole / bands)
    extra = whole % bands
    longer = extra * (size + 1)
    band = F.when(position < longer, F.floor(position / (size + 1))).otherwise(
        extra + F.floor(F.try_divide(position - longer, size))
    )
    return ranked.withColumn(name, (band + 1).cast("int")).drop("_at", "total__at")
