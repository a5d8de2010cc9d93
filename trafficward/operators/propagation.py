"""Label propagation and spreading over the nearest-neighbour graph by repeated joins."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .neighbours import nearest_neighbours

CLASSES = [1, 2, 3, 4]

log = logging.getLogger(__name__)


def propagate(
    df: DataFrame,
    method: str = "propagation",
    neighbours: int = 7,
    alpha: float = 0.8,
    max_rounds: int = 1000,
    tolerance: float = 1e-3,
) -> DataFrame:
    """(id, label) for rows with id, vec and a partly null class label.

    A point is its own first neighbour, as in a graph built on the training points.
    `propagation` averages the neighbours' class shares and keeps given labels fixed;
    `spreading` mixes alpha of the normalised neighbourhood with the given labels.
    Stops when the total change falls below the tolerance.
    """
    shares = [f"c{c}" for c in CLASSES]
    given = df.select(
        F.col("id").cast("string").alias("id"),
        F.col("label").isNotNull().alias("fixed"),
        *[F.when(F.col("label") == c, 1.0).otherwise(0.0).alias(f"y{c}") for c in CLASSES],
    )
    given = settle(given)
    if method == "propagation" and given.where(~F.col("fixed")).isEmpty():
        # every label is clamped: propagation cannot change anything
        return df.select(F.col("id").cast("string").alias("id"), "label")
    links = nearest_neighbours(df.select("id", "vec"), neighbours - 1).select("id", "neighbour")
    if method == "propagation":
        own = given.select("id", F.col("id").alias("neighbour"))
        edges = links.unionByName(own).withColumn("w", F.lit(1.0 / neighbours))
    else:
        degree = links.groupBy(F.col("neighbour").alias("id")).agg(F.count("*").alias("deg"))
        by_target = degree.select(F.col("id").alias("neighbour"), F.col("deg").alias("to_deg"))
        edges = (
            links.join(by_target, "neighbour")
            .join(degree, "id", "left")
            .select("id", "neighbour", (1.0 / F.sqrt(F.coalesce("deg", F.lit(1)) * F.col("to_deg"))).alias("w"))
        )
    edges = settle(edges)
    moved = 0.0
    state = given.withColumns({f"c{c}": F.col(f"y{c}") for c in CLASSES})
    for _ in range(max_rounds):
        source = state.select(F.col("id").alias("neighbour"), *shares)
        mixed = edges.join(source, "neighbour").groupBy("id").agg(
            *[F.sum(F.col("w") * F.col(f"c{c}")).alias(f"m{c}") for c in CLASSES]
        )
        joined = state.join(mixed, "id", "left").fillna(0.0, subset=[f"m{c}" for c in CLASSES])
        if method == "propagation":
            mass = sum((F.col(f"m{c}") for c in CLASSES), F.lit(0.0))
            step = {
                c: F.when(F.col("fixed"), F.col(f"y{c}")).otherwise(
                    F.coalesce(F.try_divide(F.col(f"m{c}"), mass), F.lit(0.0))
                )
                for c in CLASSES
            }
        else:
            step = {c: alpha * F.col(f"m{c}") + (1 - alpha) * F.col(f"y{c}") for c in CLASSES}
        change = sum((F.abs(step[c] - F.col(f"c{c}")) for c in CLASSES), F.lit(0.0))
        state = settle(
            joined.select(
                "id", "fixed", *[f"y{c}" for c in CLASSES], *[step[c].alias(f"c{c}") for c in CLASSES],
                change.alias("_change"),
            )
        )
        moved = state.agg(F.sum("_change")).first()[0] or 0.0
        if moved < tolerance:
            break
    else:
        log.warning("labels still moved by %g after %d rounds", moved, max_rounds)
    best = F.greatest(*shares)
    choice = None
    for c in CLASSES:
        test = (F.col(f"c{c}") == best) & (best > 0)
        choice = F.when(test, F.lit(c)) if choice is None else choice.when(test, F.lit(c))
    return state.select("id", choice.alias("label"))
