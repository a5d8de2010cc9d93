"""Small expressions shared by every family."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F


def hash01(value: Column) -> Column:
    """Uniform number in [0,1) from the text of `value`; the same in any SQL engine with md5."""
    head = F.substring(F.md5(value.cast("string")), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") / F.lit(4294967296.0)


def as_int(flag: Column) -> Column:
    """Null or false → 0, true → 1."""
    return F.coalesce(flag.cast("boolean"), F.lit(False)).cast("int")


def rate(predicate: Column) -> Column:
    """Share of rows where the predicate holds; null counts as not holding."""
    return F.avg(as_int(predicate).cast("double"))


def count_where(predicate: Column) -> Column:
    return F.sum(as_int(predicate).cast("bigint"))


def total(columns: Iterable[Column]) -> Column:
    """Row-wise sum without a starting zero literal in the plan."""
    items = list(columns)
    out = items[0]
    for item in items[1:]:
        out = out + item
    return out


def right_closed(value: Column, edges: Sequence[float], labels: Sequence[str], include_lowest: bool = False) -> Column:
    """Label of the bin (edges[i], edges[i+1]] holding the value, null outside all bins."""
    low = value >= F.lit(float(edges[0])) if include_lowest else value > F.lit(float(edges[0]))
    chain = F.when(~low, F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels):
        chain = chain.when(value <= F.lit(float(upper)), F.lit(label))
    return chain


def seconds(ts: Column) -> Column:
    """Epoch seconds with the fraction kept."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1000000.0)


def safe_ratio(top: Column, bottom: Column) -> Column:
    """top/bottom, 0 where the denominator is 0 or null."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation aggregate, null for a constant column."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope aggregate, null for a constant x."""
    return F.try_divide(F.covar_pop(x, y), F.var_pop(x))
