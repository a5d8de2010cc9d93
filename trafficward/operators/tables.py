"""Joins, set operations and top-k selections on keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def lookup(df: DataFrame, mapping: DataFrame, on: str) -> DataFrame:
    """Left join of a value table; Spark broadcasts it when its measured size allows."""
    return df.join(mapping, on, "left")


def keep_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on), on, "left_semi")


def outer_blocks(blocks: list[DataFrame], on: str) -> DataFrame:
    """Full outer join of feature blocks, missing numbers 0."""
    joined = blocks[0]
    for block in blocks[1:]:
        joined = joined.join(block, on, "full_outer")
    return joined.fillna(0)


def reindex(df: DataFrame, keys: DataFrame, on: str, fill: dict) -> DataFrame:
    """One row per listed key, defaults where the table has none."""
    return keys.select(on).join(df, on, "left").fillna(fill)


def align(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    return a.join(b, on, "inner")


def append(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def distinct_keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct()


def difference(all_keys: DataFrame, seen: DataFrame, on: str) -> DataFrame:
    return all_keys.select(on).distinct().join(seen.select(on), on, "left_anti")


def union_keys(tables: list[DataFrame], on: str) -> DataFrame:
    return append([t.select(on) for t in tables]).distinct()


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    there = set(b.columns)
    return [c for c in a.columns if c in there]


def common_keys(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    return a.select(on).intersect(b.select(on))


def top(df: DataFrame, score: str, n: int, tie: str, lowest: bool = False) -> DataFrame:
    """The n best (or worst) rows; equal scores by the tie key."""
    order = F.asc_nulls_last(score) if lowest else F.desc_nulls_last(score)
    return df.orderBy(order, tie).limit(n)


def head_where(df: DataFrame, condition: Column, order: list[Column], n: int) -> DataFrame:
    return df.where(condition).orderBy(*order).limit(n)


def top_per_key(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of every key; ranks are pruned before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)
