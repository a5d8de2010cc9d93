"""Shared pieces: reading tables, intermediate tables, global order, and texts as numpy blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import new_folder, settle

SMALLEST = -(2**63)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write a table into the shared folder and read it again: lineage ends at files every executor sees."""
    path = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """`name`, or that with as many underscores as no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_tag(text: str) -> Column:
    """A 64-bit hash of a text column (null: empty), as the identity of equal texts."""
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def successors(keys: DataFrame, key: str = "key") -> DataFrame:
    """(key, next): the next larger key of each distinct non-null key, the smallest after the largest.

    Keys are dealt by range; each part looks ahead on its own, and the last key of a part takes
    the smallest key of the next part. Only one row per part meets in one task.
    """
    dealt = settle(
        keys.repartitionByRange(parts_of(keys.sparkSession), key).select(key, F.spark_partition_id().alias("part"))
    )
    heads = dealt.groupBy("part").agg(F.min(key).alias("head"))
    ahead = heads.select(
        "part",
        F.lead("head").over(Window.orderBy("part")).alias("after"),
        F.min("head").over(Window.partitionBy()).alias("least"),
    )
    inside = dealt.select(key, "part", F.lead(key).over(Window.partitionBy("part").orderBy(key)).alias("inner"))
    return inside.join(ahead, "part").select(key, F.coalesce("inner", "after", "least").alias("next"))


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Rows with a gapless number from 0 inside each group, in the given order.

    One global sort by (group, order); a part's offset inside a group is the number of that
    group's rows in earlier parts. So a group of any size is spread over many tasks, and only
    the counts per (part, group) are summed in order.
    """
    placed = settle(rows.orderBy(group, *order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND(2**33 - 1))
    counts = placed.groupBy("_part", group).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", group, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return placed.join(offsets, ["_part", group]).select(
        *rows.columns, (F.col("_row") - F.col("_first") + F.col("_before")).alias(name)
    )


# ---------------------------------------------------------------- texts as numpy blocks (inside tasks)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def text_blocks(
    batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1 << 20
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of about 1 MB of text at a time, with the bytes and where each text begins (null: empty).

    A block ends at a row's end, so a longer text makes a block of its own.
    """
    for batch in batches:
        column = pc.fill_null(batch.column(text).cast(pa.large_binary()), b"")
        _, where, content = column.buffers()
        if not len(column):
            continue
        at = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
        start = 0
        while start < len(column):
            stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start), data[at[start] : at[stop]], at[start : stop + 1] - at[start]
            start = stop


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run of bytes outside space and \\t..\\r."""
    word = ~_SPACE[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    edges = at[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = word[edges]
    ends[edges - 1] = word[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(at, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n."""
    if base != _BASE:
        return _powers(n, base)
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = _powers(max(n, 1 << 20), base)
    return _POWERS[0][:n], _POWERS[1][:n]


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 2**64)):
        p = np.full(n, b, np.uint64)
        p[:1] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each span of bytes, equal wherever the same bytes stand."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def run_hashes(values: np.ndarray, length: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """64-bit hash of each `length` consecutive values."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = values[:n].copy()
    for i in range(1, length):
        out *= np.uint64(base)
        out += values[i : i + n]
    return mix(out)
