"""Readers of traffic logs: strict, lenient, capped, sampled and in chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.common import hash01
from ..schema import BOOLEANS, TIE, TRAFFIC, ensure_columns

# Fixed value: the text form of request times, fractions of three or six digits optional.
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS] 'UTC'"


def _schema(spark: SparkSession, path: str, schema: T.StructType, options: dict) -> T.StructType:
    """The declared types in the order of the file's header; unknown columns read as text."""
    header = spark.read.options(**options).csv(path).columns
    kinds = {f.name: f.dataType for f in schema}
    return T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in header])


def read_csv(spark: SparkSession, path: str, schema: T.StructType = TRAFFIC, **options: str) -> DataFrame:
    """Typed CSV scan; columns may come in any order and may be missing."""
    options = {"header": "true", "escape": '"', **options}
    typed = _schema(spark, path, schema, options)
    return ensure_columns(spark.read.schema(typed).options(**options).csv(path), schema)


def parse_time(text: Column) -> Column:
    """Request time from its text form, null if it does not match."""
    return F.try_to_timestamp(text, F.lit(TIME_FORMAT))


def read_csv_strict_time(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """CSV scan whose `date` must match the log's text form."""
    as_text = T.StructType([T.StructField(f.name, T.StringType() if f.name == "date" else f.dataType) for f in TRAFFIC])
    raw = read_csv(spark, path, as_text, **options)
    return raw.withColumn("date", parse_time(F.col("date")))


def read_csv_rows(spark: SparkSession, path: str, rows: int, **options: str) -> DataFrame:
    """Schema-first scan of at most `rows` rows."""
    return read_csv(spark, path, **options).limit(rows)


def map_chunks(df: DataFrame, each: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a user function to Arrow batches of rows inside the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield each(batch)

    return df.mapInPandas(run, schema)


def sample_rows(df: DataFrame, fraction: float, key: str = TIE) -> DataFrame:
    """Bernoulli sample by hash of the key: the same rows in every run and partitioning."""
    return df.where(hash01(F.col(key)) < fraction)


def coerce_text(df: DataFrame) -> DataFrame:
    """Lenient typing of a text table: 'true' → true, blank or bad integers → 0, bad times → null."""
    flags = {c: F.coalesce(F.lower(F.col(c)) == "true", F.lit(False)) for c in BOOLEANS}
    return df.withColumns(
        {
            **flags,
            "browserMajorVersion": F.coalesce(F.col("browserMajorVersion").try_cast("int"), F.lit(0)),
            "date": parse_time(F.col("date")),
        }
    )


def require_columns(df: DataFrame, names: tuple[str, ...] = ("date", "channelId")) -> DataFrame:
    """Scoring input must at least say when and which channel."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df
