"""Writers: queryable tables, CSV results, JSON documents and fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_table(df: DataFrame, path: str, sort_by: str = "channelId", partitions: int | None = None) -> None:
    """Parquet partitioned by day and sorted by channel within files.

    Days prune directories; sorted channels give narrow column statistics, so lookups by
    channel skip row groups. Publisher, country, bot and address-class filters are pushed
    down to the scan. A random second key spreads a heavy day over several files.
    """
    spark = df.sparkSession
    files = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    day = df.withColumn("dt", F.to_date("date"))
    spread = F.pmod(F.xxhash64(sort_by, "date"), F.lit(16))
    (
        day.repartition(files, F.col("dt"), spread)
        .sortWithinPartitions("dt", sort_by)
        .write.mode("overwrite")
        .partitionBy("dt")
        .parquet(path)
    )


def save_bucketed(df: DataFrame, table: str, buckets: int = 64, key: str = "channelId") -> None:
    """Managed table bucketed by channel: later joins and aggregates on it need no shuffle."""
    (
        df.withColumn("dt", F.to_date("date"))
        .write.mode("overwrite")
        .partitionBy("dt")
        .bucketBy(buckets, key)
        .sortBy(key)
        .saveAsTable(table)
    )


def write_csv(df: DataFrame, path: str) -> None:
    """CSV directory with headers; nested columns have to be flattened before."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_document(df: DataFrame, path: str) -> None:
    """A one-row document as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored result, or an empty table of its schema where it was never written."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("header", True).csv(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise
