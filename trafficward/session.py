"""Session settings, and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "trafficward", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling, UTC and Arrow switched on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # checkpoints go with the tables that read them
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Pin the time zone: hour-of-day features must not depend on the driver's locale.

    And leave generated methods above 8,000 bytes to smaller ones: the JVM interprets them (DontCompileHugeMethods), and
    the row features of a log, generated as one method, are far above that.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder named by the cluster; a temporary one only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="trafficward-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Materialise once in the shared folder and cut the lineage (survives lost executors)."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again.

    For long loops of joins: a checkpoint keeps the size estimate of its plan, which such a loop
    multiplies round by round, while a table is as large as its files.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side_by_side(spark: SparkSession, steps: list[Callable[[], object]], most: int = 5) -> list:
    """The results of independent steps, up to `most` of them at a time.

    A fit is a chain of small jobs that leave a cluster idle; chains that do not need each other
    share it. When one fails, the jobs of the others are cancelled and the error is raised.
    """
    tag = f"side-by-side-{uuid.uuid4().hex}"

    def tagged(step: Callable[[], object]) -> object:
        spark.addTag(tag)
        try:
            return step()
        finally:
            spark.removeTag(tag)

    with ThreadPoolExecutor(max_workers=max(1, min(most, len(steps)))) as pool:
        # job groups and tags of the caller hold for the steps; each has a copy of its own
        waiting = [pool.submit(inheritable_thread_target(spark)(tagged), step) for step in steps]
        done, _ = wait(waiting, return_when=FIRST_EXCEPTION)
        failed = [f for f in done if f.exception()]
        if failed:
            pool.shutdown(wait=False, cancel_futures=True)
            spark.interruptTag(tag)
            raise failed[0].exception()
        return [f.result() for f in waiting]


def parts_for(spark: SparkSession, rows: int, each: int) -> int:
    """Parts of a table that many small steps read: one for every `each` rows, in one wave of tasks if that can hold them.

    A task costs more than it takes to pass some thousand rows. Beyond the tasks that run at once, parts
    grow to ten times `each` before there are more of them.
    """
    wave = max(spark.sparkContext.defaultParallelism, -(-rows // (10 * each)))
    return max(1, min(-(-rows // each), wave))


def compact(df: DataFrame, rows_per_partition: int = 10_000) -> DataFrame:
    """Spread rows over as many partitions as their number calls for (see `parts_for`).

    Iterative fits start one wave of tasks per step, so a small table in many partitions
    pays for scheduling and a large table in few of them would not fit.
    """
    return df.repartition(parts_for(df.sparkSession, df.count(), rows_per_partition))
