"""Streams of arriving traffic: incremental metrics, scoring, suppression, bursts and gaps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.address import risk_points
from ..functions.common import count_where
from ..operators.classify import Thresholds, judge, with_scores
from ..schema import TIE


def read_files(spark: SparkSession, folder: str, schema, name_filter: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Stream of parquet files as they arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def each_chunk(stream: DataFrame, call: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Hand every arriving micro-batch to a user function."""
    return (
        stream.writeStream.foreachBatch(call)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append results to a parquet folder, each row exactly once."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def _timed(stream: DataFrame, late: str) -> DataFrame:
    return stream.withColumn("date", F.col("date").cast("timestamp")).withWatermark("date", late)


def channel_metrics(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Hourly channel counts; sums and sketches rather than ratios and distinct counts, so windows can be added up (`channel_totals`)."""
    return (
        _timed(stream, late)
        .where(F.col("channelId").isNotNull())
        .groupBy(F.window("date", "1 hour"), "channelId")
        .agg(
            F.count("*").alias("requests"),
            count_where(F.col("isLikelyBot")).alias("bots"),
            count_where(F.col("isIpDatacenter")).alias("datacenter"),
            count_where(risk_points() >= 2).alias("high_risk"),
            F.hll_sketch_agg("ip", 12).alias("ip_sketch"),
        )
        .select(F.col("window.start").alias("slot"), "channelId", "requests", "bots", "datacenter", "high_risk", "ip_sketch")
    )


def channel_totals(windows: DataFrame) -> DataFrame:
    """Counts over any set of windows of `channel_metrics`, with the distinct addresses of all of them (`ips`)."""
    sums = ["requests", "bots", "datacenter", "high_risk"]
    return windows.groupBy("channelId").agg(
        *[F.sum(c).alias(c) for c in sums], F.hll_sketch_estimate(F.hll_union_agg("ip_sketch")).alias("ips")
    )


def write_counts(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write windowed counts as they grow: each batch owns a folder with the windows it changed.

    Open windows are there too, so nothing waits for a watermark that a finished or silent stream
    never reaches; `read_counts` gives the newest row of each window. A retried batch overwrites
    its own folder. State is still dropped by the watermark of the counts.
    """

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with _state_store(stream.sparkSession):  # open windows may outgrow an executor's heap
        return each_chunk(stream, sink, checkpoint, "update")


def read_counts(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest counts of each window written by `write_counts`."""
    rows = spark.read.option("basePath", path).parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("newest"))
    return newest.select(*keys, "newest.*")


def score_rows(stream: DataFrame, scores: DataFrame, flags: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Classify arriving rows against the stored channel tables (stream–static joins)."""
    return judge(with_scores(stream, scores, flags), thresholds)


def write_scored(stream: DataFrame, scores: DataFrame, flags: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Score micro-batches; each batch owns its folder, so a retried batch overwrites itself."""

    def sink(batch: DataFrame, number: int) -> None:
        score_rows(batch, scores, flags).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return each_chunk(stream, sink, checkpoint)


def request_key(columns: list[str]) -> F.Column:
    """md5 of the request's fields as JSON."""
    return F.md5(F.to_json(F.struct(*columns)))


def write_fresh(
    stream: DataFrame, columns: list[str], path: str, checkpoint: str, ttl_seconds: int = 3600, late_seconds: int | None = None
) -> StreamingQuery:
    """Drop requests with an equal request at most `ttl_seconds` before, across micro-batches.

    The rule looks at event times only, so one batch and many give the same rows as long as a
    request is not overtaken by a later one of an earlier batch. The last request per key is the
    state; keys silent for longer than the time to live (and `late_seconds`) are forgotten,
    since their next request is fresh either way. Rows that come later than that are dropped.
    """
    found = request_gaps(stream.withColumn("request_key", request_key(columns)), "request_key", ttl_seconds, late_seconds)
    fresh = found.where("first").select("request_key", "date", TIE)
    with _state_store(stream.sparkSession):
        return to_parquet(fresh, f"{path}/fresh", checkpoint)


def ip_bursts(stream: DataFrame, threshold: int = 5, length: str = "5 minutes", step: str = "1 minute", late: str = "1 hour") -> DataFrame:
    """Addresses with at least `threshold` requests in a sliding window; late rows are dropped."""
    return (
        _timed(stream, late)
        .where(F.col("ip").isNotNull())
        .groupBy(F.window("date", length, step), "ip")
        .agg(F.count("*").alias("requests"))
        .where(F.col("requests") >= threshold)
        .select(F.col("window.start").alias("slot"), "ip", "requests")
    )


def write_gaps(
    stream: DataFrame, path: str, checkpoint: str, entity: str = "ip", ttl_seconds: int | None = None, late_seconds: int | None = None
) -> StreamingQuery:
    """Seconds since the entity's previous request, across micro-batches; 0 for a first request.

    With a time to live, a request after a longer silence counts as a first one, wherever the
    batches are cut, and rows more than `late_seconds` (default: the time to live) behind the
    newest one of earlier batches are dropped. Without it no entity is ever forgotten.
    """
    found = request_gaps(stream, entity, ttl_seconds, late_seconds)
    with _state_store(stream.sparkSession):
        return to_parquet(found.drop("first"), f"{path}/gaps", checkpoint)


_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """A query started inside keeps its state in RocksDB, which keyed processors need; the session's own choice returns."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class LastRequest(StatefulProcessor):
    """Gap of each request to the one before it of the same key, for all keys of a bucket at once.

    The state of a bucket is the last request of each of its keys, in three arrays. A batch reads and writes a
    bucket once, however many keys it holds: calls to the state store for each key take far longer than the
    work itself where most keys occur once. The rows of a bucket in a micro-batch are a key and two integers each,
    sorted by time with the stored requests among them. With a time to live, keys that are silent for longer than
    it, as the watermark tells, are dropped whenever the bucket is read, and a timer does so for a silent bucket.
    """

    def __init__(self, entity: str, ttl: int | None):
        self.entity, self.ttl = entity, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "entity array<string>, at array<long>, tie array<long>")

    def _known(self) -> pd.DataFrame:
        known = self.last.get() if self.last.exists() else None
        entity, at, tie = known if known else ([], [], [])
        return pd.DataFrame({"entity": pd.Series(entity, dtype=object), "at": np.array(at, np.int64), "tie": np.array(tie, np.int64)})

    def _keep(self, last: pd.DataFrame, timerValues) -> None:
        """Store what the watermark does not let go of, and one timer for the youngest key."""
        if self.ttl is not None:
            last = last[last["at"] // 1000 + 1000 * (self.ttl + 1) > timerValues.getCurrentWatermarkInMs()]
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if not len(last):
            self.last.clear()
            return
        self.last.update((last["entity"].tolist(), last["at"].tolist(), last["tie"].tolist()))
        if self.ttl is not None:
            self.handle.registerTimer(int(last["at"].max()) // 1000 + 1000 * (self.ttl + 1))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [pd.DataFrame({"entity": r[self.entity], "at": r["at"], "tie": r[TIE], "mine": True}) for r in rows]
        known = self._known().assign(mine=False)
        every = pd.concat([p for p in [*parts, known] if len(p)], ignore_index=True)
        code = pd.factorize(every["entity"])[0]
        at, tie = every["at"].to_numpy(np.int64), every["tie"].to_numpy(np.int64)
        order = np.lexsort((tie, at, code))
        every, code, at, tie = every.iloc[order], code[order], at[order], tie[order]
        mine = every["mine"].to_numpy(bool)
        second = at // 1_000_000
        gap = np.diff(second, prepend=second[:1])
        first = np.append(True, code[1:] != code[:-1])
        if self.ttl is not None:
            first |= gap > self.ttl
        self._keep(every[np.append(code[1:] != code[:-1], True)], timerValues)
        names = every["entity"].to_numpy()[mine]
        yield pd.DataFrame({self.entity: names, "at": at[mine], TIE: tie[mine], "first": first[mine], "gap": np.where(first, 0, gap)[mine]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(self._known(), timerValues)
        return iter(())

    def close(self) -> None:
        pass


def request_gaps(
    stream: DataFrame, entity: str, ttl_seconds: int | None = None, late_seconds: int | None = None, buckets: int = 1024
) -> DataFrame:
    """(entity, date, row id, first, gap) of every request: state by hashed buckets of keys.

    Times count in whole seconds, equal times in order of the row id. Rows without an entity are
    firsts with gap 0 and have no state; rows without a time are dropped. The rows of one bucket in one
    micro-batch meet in one task, a key and 16 bytes each, so `files_per_batch` and `buckets` bound what it needs.
    A stream keeps the number of buckets that it began with.
    """
    timed = stream.select(entity, F.col("date").cast("timestamp").alias("date"), F.col(TIE).cast("long").alias(TIE)).where("date IS NOT NULL")
    kind = timed.schema[entity].dataType.simpleString()
    late = (late_seconds if late_seconds is not None else ttl_seconds) if ttl_seconds is not None else None
    if late is not None:
        timed = timed.withWatermark("date", f"{late} seconds")
    gap = f"{entity}_time_gap"
    bucket = F.pmod(F.xxhash64(entity), F.lit(buckets)).alias("_bucket")
    slim = timed.where(F.col(entity).isNotNull()).select(bucket, F.col(entity).cast("string").alias(entity), "date", F.unix_micros("date").alias("at"), TIE)
    found = slim.groupBy("_bucket").transformWithStateInPandas(
        LastRequest(entity, ttl_seconds),
        f"`{entity}` string, at long, `{TIE}` long, first boolean, gap long",
        "Append",
        "None" if late is None else "EventTime",
    )
    keyed = found.select(F.col(entity).cast(kind).alias(entity), F.timestamp_micros("at").alias("date"), TIE, "first", F.col("gap").alias(gap))
    orphans = timed.where(F.col(entity).isNull()).select(entity, "date", TIE, F.lit(True).alias("first"), F.lit(0).cast("long").alias(gap))
    return keyed.unionByName(orphans)
