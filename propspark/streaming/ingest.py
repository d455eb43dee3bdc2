"""Incremental folder ingest and live event counters."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


_STORE = "spark.sql.streaming.stateStore.providerClass"


def ingest_stream(spark: SparkSession, folder: str, schema: T.StructType, out: str, checkpoint: str, fmt: str = "parquet",
                  transform: Callable[[DataFrame], DataFrame] | None = None, pattern: str = "*",
                  max_files: int = 1000):
    """STR-1: process the files that no earlier run has finished, then stop.

    The checkpoint remembers the files. A batch is written to its own folder and overwritten when it is repeated, so
    a retry leaves no copies. Every row is kept: which files meet in a batch never decides what is written.
    """
    stream = (spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", pattern)
              .option("maxFilesPerTrigger", max_files).load(folder))
    stream = stream.withColumn("source_file", F.col("_metadata.file_name"))

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch) if transform else batch
        rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def event_windows(events: DataFrame, window: str = "15 minutes", slide: str = "5 minutes", *, late: str) -> DataFrame:
    """STR-2: events and failures per user in sliding windows; works on streams and on tables. A stream leaves out events
    that come more than ``late`` after the newest one; choose it for the source. Tables leave nothing out.
    """
    w = F.window("ts", window, slide)
    return (events.withWatermark("ts", late).groupBy(w.alias("w"), "user_id")
            .agg(F.count("*").alias("events"), F.count_if(~F.col("success")).alias("failures"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "user_id", "events", "failures"))


def event_stream(counts: DataFrame, out: str, checkpoint: str):
    """STR-2: write every change of the counters; :func:`latest` reads the current state back."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The newest version of every counter."""
    rows = spark.read.parquet(out)
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch_id").alias(c) for c in values])


def failing_windows(counts: DataFrame, attempts: int = 5) -> DataFrame:
    """STR-2: windows in which a user reached the failure limit. Failures across a window's border are not seen together;
    :func:`lockout_stream` sees them."""
    return counts.where(F.col("failures") >= attempts)


class TrailingFailures(StatefulProcessor):
    """Failures of one user in one block of time. The state holds those that a window can still reach and is dropped when the
    watermark has passed the block."""

    def __init__(self, width: int, block: int, attempts: int, kept: T.StructType, out: T.StructType):
        self.width, self.block, self.attempts, self.kept, self.out = width, block, attempts, kept, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failures = handle.getListState("failures", self.kept)

    def handleInputRows(self, key, rows, timerValues):
        user, block = key
        if not self.failures.exists():
            self.handle.registerTimer((block + 1) * self.block // 1000)
        new = [(r["at"], r["event"]) for r in rows]
        every = sorted([tuple(r) for r in self.failures.get()] + new)
        self.failures.appendList(new)
        times, first = [at for at, _ in every], min(at for at, _ in new)
        for at, event in every[bisect_left(times, first):]:
            n = bisect_right(times, at) - bisect_right(times, at - self.width)
            if n >= self.attempts and at // self.block == block:
                yield Row(event=event, user=user, at=at, failures=n)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.failures.clear()
        yield from ()

    def close(self) -> None:
        pass


def lockout_stream(events: DataFrame, out: str, checkpoint: str, minutes: int = 15, attempts: int = 5, late: str = "1 day", block_factor: int = 4):
    """STR-2: the failures at which an account is locked, by the failures of the ``minutes`` up to each, as they arrive.

    Every user and block of time has its own state, with the failures of that block and of one window before it, so a user
    who never stops failing is spread over keys. A failure that comes late changes the counts of later ones; these are
    given again, and :func:`live_lockouts` reads the newest. States are dropped once the newest event is ``late`` past them, and
    failures that come later than that are left out: choose it for the source. Uses the RocksDB state store for this stream.
    """
    spark = events.sparkSession
    width = minutes * 60_000_000
    block = width * block_factor
    event, user = events.schema["event_id"].dataType, events.schema["user_id"].dataType
    kept = T.StructType([T.StructField("at", T.LongType()), T.StructField("event", event)])
    found = T.StructType([T.StructField("event", event), T.StructField("user", user), T.StructField("at", T.LongType()), T.StructField("failures", T.LongType())])
    at = F.unix_micros("ts")
    own = F.floor(at / block).cast("long")
    fails = (events.where(~F.col("success")).withWatermark("ts", late)
             .select("ts", F.col("user_id").alias("user"), at.alias("at"), F.col("event_id").alias("event"),
                     F.explode(F.array_distinct(F.array(own, F.floor((at + width) / block).cast("long")))).alias("block")))
    counted = fails.groupBy("user", "block").transformWithState(
        TrailingFailures(width, block, attempts, kept, found), found, "update", "eventTime")
    shaped = counted.select(F.col("event").alias("event_id"), F.col("user").alias("user_id"), F.timestamp_micros("at").alias("ts"), "failures")
    # So that there is something to read, whatever arrives.
    spark.createDataFrame([], shaped.schema).write.mode("overwrite").parquet(f"{out}/lockouts/batch_id=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/lockouts/batch_id={batch_id}")

    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:  # a stream keeps the settings that it was started with
        return (shaped.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def live_lockouts(spark: SparkSession, out: str, key: str = "event_id") -> DataFrame:
    """STR-2: the lockouts that :func:`lockout_stream` has found, with the newest count of each."""
    return latest(spark, f"{out}/lockouts", [key])
