"""Structured Streaming form of the hourly usage rollup.

Usage rows arrive late by up to ``usage_lag_hours``; the watermark is set to
exactly that lag, so an hour is emitted (append mode) once no more rows can
arrive for it, and rows later than the lag are dropped. Prices are a static
table joined to the stream (stream-static inner join). State is bounded by
the watermark: at most ``lag / 1 h + 1`` open hours per workload.

``pace_stream`` adds the checks that the watermark made due: a keyed state per
budget holds an event-time timer for each check, so a check fires once its
inputs are closed, also when no usage follows. ``foreach_batch_pace`` calls the
batch operators for an epoch's due checks on the stored hours of the days they
read.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from spendpace.functions.tags import USAGE_MONEY
from spendpace.session import materialize
from spendpace.sources import usage as usage_src


def hourly_rollup(usage_stream: DataFrame, prices: DataFrame, lag_hours: int) -> DataFrame:
    """``usage_stream``: streaming usage rows (the batch ``usage`` schema)."""
    watermarked = usage_stream.withWatermark("usage_start_time", f"{lag_hours} hours")
    priced = usage_src.classify(usage_src.priced_usage(watermarked, prices))
    return (priced
            .withColumn("compute_type", F.col("billing_origin_product").cast("string"))
            .filter(F.col("compute_type").isNotNull())
            .groupBy(F.window("usage_start_time", "1 hour").alias("w"), "budget_id", "compute_type",
                     "workload_type", "workload_id")
            .agg(F.sum("dbu_dollars").alias("dbu_dollars"))
            .select("budget_id", F.col("w.start").alias("hour_start"), "compute_type", "workload_type",
                    "workload_id", F.col("dbu_dollars").cast(USAGE_MONEY).alias("dbu_dollars")))


def run_available_now(rollup: DataFrame, sink_path: str, checkpoint_path: str) -> None:
    """Process everything available, append closed hours to a parquet sink,
    and stop (exactly-once through the checkpoint + file sink log)."""
    q = (rollup.writeStream.outputMode("append").format("parquet")
         .option("path", sink_path).option("checkpointLocation", checkpoint_path)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def ready_time(as_of, lag_hours: int):
    """When a check's inputs are final: every hour it reads ends by then.
    Observed spend reads hours before the lag cutoff; forecasts, intraday
    fraction and lag fill read whole days before the check's date."""
    as_of = F.date_trunc("hour", as_of.cast("timestamp"))
    return F.greatest(as_of - F.make_interval(hours=F.lit(lag_hours)), F.date_trunc("day", as_of))


class CheckClock(StatefulProcessor):
    """Per budget, the checks that wait for their inputs: an event-time timer
    at each check's ``ready_time`` fires when the watermark passes it, whether
    or not usage comes after it."""

    def init(self, handle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "ready long, at long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for ready, at in zip(initialState["ready"].tolist(), initialState["at"].tolist()):
            self._waiting.appendValue((ready, at))
        for ready in set(initialState["ready"].tolist()):
            self._handle.registerTimer(ready)

    def handleInputRows(self, key, rows, timerValues):
        for _ in rows:
            pass
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        now = expiredTimerInfo.getExpiryTimeInMs()
        yield pd.DataFrame([(key[0], at) for ready, at in self._waiting.get() if ready == now], columns=["budget_id", "at"])

    def close(self) -> None:
        pass


def due_checks(usage_stream: DataFrame, instants: DataFrame, lag_hours: int) -> DataFrame:
    """Stream of the checks (budget_id, as_of) of ``instants`` whose inputs the
    watermark has closed; budgets without usage included. Of the usage only each
    task's latest row per budget goes on to the clock."""
    import pyarrow as pa

    def latest(batches):
        for b in batches:
            last = pa.Table.from_batches([b]).group_by("budget_id").aggregate([("usage_start_time", "max")])
            yield from last.select(["budget_id", "usage_start_time_max"]).rename_columns(["budget_id", "usage_start_time"]).to_batches()

    kind = usage_stream.schema["budget_id"].dataType.simpleString()
    seen = usage_stream.withWatermark("usage_start_time", f"{lag_hours} hours").select("budget_id", "usage_start_time")
    seen = seen.mapInArrow(latest, f"budget_id {kind}, usage_start_time timestamp")
    waiting = instants.select("budget_id", F.unix_millis(ready_time(F.col("as_of"), lag_hours)).alias("ready"),
                              F.unix_millis(F.col("as_of").cast("timestamp")).alias("at")).distinct()
    due = seen.groupBy("budget_id").transformWithStateInPandas(
        statefulProcessor=CheckClock(), outputStructType=f"budget_id {kind}, at long", outputMode="Append",
        timeMode="EventTime", initialState=waiting.groupBy("budget_id"))
    return due.select("budget_id", F.timestamp_millis("at").alias("as_of"))


def pace_stream(usage_stream: DataFrame, prices: DataFrame, instants: DataFrame, lag_hours: int) -> DataFrame:
    """Closed hours (``as_of`` null) and due checks (``hour_start`` null) as one
    stream under one watermark: an epoch that fires a check has brought, or
    earlier ones have, every hour the check reads."""
    return hourly_rollup(usage_stream, prices, lag_hours).unionByName(due_checks(usage_stream, instants, lag_hours), allowMissingColumns=True)


def _stored_hours(spark: SparkSession, path: str, first: date, last: date, schema: StructType) -> DataFrame:
    """The stored hours of the days ``[first, last]``; other days' folders are
    not even listed."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = [f"{path}/usage_date={first + timedelta(days=k)}" for k in range((last - first).days + 1)]
    folders = [f for f in folders if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f))]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*folders)


def foreach_batch_pace(spark: SparkSession, instants: DataFrame, status_for: "callable", out_path: str, days_back: int):
    """foreachBatch handler of ``pace_stream``. An epoch's closed hours are
    stored under ``out_path/hours`` by date and epoch; the pace status of its
    due checks, computed from the stored hours of ``days_back`` days before the
    first of them up to the last, under ``out_path/status/epoch=<id>``. A
    retried epoch replaces its own output.

    Hours are dealt by ranges of time before they are written: a date's rows lie
    in a few tasks, so files number about tasks plus dates, not their product.
    The due checks are a small stage table; a check reads it many times."""
    hours_path = f"{out_path}/hours"

    def handle(batch: DataFrame, epoch_id: int) -> None:
        batch.persist()  # the stateful plan runs once for both outputs
        try:
            hours = batch.filter(F.col("hour_start").isNotNull()).drop("as_of")
            (hours.withColumn("usage_date", F.to_date("hour_start")).withColumn("epoch", F.lit(epoch_id))
             .repartitionByRange("usage_date", "hour_start", "budget_id", "workload_type", "workload_id")
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("usage_date", "epoch").parquet(hours_path))
            due = batch.filter(F.col("as_of").isNotNull()).select("budget_id", "as_of").distinct()
            first, last = due.agg(F.to_date(F.min("as_of")), F.to_date(F.max("as_of"))).first()
            if first is None:
                return
            stored = _stored_hours(spark, hours_path, first - timedelta(days=days_back), last, hours.schema)
            status = status_for(materialize(instants.join(due, ["budget_id", "as_of"], "left_semi")), stored)
            status.write.mode("overwrite").parquet(f"{out_path}/status/epoch={epoch_id}")
        finally:
            batch.unpersist()

    return handle


#: Timers and lists of the clock need the state store that keeps them on disk.
_STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_pace(spark: SparkSession, usage_stream: DataFrame, prices: DataFrame, instants: DataFrame, status_for: "callable", base: str,
             lag_hours: int, days_back: int) -> None:
    """Process everything available: hours and statuses under ``base``. A query
    takes the state store when it starts; the session keeps its own setting."""
    handler = foreach_batch_pace(spark, instants, status_for, base, days_back)
    before = spark.conf.get(_STATE_STORE[0], None)
    spark.conf.set(*_STATE_STORE)
    try:
        q = (pace_stream(usage_stream, prices, instants, lag_hours).writeStream.outputMode("append").foreachBatch(handler)
             .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    finally:
        spark.conf.set(_STATE_STORE[0], before) if before else spark.conf.unset(_STATE_STORE[0])
    q.awaitTermination()


def file_stream(spark: SparkSession, directory: str, schema: StructType, glob: str | None = None,
                max_files: int | None = None) -> DataFrame:
    """Parquet files landing in ``directory`` (optionally only names matching
    ``glob``) as a stream."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(directory)
