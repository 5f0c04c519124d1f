"""Alerts on a stream: tumbling windows, a condition, suppression and notifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.levels import normalise_level
from ..functions.times import duration_us, ticks_us
from ..operators.alerts import Alert, alert_input, evaluate_alert, notify, suppress
from ..operators.query import slice_start
from ..session import delete_folder
from .live import stream_time_slices

SPOKEN_SCHEMA = "alert STRING, time TIMESTAMP"


def stream_firings(stream: DataFrame, alert: Alert, watermark: str = "1 minute") -> DataFrame:
    """Windows and groups that meet the condition, once each, when the watermark has passed them.

    Exact percentiles need all values of a window, so live alerts measure with aggregates.
    """
    if alert.percentiles:
        raise ValueError("use percentile_within() among the measures of a live alert")
    slices = stream_time_slices(alert_input(stream, alert), alert.window, alert.measures, alert.group_by, watermark)
    fired = slices.where(alert.having).drop("_window")
    return fired.select(F.lit(alert.title).alias("alert"), normalise_level(F.lit(alert.level)).alias("level"), "*")


def stream_alert(stream: DataFrame, alert: Alert, out_path: str, state: str, checkpoint: str, watermark: str = "1 minute",
                 available_now: bool = False) -> StreamingQuery:
    """Appends one notification per notifying window, group and channel to a table.

    What reaches each batch is one row per firing window and group. Suppression uses the batch
    operator, with the last notification of the batches before as its first firing; that single
    row is kept in a table next to the checkpoint. Repeated batches overwrite their own output.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fired = batch.persist()
        try:
            times = fired.select("alert", "time").distinct()
            before = spark.read.schema(SPOKEN_SCHEMA).parquet(f"{state}/batch={batch_id - 1}") if batch_id > 0 else None
            if alert.suppression is not None and before is not None:
                spoken = suppress(times.unionByName(before), alert.suppression).join(before, ["alert", "time"], "left_anti")
            elif alert.suppression is not None:
                spoken = suppress(times, alert.suppression)
            else:
                spoken = times
            spoken = spoken.persist()
            every = spoken if before is None else spoken.unionByName(before)
            every.groupBy("alert").agg(F.max("time").alias("time")).write.mode("overwrite").parquet(f"{state}/batch={batch_id}")
            rows = fired.join(spoken, ["alert", "time"], "left_semi")
            notify(rows, alert.channels).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
            spoken.unpersist()
            if batch_id > 1:  # a repeated batch needs the state before it, and no older one
                delete_folder(spark, f"{state}/batch={batch_id - 2}")
        finally:
            fired.unpersist()

    writer = (stream_firings(stream, alert, watermark).writeStream.outputMode("append").foreachBatch(write)
              .option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def drain_alert(stream: DataFrame, rows: DataFrame, alert: Alert, out_path: str, state: str, checkpoint: str, watermark: str = "1 minute") -> DataFrame:
    """All notifications of a stream that has ended, those of the windows still open when its input ended too.

    The open windows are evaluated from ``rows``, the same source as a table; only what comes after the last closed
    window is read. The last notification of the stream is their first firing.
    """
    stream_alert(stream, alert, out_path, state, checkpoint, watermark, available_now=True).awaitTermination()
    spark = stream.sparkSession
    marks = spark.read.text(f"{checkpoint}/offsets").select(F.get_json_object("value", "$.batchWatermarkMs").cast("bigint").alias("ms"))
    reached = marks.agg(F.max("ms")).first()[0]
    mark = F.timestamp_millis(F.lit(reached or 0))
    fired = evaluate_alert(rows.where(F.col("ts") >= slice_start(mark, alert.window)), alert)
    fired = fired.where(ticks_us(F.col("time")) + duration_us(alert.window) > ticks_us(mark))
    if reached is None:  # no batch, so there is no table yet
        return notify(fired if alert.suppression is None else suppress(fired, alert.suppression), alert.channels)
    if alert.suppression is not None:
        before = spark.read.schema(SPOKEN_SCHEMA).parquet(state).groupBy("alert").agg(F.max("time").alias("time"))
        times = fired.select("alert", "time").distinct()
        spoken = suppress(times.unionByName(before), alert.suppression).join(before, ["alert", "time"], "left_anti")
        fired = fired.join(spoken, ["alert", "time"], "left_semi")
    last = notify(fired, alert.channels)
    return spark.read.schema(last.schema).parquet(out_path).select(*last.columns).unionByName(last)
