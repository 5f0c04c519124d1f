"""Live queries: tailing, subscriptions, time slices and de-duplication."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import duration_us, ticks_us
from ..operators.filters import apply_signal
from ..operators.query import slice_start, time_slices
from ..operators.signals import Signal

log = logging.getLogger(__name__)


def tail(stream: DataFrame, predicate: Column | None = None, signal: Signal | Column | None = None) -> DataFrame:
    """Matching events as they arrive."""
    matching = apply_signal(stream, signal)
    return matching if predicate is None else matching.where(predicate)


def dedupe_stream(stream: DataFrame, within: str, id: str = "id", ts: str = "ts") -> DataFrame:
    """Drops repeats of an event id that arrive within the given time of each other."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark([id])


def slice_offset(start, every) -> str:
    """How far slices anchored at ``start`` are shifted from those anchored at the epoch."""
    import datetime as dt

    at = start if isinstance(start, dt.datetime) else dt.datetime.fromisoformat(str(start))
    micros = int((at - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    return f"{micros % duration_us(every)} microseconds"


def stream_time_slices(stream: DataFrame, every, aggs: dict[str, Column], by=None, watermark: str = "10 minutes",
                       start=None, ts: str = "ts") -> DataFrame:
    """Live time slices. In append mode a slice appears once, when the watermark has passed its end."""
    keys = {} if by is None else by if isinstance(by, dict) else {k: F.col(k) for k in ([by] if isinstance(by, str) else by)}
    width = f"{duration_us(every)} microseconds"
    slices = F.window(ts, width, startTime="0 microseconds" if start is None else slice_offset(start, every))
    grouped = (stream.withWatermark(ts, watermark)
               .groupBy(*[c.alias(n) for n, c in keys.items()], slices.alias("_window"))
               .agg(*[c.alias(n) for n, c in aggs.items()]))
    return grouped.select(*keys, F.col("_window.start").alias("time"), *aggs, "_window")


class _Subscriber:
    """Calls a handler per event. A failing event is logged and the next one is handled."""

    def __init__(self, handler: Callable[[Row], None]):
        self.handler = handler

    def open(self, partition_id, epoch_id):
        return True

    def process(self, row):
        try:
            self.handler(row)
        except Exception:
            log.exception("the handler failed on an event")

    def close(self, error):
        pass


def subscribe(stream: DataFrame, handler: Callable[[Row], None], checkpoint: str, signal: Signal | Column | None = None,
              available_now: bool = False) -> StreamingQuery:
    """Hands matching events to a handler, in the tasks that hold them."""
    writer = apply_signal(stream, signal).writeStream.foreach(_Subscriber(handler)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_to_table(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False, mode: str = "append",
                   partition_by: str | None = None) -> StreamingQuery:
    """Appends a stream to a parquet table."""
    writer = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def drain_time_slices(stream: DataFrame, rows: DataFrame, path: str, checkpoint: str, every, aggs: dict[str, Column], by=None,
                      watermark: str = "10 minutes", start=None, ts: str = "ts") -> DataFrame:
    """All slices of a stream that has ended: those it closed, and those still open when its input ended.

    The open ones are taken from ``rows``, the same source as a table; only what comes after the last closed
    slice is read.
    """
    slices = stream_time_slices(stream, every, aggs, by, watermark, start, ts).drop("_window")
    query = start_to_table(slices, path, checkpoint, available_now=True)
    query.awaitTermination()
    closed = stream.sparkSession.read.schema(slices.schema).parquet(path)
    reached = next((p["eventTime"]["watermark"] for p in reversed(query.recentProgress) if "watermark" in p["eventTime"]), "1970-01-01T00:00:00.000Z")
    mark = F.lit(reached).cast("timestamp")
    open_ = rows.where(F.col(ts) >= slice_start(mark, every, start))
    open_ = time_slices(open_, every, start, by=by, aggs=aggs, ts=ts)
    still = ticks_us(F.col("time")) + duration_us(every) > ticks_us(mark)
    return closed.unionByName(open_.where(still).select(*closed.columns))


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Processes everything that is available and reads the resulting table."""
    spark: SparkSession = stream.sparkSession
    query = start_to_table(stream, path, checkpoint, available_now=True)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


