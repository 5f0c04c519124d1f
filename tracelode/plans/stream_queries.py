"""Streams over the given tables, run until all of their input is processed.

Results are written to the shared scratch folder and read back, so each has a batch twin in SQL.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions import aggregates as a
from ..functions.values import prop
from ..operators.alerts import Alert
from ..operators.signals import catalogue
from ..session import scratch_path
from ..streaming import alerting, dedupe, delivery, framing, ingestion, live
from .benchmark_queries import stamp, stamp_sql
from .ingest_queries import LOG_SQL, RECORD_START
from .registry import query
from .views import STREAM_SQL, Tables


def _live(t: Tables, view):
    """A view over the events table as a stream. The path is a glob, which fits one file and a folder of files."""
    source = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/event[s].parquet")
    live_tables = Tables(t.spark, t.folder)
    live_tables.events = source
    return view(live_tables)


def _drained(t: Tables, stream, label: str):
    base = scratch_path(t.spark, label)
    return live.drain(stream, os.path.join(base, "out"), os.path.join(base, "checkpoint"))


@query("stream_tail", "SELECT id, level, value FROM stream WHERE level = 'Error' AND value > 10", STREAM_SQL)
def stream_tail(t):
    events = _live(t, lambda x: x.stream)
    return _drained(t, live.tail(events, F.col("value") > 10, catalogue()["Errors"]).select("id", "level", "value"), "tail")


@query("stream_time_slices", f"""SELECT event_type, {stamp_sql("time")} AS time, n, total FROM (
    SELECT event_type, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01') AS time, count(*) AS n, round(sum(value), 4) AS total FROM stream GROUP BY 1, 2)
    """, STREAM_SQL)
def stream_time_slices(t):
    events = _live(t, lambda x: x.stream.select("ts", "event_type", "value"))
    base = scratch_path(t.spark, "slices")
    rows = live.drain_time_slices(events, t.stream.select("ts", "event_type", "value"), f"{base}/out", f"{base}/checkpoint", "6h",
                                  {"n": a.count_all(), "total": F.sum("value")}, "event_type", start="2024-01-01")
    return rows.select("event_type", stamp("time"), "n", F.round("total", 4).alias("total"))


@query("stream_dedupe", "SELECT id, event_type FROM stream", STREAM_SQL)
def stream_dedupe(t):
    twice = _live(t, lambda x: x.stream).select("id", "ts", "event_type")
    twice = twice.unionByName(_live(t, lambda x: x.stream).select("id", "ts", "event_type"))
    return _drained(t, live.dedupe_stream(twice, "40 days"), "dedupe").select("id", "event_type")


@query("stream_dedupe_dates", f"""SELECT id, event_type, {stamp_sql("ts")} AS ts FROM stream""", STREAM_SQL)
def stream_dedupe_dates(t):
    """Every event is delivered in order of time and, after all of them, once more: repeats are up to the whole table's span late."""
    base = scratch_path(t.spark, "dedupe-dates")
    events = t.stream.select("id", "ts", "event_type")
    for part in ("first", "second"):  # in small row groups, so that a batch of two files is read by many tasks
        events.repartitionByRange(4, "ts").write.option("parquet.block.size", 4 << 20).parquet(f"{base}/in/{part}")
    delivered = (t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", "true").parquet(f"{base}/in"))
    dedupe.dedupe_to_table(delivered, f"{base}/out", f"{base}/state", f"{base}/checkpoint", available_now=True).awaitTermination()
    return t.spark.read.parquet(f"{base}/out").select("id", "event_type", stamp("ts"))


@query("subscribe_outcomes", """SELECT id, CASE WHEN value > 10 THEN 2 ELSE 1 END AS attempts, CASE WHEN value > 50 THEN 'ValueError: ' || id END AS error
    FROM stream WHERE level IN ('Error', 'warn')""", STREAM_SQL)
def subscribe_outcomes(t):
    """The ledger of a handler that fails on values above 10, and of a second round where it fails above 50 only."""
    def handler(limit):
        def handle(event):
            if event["value"] is not None and event["value"] > limit:
                raise ValueError(event["id"])
        return handle

    stock, base = catalogue(), scratch_path(t.spark, "subscribe")
    events = _live(t, lambda x: x.stream).select("id", "ts", "level", "value")
    for _ in range(2):  # the second start finds every event delivered
        delivery.deliver(events, handler(10), f"{base}/ledger", f"{base}/checkpoint", stock["Errors"] | stock["Warnings"], chunks=2, available_now=True).awaitTermination()
    delivery.redeliver(t.spark, f"{base}/ledger", handler(50), "id string, ts timestamp, level string, value double")
    rows = delivery.outcomes(t.spark, f"{base}/ledger")
    return rows.where("batch < 0 or error is null").select("id", "attempts", "error")


@query("stream_ingest", """SELECT json_extract_string(json('{"n":' || event_id || '}'), '$.n')::BIGINT AS n, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.%f') AS ts,
    'Information' AS level, NULL AS reason FROM events WHERE event_type = 'click'
    UNION ALL SELECT NULL, NULL, NULL, CASE event_type WHEN 'view' THEN 'no time' WHEN 'error' THEN 'not JSON'
    WHEN 'signup' THEN 'a time that cannot be read' ELSE 'JSON, but not an object' END FROM events WHERE event_type <> 'click'""")
def stream_ingest(t):
    base = scratch_path(t.spark, "ingest")
    lines = _live(t, lambda x: x.raw_lines).select("line", "source")
    ingestion.ingest_lines(lines, f"{base}/out", f"{base}/checkpoint", f"{base}/quarantine", available_now=True).awaitTermination()
    good = t.spark.read.parquet(f"{base}/out").select(
        prop("n", "bigint").alias("n"), stamp("ts"), "level", F.lit(None).cast("string").alias("reason"))
    bad = t.spark.read.parquet(f"{base}/quarantine").select(
        F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("string").alias("ts"), F.lit(None).cast("string").alias("level"), "reason")
    return good.unionByName(bad)


@query("stream_frames", """SELECT source, event_id * 8 AS frame_start, false AS is_orphan, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ' +00:00 [' || level || '] ' || message || chr(10)
      || CASE WHEN exception IS NULL THEN '' ELSE exception || chr(10) END AS text FROM logs""", LOG_SQL)
def stream_frames(t):
    base = scratch_path(t.spark, "frames")
    lines = _live(t, lambda x: x.log_lines)
    framing.frame_stream(lines, RECORD_START, f"{base}/out", f"{base}/state", f"{base}/checkpoint", available_now=True).awaitTermination()
    framing.release_frames(t.spark, f"{base}/state", f"{base}/out", 0)
    return t.spark.read.parquet(f"{base}/out").select("source", "frame_start", "is_orphan", "text")


STREAM_ALERT_SQL = STREAM_SQL + """, fired AS (SELECT date_trunc('hour', ts) AS time, event_type, count(*) AS errors FROM stream
    WHERE level IN ('Error', 'warn') GROUP BY 1, 2 HAVING count(*) > 2 AND date_trunc('hour', ts) + INTERVAL '1 hour' <= (
      SELECT date_trunc('millisecond', max(ts)) - INTERVAL '1 minute' FROM stream WHERE level IN ('Error', 'warn'))),
spoken AS (SELECT min(time) AS time FROM fired
  UNION ALL SELECT (SELECT min(time) FROM fired f WHERE f.time >= s.time + INTERVAL '5 hours') FROM spoken s WHERE s.time IS NOT NULL)"""


@query("stream_alert", f"""SELECT 'Errors' AS alert, 'Error' AS level, event_type, {stamp_sql("time")} AS time, errors, 2716299265 AS event_type_id, 'mail' AS channel
    FROM fired WHERE time IN (SELECT time FROM spoken WHERE time IS NOT NULL)""", "RECURSIVE " + STREAM_ALERT_SQL)
def stream_alert(t):
    stock, base = catalogue(), scratch_path(t.spark, "alert")
    alert = Alert("Errors", "1h", F.col("errors") > 2, {"errors": a.count_all()}, signal=stock["Errors"] | stock["Warnings"],
                  group_by={"event_type": F.col("event_type")}, suppression="5 hours", channels=("mail",))
    alerting.stream_alert(_live(t, lambda x: x.stream), alert, f"{base}/out", f"{base}/state", f"{base}/checkpoint",
                          available_now=True).awaitTermination()
    rows = t.spark.read.parquet(f"{base}/out")
    return rows.select("alert", "level", "event_type", stamp("time"), "errors", "event_type_id", "channel")


WHOLE_ALERT_SQL = STREAM_SQL + """, fired AS (SELECT date_trunc('hour', ts) AS time, event_type, count(*) AS errors FROM stream
    WHERE level IN ('Error', 'warn') GROUP BY 1, 2 HAVING count(*) > 2),
spoken AS (SELECT min(time) AS time FROM fired
  UNION ALL SELECT (SELECT min(time) FROM fired f WHERE f.time >= s.time + INTERVAL '5 hours') FROM spoken s WHERE s.time IS NOT NULL)"""


@query("stream_alert_drained", f"""SELECT 'Errors' AS alert, 'Error' AS level, event_type, {stamp_sql("time")} AS time, errors, 2716299265 AS event_type_id, 'mail' AS channel
    FROM fired WHERE time IN (SELECT time FROM spoken WHERE time IS NOT NULL)""", "RECURSIVE " + WHOLE_ALERT_SQL)
def stream_alert_drained(t):
    """All notifications of the ended stream, those of the windows that its watermark never passed too."""
    stock, base = catalogue(), scratch_path(t.spark, "alert")
    alert = Alert("Errors", "1h", F.col("errors") > 2, {"errors": a.count_all()}, signal=stock["Errors"] | stock["Warnings"],
                  group_by={"event_type": F.col("event_type")}, suppression="5 hours", channels=("mail",))
    rows = alerting.drain_alert(_live(t, lambda x: x.stream), t.stream, alert, f"{base}/out", f"{base}/state", f"{base}/checkpoint")
    return rows.select("alert", "level", "event_type", stamp("time"), "errors", "event_type_id", "channel")
