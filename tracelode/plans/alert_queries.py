"""Charts and alerts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import aggregates as a
from ..functions.logic import op_or
from ..functions.numbers import round_to
from ..operators import alerts as al, charts as c
from ..operators.metrics import bucket_value
from ..operators.signals import Signal, by_template, catalogue
from .benchmark_queries import END, IN_RANGE, START, stamp, stamp_sql
from .grouping_queries import _ranked_sql
from .metric_queries import FIXED_SQL
from .registry import query
from .views import STREAM_SQL


def _daily(t, chart, **options):
    return c.render_chart(t.stream, chart, START, END, every="1d", **options)


@query("chart_by_kind", f"""SELECT event_type, {stamp_sql("time")} AS time, count(*) AS n FROM (SELECT event_type, date_trunc('day', ts) AS time FROM stream
    WHERE {IN_RANGE} AND level IN ('Error', 'warn') AND user_id < 800 AND value > 1) GROUP BY 1, 2""", STREAM_SQL)
def chart_by_kind(t):
    stock = catalogue()
    chart = c.Chart("Requests by kind", {"n": a.count_all()}, where=F.col("value") > 1, group_by={"event_type": F.col("event_type")},
                    signal=stock["Errors"] | stock["Warnings"], query_signal=Signal("Low users", F.col("user_id") < 800))
    rows = c.flatten_result(_daily(t, chart), ["event_type"], ["n"])
    return rows.select("event_type", stamp("time"), "n")


@query("chart_percentile_text", """SELECT CAST(CAST(round(p) AS BIGINT) AS VARCHAR) || ' ms' AS p99 FROM (""" + _ranked_sql("", "stream", "value", {"p": 99}) + ")", STREAM_SQL)
def chart_percentile_text(t):
    chart = c.Chart("99th percentile", percentiles={"p": (F.col("value"), 99)})
    return c.render_chart(t.stream, chart).select(c.rounded_ms(F.col("p")).alias("p99"))


@query("chart_mean_text", "SELECT CAST(CAST(round(avg(value)) AS BIGINT) AS VARCHAR) || ' ms' AS mean FROM stream", STREAM_SQL)
def chart_mean_text(t):
    return c.render_chart(t.stream, c.Chart("Mean", {"mean": c.rounded_ms(F.avg("value"))}))


@query("chart_time_by_action", f"""SELECT event_type, {stamp_sql("time")} AS time, round(sum(value), 4) AS total FROM (SELECT event_type, value, date_trunc('day', ts) AS time
    FROM stream WHERE {IN_RANGE}) GROUP BY 1, 2 HAVING sum(value) > 400""", STREAM_SQL)
def chart_time_by_action(t):
    chart = c.Chart("Time by action", {"total": F.round(F.sum("value"), 4)}, group_by={"event_type": F.col("event_type")}, having=F.col("total") > 400)
    return _daily(t, chart).select("event_type", stamp("time"), "total")


@query("chart_slow_events", f"SELECT message, max(value) AS slowest FROM stream WHERE value > 100 AND {IN_RANGE} GROUP BY 1 ORDER BY slowest DESC, message LIMIT 20", STREAM_SQL)
def chart_slow_events(t):
    chart = c.Chart("Slow", {"slowest": F.max("value")}, where=F.col("value") > 100, group_by={"message": F.col("message")},
                    order_by=(F.col("slowest").desc(), "message"), limit=20)
    return c.render_chart(t.stream, chart, START, END)


@query("chart_statement_times", f"""SELECT {stamp_sql("time")} AS time, max(value) AS high, round(avg(value), 6) AS middle, min(value) AS low FROM (
    SELECT value, date_trunc('hour', ts) AS time FROM stream WHERE {IN_RANGE}) GROUP BY 1""", STREAM_SQL)
def chart_statement_times(t):
    chart = c.Chart("Statement time", {"high": F.max("value"), "middle": F.round(F.avg("value"), 6), "low": F.min("value")})
    return c.render_chart(t.stream, chart, START, END, every="1h").select(stamp("time"), "high", "middle", "low")


@query("chart_last_days", f"""SELECT {stamp_sql("time")} AS time, count(*) AS n FROM (SELECT date_trunc('day', ts) AS time FROM stream
    WHERE ts >= TIMESTAMP '2024-01-23' AND ts < TIMESTAMP '2024-01-30 12:34:56') GROUP BY 1""", STREAM_SQL)
def chart_last_days(t):
    chart = c.Chart("Last week", {"n": a.count_all()})
    return c.render_chart(t.stream, chart, last="7d", now=dt.datetime(2024, 1, 30, 12, 34, 56), every="1d").select(stamp("time"), "n")


@query("chart_lifecycle", f"""SELECT {stamp_sql("time")} AS time, count(*) FILTER (WHERE event_type = 'signup') AS created, count(*) FILTER (WHERE event_type = 'view') AS placed,
    count(*) FILTER (WHERE event_type = 'purchase') AS shipped FROM (SELECT event_type, date_trunc('day', ts) AS time FROM stream WHERE {IN_RANGE}) GROUP BY 1""", STREAM_SQL)
def chart_lifecycle(t):
    def raised(kind):
        return a.count_where(by_template(kind, f"User {{user_id}} did {kind}").predicate)

    chart = c.Chart("Lifecycle", {"created": raised("signup"), "placed": raised("view"), "shipped": raised("purchase")})
    return _daily(t, chart).select(stamp("time"), "created", "placed", "shipped")


@query("chart_product_volume", "SELECT p_type AS product, floor(sum(p_size) / 1000.0 * 10.0 + 0.5) / 10.0 AS kilos FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def chart_product_volume(t):
    items = t.table("lineitem").join(t.table("part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("ts", F.col("l_shipdate").cast("timestamp"))
    chart = c.Chart("Volume", {"kilos": round_to(F.sum("p_size") / 1000.0, 1)}, group_by={"product": F.col("p_type")})
    return c.render_chart(items, chart)


@query("chart_overview", f"""SELECT count(*) AS events, count(*) FILTER (WHERE exception IS NOT NULL OR level = 'Error') AS failures, count(DISTINCT message_template) AS types FROM stream WHERE {IN_RANGE}""", STREAM_SQL)
def chart_overview(t):
    stock = catalogue()
    failed = op_or(stock["Exceptions"].predicate, stock["Errors"].predicate)
    chart = c.Chart("Overview", {"events": a.count_all(), "failures": a.count_where(failed), "types": a.count_distinct(F.col("event_type_id"))})
    return c.render_chart(t.stream, chart, START, END)


@query("chart_filled_gauge", f"""SELECT {stamp_sql("g.time")} AS time, high FROM (SELECT unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '2024-01-30 23:00:00', INTERVAL '1 hour')) AS time) g
    LEFT JOIN (SELECT date_trunc('hour', ts) AS time, max(k) AS high FROM stream WHERE value > 100 AND {IN_RANGE} GROUP BY 1) f USING (time)""", STREAM_SQL)
def chart_filled_gauge(t):
    chart = c.Chart("Stock", {"high": F.max("k")}, where=F.col("value") > 100)
    return c.render_chart(t.stream, chart, START, END, every="1h", fill=True).select(stamp("time"), "high")


def frontend_errors(**changes) -> al.Alert:
    given = dict(title="Frontend errors", window="1m", measures={"errors": a.count_all()}, having=F.col("errors") > 0,
                 signal=catalogue()["Errors"], suppression="10m", channels=("mail", "chat"))
    return al.Alert(**{**given, **changes})


@query("evaluate_alert", f"""SELECT 'All arguments' AS alert, 'Error' AS level, min(service) AS service, user_group, {stamp_sql("time")} AS time, count(*) AS errors, max(value) AS slowest FROM (
    SELECT CASE WHEN value > 10 THEN upper(event_type) ELSE event_type END AS service, user_id % 3 AS user_group, value, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '{START}') AS time
    FROM stream WHERE level IN ('Error', 'warn') AND value > 2 AND {IN_RANGE}) GROUP BY lower(service), user_group, time HAVING count(*) > 10""", STREAM_SQL)
def evaluate_alert(t):
    service = F.when(F.col("value") > 10, F.upper("event_type")).otherwise(F.col("event_type"))
    stock = catalogue()
    alert = al.Alert("All arguments", "6h", F.col("errors") > 10, {"errors": a.count_all(), "slowest": F.max("value")},
                     signal=stock["Errors"] | stock["Warnings"], where=F.col("value") > 2,
                     group_by={"service": service, "user_group": F.col("user_id") % 3}, ci=("service",), level="err")
    rows = al.evaluate_alert(t.stream, alert, START, END)
    return rows.select("alert", "level", "service", "user_group", stamp("time"), "errors", "slowest")


@query("evaluate_histogram_alert", f"""SELECT 'Slow' AS alert, 'Error' AS level, {stamp_sql("time")} AS time, p95 FROM (
    SELECT time, min(v) FILTER (WHERE upto >= greatest(1, ceil(95 * total / 100.0))) AS p95 FROM (
      SELECT time, v, sum(n) OVER (PARTITION BY time ORDER BY v) AS upto, sum(n) OVER (PARTITION BY time) AS total FROM (SELECT time, v, sum(n) AS n FROM weighted GROUP BY 1, 2))
    GROUP BY time) WHERE p95 > 60""", FIXED_SQL)
def evaluate_histogram_alert(t):
    alert = al.Alert("Slow", "1d", F.col("p95") > 60, lateral=(("buckets", "bucket"),),
                     percentiles={"p95": (bucket_value(), 95, F.col("bucket.count"))})
    return al.evaluate_alert(t.histograms, alert).select("alert", "level", stamp("time"), "p95")


# The suppression rule by recursion: the next notification is the first firing a period after the last.
SUPPRESSED_SQL = STREAM_SQL + """, fired AS (SELECT date_trunc('minute', ts) AS time, count(*) AS errors FROM stream WHERE level = 'Error' GROUP BY 1),
spoken AS (SELECT min(time) AS time FROM fired
  UNION ALL SELECT (SELECT min(time) FROM fired f WHERE f.time >= s.time + INTERVAL '10 hours') FROM spoken s WHERE s.time IS NOT NULL)"""


@query("suppress_alert", f"""SELECT 'Frontend errors' AS alert, {stamp_sql("time")} AS time, errors FROM fired WHERE time IN (SELECT time FROM spoken WHERE time IS NOT NULL)""",
       "RECURSIVE " + SUPPRESSED_SQL)
def suppress_alert(t):
    fired = al.evaluate_alert(t.stream, frontend_errors())
    return al.suppress(fired, "10 hours").select("alert", stamp("time"), "errors")


@query("notify_channels", f"""SELECT 'Frontend errors' AS alert, {stamp_sql("time")} AS time, channel, 2716299265 AS event_type_id FROM fired, (SELECT unnest(['mail', 'chat']) AS channel)
    WHERE time IN (SELECT time FROM spoken WHERE time IS NOT NULL)""", "RECURSIVE " + SUPPRESSED_SQL)
def notify_channels(t):
    rows = al.raise_alert(t.stream, frontend_errors(suppression="10 hours"))
    return rows.select("alert", stamp("time"), "channel", "event_type_id")
