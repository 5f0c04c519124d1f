"""Charts from rollups. The event table and the rollup are written to the shared scratch folder first."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rollups as r, sinks
from ..operators.signals import catalogue
from ..session import scratch_path
from .benchmark_queries import END, IN_RANGE, START, stamp, stamp_sql
from .registry import query
from .views import STREAM_SQL

#: The second run gets the events from here on.
LATER = "2024-01-11"


def _kept() -> r.Rollup:
    stock, value = catalogue(), F.col("value")
    return r.Rollup("1h", {"n": r.count(), "large": r.count(value > 50), "total": r.total(value), "high": r.greatest(value), "middle": r.mean(value),
                           "users": r.distinct(F.col("user_id")), "p95": r.percentile(value, 95)},
                    {"event_type": F.col("event_type")}, (stock["Errors"], stock["Errors"] | stock["Warnings"]))


def _rolled(t):
    base = scratch_path(t.spark, "rollup")
    rows = t.stream.select("id", "ts", "level", "event_type", "user_id", "value")
    sinks.write_events(rows, f"{base}/events")
    r.refresh(t.spark, _kept(), f"{base}/events", f"{base}/rollup")
    return rows, f"{base}/rollup"


@query("rollup_chart", f"""SELECT event_type, {stamp_sql("time")} AS time, count(*) AS n, count(*) FILTER (WHERE value > 50) AS large, round(sum(value), 4) AS total,
    max(value) AS high, round(avg(value), 6) AS middle FROM (SELECT event_type, value, date_trunc('day', ts) AS time FROM stream WHERE {IN_RANGE}) GROUP BY 1, 2""", STREAM_SQL)
def rollup_chart(t):
    _, path = _rolled(t)
    rows = r.rolled_chart(t.spark, _kept(), path, START, END, "1d", measures=("n", "large", "total", "high", "middle"))
    return rows.select("event_type", stamp("time"), "n", "large", F.round("total", 4).alias("total"), "high", F.round("middle", 6).alias("middle"))


@query("rollup_signal_chart", f"""SELECT {stamp_sql("time")} AS time, count(*) AS n, round(sum(value), 4) AS total FROM (
    SELECT value, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '{START}') AS time FROM stream WHERE level IN ('Error', 'warn') AND {IN_RANGE}) GROUP BY 1 HAVING count(*) > 10""", STREAM_SQL)
def rollup_signal_chart(t):
    _, path = _rolled(t)
    rows = r.rolled_chart(t.spark, _kept(), path, START, END, "6h", (), ("n", "total"), "(Errors or Warnings)", F.col("n") > 10)
    return rows.select(stamp("time"), "n", F.round("total", 4).alias("total"))


@query("rollup_sketches", "SELECT event_type, true AS rank_within, true AS users_within FROM stream GROUP BY 1", STREAM_SQL)
def rollup_sketches(t):
    """Percentiles and distinct counts of the merged sketches, held against the events within their stated errors."""
    events, path = _rolled(t)
    near = r.rolled_chart(t.spark, _kept(), path, measures=("p95", "users")).withColumnsRenamed({"event_type": "kind", "users": "near"})
    share = F.count_if(F.col("value") <= F.col("p95")) / F.count("value")
    below = F.count_if(F.col("value") < F.col("p95")) / F.count("value")
    users = F.count_distinct("user_id")
    bound = 4 * 1.04 / 2 ** (r.LG_K / 2)
    return (events.join(near, F.col("event_type") == F.col("kind")).groupBy("event_type")
            .agg(((below <= 0.95 + r.RANK_ERROR) & (share >= 0.95 - r.RANK_ERROR)).alias("rank_within"),
                 (F.abs(F.max("near") - users) <= F.greatest(F.lit(1.0), bound * users)).alias("users_within")))


@query("rollup_second_run", f"""SELECT strftime(day, '%Y-%m-%d') AS day, CASE WHEN day < DATE '{LATER}' THEN 1 ELSE 2 END AS run, count(*) AS n
    FROM (SELECT CAST(ts AS DATE) AS day FROM stream) GROUP BY 1, day UNION ALL SELECT NULL, 3, NULL""", STREAM_SQL)
def rollup_second_run(t):
    """What each of three runs reads: the first dates, those that were added since, and nothing; with the counts that the rollup shows then."""
    base = scratch_path(t.spark, "rollup")
    rows = t.stream.select("id", "ts", "level", "event_type", "user_id", "value")
    read = []
    for part in (F.col("ts") < LATER, F.col("ts") >= LATER, None):
        if part is not None:
            sinks.write_events(rows.where(part), f"{base}/events")
        read.append(r.refresh(t.spark, _kept(), f"{base}/events", f"{base}/rollup"))
    runs = t.spark.createDataFrame([(d and d.isoformat(), i) for i, dates in enumerate(read, 1) for d in dates or [None]], "day string, run int")
    counts = r.rolled_chart(t.spark, _kept(), f"{base}/rollup", every="1d", by=(), measures=("n",))
    counts = counts.select(F.date_format("time", "yyyy-MM-dd").alias("_day"), "n")
    return runs.join(counts, F.col("day") == F.col("_day"), "left").select("day", "run", "n")
