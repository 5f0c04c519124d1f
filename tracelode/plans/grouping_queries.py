"""Aggregates, grouping and time slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import aggregates as a
from ..operators import query as q
from .benchmark_queries import END, IN_RANGE, START, stamp, stamp_sql
from .registry import query
from .views import STREAM_SQL


def _ranked_sql(keys: str, source: str, value: str, measures: dict[str, float], extra: str = "") -> str:
    """Nearest-rank percentiles by row number, the textbook way."""
    picks = ", ".join(f"min(v) FILTER (WHERE rn >= greatest(1, ceil({p} * total / 100.0))) AS {n}"
                      for n, p in measures.items())
    over = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    group = f" GROUP BY {keys}" if keys else ""
    return f"""SELECT {lead}{extra}{picks} FROM (SELECT *, row_number() OVER ({over} ORDER BY v) AS rn,
      count(*) OVER ({over}) AS total FROM (SELECT {lead}{value} AS v FROM {source} WHERE {value} IS NOT NULL) s1) s2{group}"""


@query("count_of_property", "SELECT event_type, count(exception) AS n FROM stream GROUP BY 1", STREAM_SQL)
def count_of_property(t):
    return q.group_by(t.stream, "event_type", {"n": a.count_of(F.col("exception"))})


@query("count_where", "SELECT event_type, count(*) FILTER (WHERE value > 50) AS dear FROM stream GROUP BY 1", STREAM_SQL)
def count_where(t):
    return q.group_by(t.stream, "event_type", {"dear": a.count_where(F.col("value") > 50)})


@query("count_distinct", "SELECT level, count(DISTINCT user_id) AS users FROM stream GROUP BY 1", STREAM_SQL)
def count_distinct(t):
    return q.group_by(t.stream, "level", {"users": a.count_distinct(F.col("user_id"))})


@query("all_any", "SELECT user_id, bool_and(value > 1) AS every_dear, bool_or(coalesce(exception LIKE 'Time%', false)) AS failed FROM stream GROUP BY 1",
       STREAM_SQL)
def all_any(t):
    return q.group_by(t.stream, "user_id", {"every_dear": a.all_of(F.col("value") > 1),
                                            "failed": a.any_of(F.col("exception").like("Time%"))})


@query("first_last", """SELECT user_id, arg_min(event_type, (ts, id)) AS first_type, arg_max(event_type, (ts, id)) AS last_type
    FROM stream GROUP BY 1""", STREAM_SQL)
def first_last(t):
    return q.group_by(t.stream, "user_id", {"first_type": a.first_of(F.col("event_type")),
                                            "last_type": a.last_of(F.col("event_type"))})


@query("top_n_per_group", """SELECT event_type, position, value FROM (SELECT event_type, value,
    row_number() OVER (PARTITION BY event_type ORDER BY ts, id) AS position FROM stream) WHERE position <= 5""", STREAM_SQL)
def top_n_per_group(t):
    return q.top_n(t.stream, F.col("value"), 5, by="event_type")


@query("bottom_n_per_group", """SELECT event_type, position, value FROM (SELECT event_type, value,
    row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, id DESC) AS position FROM stream) WHERE position <= 5""", STREAM_SQL)
def bottom_n_per_group(t):
    return q.bottom_n(t.stream, F.col("value"), 5, by="event_type")


@query("top_n_large", """SELECT position, value FROM (SELECT value, row_number() OVER (ORDER BY ts, id) AS position FROM stream)
    WHERE position <= 1500""", STREAM_SQL)
def top_n_large(t):
    return q.top_n(t.stream, F.col("value"), 1500)


@query("min_max_mean_sum", """SELECT event_type, min(value) AS low, max(value) AS high, round(avg(value), 6) AS middle,
    round(sum(value), 4) AS total FROM stream GROUP BY 1""", STREAM_SQL)
def min_max_mean_sum(t):
    value = F.col("value")
    return q.group_by(t.stream, "event_type", {
        "low": a.min_of(value), "high": a.max_of(value), "middle": F.round(a.mean_of(value), 6),
        "total": F.round(a.sum_of(value), 4)})


@query("percentiles_by_key", _ranked_sql("event_type", "stream", "value", {"p50": 50, "p95": 95, "p99": 99}), STREAM_SQL)
def percentiles_by_key(t):
    value = F.col("value")
    return q.group_by(t.stream, "event_type", percentiles={"p50": (value, 50), "p95": (value, 95), "p99": (value, 99)})


@query("percentile_of_all", _ranked_sql("", "lineitem", "l_extendedprice", {"p10": 10, "p90": 90}))
def percentile_of_all(t):
    price = F.col("l_extendedprice")
    return q.group_by(t.table("lineitem"), percentiles={"p10": (price, 10), "p90": (price, 90)})


@query("percentile_of_negative", _ranked_sql("c_mktsegment", "customer", "(c_acctbal - 4000)", {"p5": 5, "p50": 50, "p100": 100}))
def percentile_of_negative(t):
    shifted = F.col("c_acctbal") - 4000
    return q.group_by(t.table("customer"), "c_mktsegment", percentiles={
        "p5": (shifted, 5), "p50": (shifted, 50), "p100": (shifted, 100)})


@query("percentile_with_error")
def percentile_with_error(t):
    return q.group_by(t.stream, "event_type", {"p95": a.percentile_within(F.col("value"), 95, 0.01)})


@query("rate_per_day", f"""SELECT {stamp_sql("time")} AS time, round(count(*) / (43200000000 / 86400000000.0), 6) AS per_day FROM (
    SELECT time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '{START}') AS time FROM stream WHERE {IN_RANGE}) GROUP BY 1""", STREAM_SQL)
def rate_per_day(t):
    per_day = F.round(a.count_all() / (a.interval_of("12h") / a.interval_of("1d")), 6)
    return q.time_slices(t.stream, "12h", START, END, aggs={"per_day": per_day}).select(stamp("time"), "per_day")


@query("group_with_null_key", "SELECT exception, count(*) AS n FROM stream GROUP BY 1", STREAM_SQL)
def group_with_null_key(t):
    return q.group_by(t.stream, "exception", {"n": a.count_all()})


@query("group_case_insensitive", """SELECT min(spelled) AS kind, count(*) AS n FROM (
    SELECT CASE WHEN value > 10 THEN upper(event_type) ELSE event_type END AS spelled FROM stream) GROUP BY lower(spelled)""", STREAM_SQL)
def group_case_insensitive(t):
    spelled = F.when(F.col("value") > 10, F.upper("event_type")).otherwise(F.col("event_type"))
    return q.group_by(t.stream, {"kind": spelled}, {"n": a.count_all()}, ci=("kind",))


@query("slices_by_key", f"""SELECT event_type, {stamp_sql("time")} AS time, count(*) AS n, round(avg(value), 6) AS middle FROM (
    SELECT event_type, value, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '{START}') AS time FROM stream WHERE {IN_RANGE})
    GROUP BY 1, 2""", STREAM_SQL)
def slices_by_key(t):
    rows = q.time_slices(t.stream, "6h", START, END, by="event_type",
                         aggs={"n": a.count_all(), "middle": F.round(F.avg("value"), 6)})
    return rows.select("event_type", stamp("time"), "n", "middle")


@query("slices_filled", f"""SELECT g.event_type, {stamp_sql("g.time")} AS time, n FROM (
      SELECT event_type, time FROM (SELECT DISTINCT event_type FROM stream WHERE value > 150) k,
        (SELECT unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '2024-01-30 23:00:00', INTERVAL '1 hour')) AS time) s) g
    LEFT JOIN (SELECT event_type, date_trunc('hour', ts) AS time, count(*) AS n FROM stream WHERE value > 150 AND {IN_RANGE} GROUP BY 1, 2) f
      ON g.event_type = f.event_type AND g.time = f.time""", STREAM_SQL)
def slices_filled(t):
    rows = q.time_slices(t.stream.where(F.col("value") > 150), "1h", START, END, by="event_type",
                         aggs={"n": a.count_all()}, fill=True)
    return rows.select("event_type", stamp("time"), "n")


@query("slices_gaps_filled", f"""SELECT g.event_type, {stamp_sql("g.time")} AS time, n, last_value(high IGNORE NULLS) OVER (PARTITION BY g.event_type ORDER BY g.time) AS high FROM (
      SELECT event_type, unnest(generate_series(min(time), max(time), INTERVAL '1 hour')) AS time FROM (
        SELECT event_type, date_trunc('hour', ts) AS time FROM stream WHERE value > 150 AND {IN_RANGE}) GROUP BY 1) g
    LEFT JOIN (SELECT event_type, date_trunc('hour', ts) AS time, count(*) AS n, max(value) AS high FROM stream WHERE value > 150 AND {IN_RANGE} GROUP BY 1, 2) f
      ON g.event_type = f.event_type AND g.time = f.time""", STREAM_SQL)
def slices_gaps_filled(t):
    rows = q.time_slices(t.stream.where(F.col("value") > 150), "1h", START, END, by="event_type",
                         aggs={"n": a.count_all(), "high": F.max("value")}, fill="gaps", carry=("high",))
    return rows.select("event_type", stamp("time"), "n", "high")


@query("having_measure", """SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM stream GROUP BY 1
    HAVING count(*) > 10""", STREAM_SQL)
def having_measure(t):
    rows = q.group_by(t.stream, "user_id", {"n": a.count_all(), "total": F.round(F.sum("value"), 4)})
    return q.having(rows, F.col("n") > 10)


@query("builder_rows", f"""SELECT {stamp_sql("ts")} AS ts, message, value FROM stream WHERE {IN_RANGE} AND level = 'Error' AND value > 20
    ORDER BY stream.ts, id""", STREAM_SQL)
def builder_rows(t):
    from ..operators.builder import query as build
    from ..operators.signals import catalogue

    rows = (build(t.stream).between(START, END).signal(catalogue()["Errors"]).where(F.col("value") > 20)
            .select("ts", "message", "value").rows())
    return rows.select(stamp("ts"), "message", "value")


@query("builder_slices", f"""SELECT event_type, {stamp_sql("time")} AS time, n, p90 FROM (SELECT event_type, time, max(total) AS n,
      min(v) FILTER (WHERE rn >= greatest(1, ceil(90 * total / 100.0))) AS p90 FROM (
        SELECT event_type, time, v, row_number() OVER (PARTITION BY event_type, time ORDER BY v) AS rn, count(*) OVER (PARTITION BY event_type, time) AS total
        FROM (SELECT event_type, value AS v, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '{START}') AS time FROM stream WHERE {IN_RANGE})) GROUP BY 1, 2)
    WHERE n > 5 ORDER BY time, event_type""", STREAM_SQL)
def builder_slices(t):
    from ..operators.builder import query as build

    rows = (build(t.stream).between(START, END).group("event_type").every("1d").measure(n=a.count_all())
            .percentile(p90=(F.col("value"), 90)).having(F.col("n") > 5).rows())
    return rows.select("event_type", stamp("time"), "n", "p90")


@query("percentile_error_bound", "SELECT event_type, true AS within FROM stream GROUP BY 1", STREAM_SQL)
def percentile_error_bound(t):
    """The share of values up to the approximate percentile stays within the permitted error."""
    near = percentile_with_error(t).withColumnRenamed("event_type", "kind")
    ranked = t.stream.join(near, F.col("event_type") == F.col("kind"))
    share = F.count_if(F.col("value") <= F.col("p95")) / F.count(F.lit(1))
    return q.group_by(ranked, "event_type", {"within": share.between(0.94, 0.96)})
