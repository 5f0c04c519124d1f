"""Acceptance queries: counting, reducing, grouping, slicing and limited sorts over the whole stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.aggregates import count_all, max_of, min_of, sum_of
from ..functions.logic import op_or
from ..functions.text import like_text, substring_of
from ..functions.times import UNITS_US, ticks_us
from ..functions.values import has_prop, prop, prop_equals
from ..operators import query as q
from ..operators.filters import time_range
from .registry import query
from .views import STREAM_SQL

START, END = "2024-01-01", "2024-01-31"
IN_RANGE = f"ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}'"


def stamp(column: str, name: str | None = None):
    """Timestamps are shown as text, so that every engine prints them alike."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name or column)


def stamp_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')"


@query("count_all", f"SELECT count(*) AS n FROM stream WHERE {IN_RANGE}", STREAM_SQL)
def count_events(t):
    return q.group_by(time_range(t.stream, START, END), aggs={"n": count_all()})


@query("multiple_reductions", f"""SELECT count(*) AS n, round(sum(value), 4) AS total, min(k) AS low, max(user_id) AS high
    FROM stream WHERE {IN_RANGE}""", STREAM_SQL)
def multiple_reductions(t):
    return q.group_by(time_range(t.stream, START, END), aggs={
        "n": count_all(), "total": F.round(sum_of(F.col("value")), 4),
        "low": F.min("k"), "high": F.max("user_id")})


@query("percentile_by_level_12h", f"""SELECT level, {stamp_sql("time")} AS time, count(*) AS n,
      min(us) FILTER (WHERE rn >= greatest(1, ceil(90.0 * total / 100))) AS p90
    FROM (SELECT *, row_number() OVER (PARTITION BY level, time ORDER BY us) AS rn,
            count(*) OVER (PARTITION BY level, time) AS total
          FROM (SELECT level, CAST(epoch_us(ts) % 1000 AS DOUBLE) AS us,
                  time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '{START}') AS time
                FROM stream WHERE {IN_RANGE}) a) b
    GROUP BY level, time""", STREAM_SQL)
def percentile_by_level_12h(t):
    sub_ms = ticks_us(F.col("ts")) % UNITS_US["ms"]
    rows = q.time_slices(t.stream, "12h", START, END, by="level", aggs={"n": count_all()},
                         percentiles={"p90": (sub_ms, 90)})
    return rows.select("level", stamp("time"), "n", "p90")


@query("count_with_property", f"SELECT count(*) AS n FROM stream WHERE k IS NOT NULL AND {IN_RANGE}", STREAM_SQL)
def count_with_property(t):
    return q.group_by(time_range(t.stream, START, END).where(has_prop("Detail.k")), aggs={"n": count_all()})


@query("count_exception_prefix", f"SELECT count(*) AS n FROM stream WHERE exception LIKE 'Timeout%' AND {IN_RANGE}",
       STREAM_SQL)
def count_exception_prefix(t):
    return q.group_by(time_range(t.stream, START, END).where(like_text(F.col("exception"), "Timeout%")),
                      aggs={"n": count_all()})


@query("count_message_prefix", f"SELECT count(*) AS n FROM stream WHERE message LIKE 'User 1%' AND {IN_RANGE}", STREAM_SQL)
def count_message_prefix(t):
    return q.group_by(time_range(t.stream, START, END).where(like_text(F.col("message"), "User 1%")),
                      aggs={"n": count_all()})


@query("count_by_level", f"SELECT level, count(*) AS n FROM stream WHERE {IN_RANGE} GROUP BY level", STREAM_SQL)
def count_by_level(t):
    return q.group_by(time_range(t.stream, START, END), "level", {"n": count_all()})


@query("count_by_sub_millisecond", f"""SELECT epoch_us(ts) % 1000 AS us, count(*) AS n FROM stream WHERE {IN_RANGE}
    GROUP BY 1 ORDER BY 1 LIMIT 100""", STREAM_SQL)
def count_by_sub_millisecond(t):
    rows = q.group_by(time_range(t.stream, START, END), {"us": ticks_us(F.col("ts")) % UNITS_US["ms"]}, {"n": count_all()})
    return q.top_k(rows, "us", n=100)


@query("count_by_12h", f"""SELECT {stamp_sql("time")} AS time, count(*) AS n FROM (
      SELECT time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '{START}') AS time FROM stream WHERE {IN_RANGE}) GROUP BY 1""",
       STREAM_SQL)
def count_by_12h(t):
    return q.time_slices(t.stream, "12h", START, END, aggs={"n": count_all()}).select(stamp("time"), "n")


@query("distinct_exception_text", f"""SELECT DISTINCT substr(exception, 1, 20) AS text FROM stream
    WHERE exception IS NOT NULL AND {IN_RANGE} ORDER BY 1 LIMIT 100""", STREAM_SQL)
def distinct_exception_text(t):
    rows = q.distinct_values(time_range(t.stream, START, END).where(F.col("exception").isNotNull()),
                             text=substring_of(F.col("exception"), 0, 20))
    return q.top_k(rows, "text", n=100)


@query("order_by_sub_millisecond", f"""SELECT {stamp_sql("ts")} AS ts, id FROM stream WHERE {IN_RANGE}
    ORDER BY epoch_us(stream.ts) % 1000, id LIMIT 10""", STREAM_SQL)
def order_by_sub_millisecond(t):
    rows = time_range(t.stream, START, END).select("ts", "id")
    return q.top_k(rows, ticks_us(F.col("ts")) % UNITS_US["ms"], "id", n=10).select(stamp("ts"), "id")


@query("order_by_message", """SELECT message, id FROM stream WHERE ts >= TIMESTAMP '2024-01-28' AND ts < TIMESTAMP '2024-01-31'
    ORDER BY message, id LIMIT 10""", STREAM_SQL)
def order_by_message(t):
    return q.top_k(time_range(t.stream, "2024-01-28", END).select("message", "id"), "message", "id", n=10)


@query("order_by_message_ci", """SELECT message, id FROM stream WHERE ts >= TIMESTAMP '2024-01-28' AND ts < TIMESTAMP '2024-01-31'
    ORDER BY lower(message), message, id LIMIT 10""", STREAM_SQL)
def order_by_message_ci(t):
    rows = time_range(t.stream, "2024-01-28", END).select("message", "id")
    return q.top_k(rows, F.lower("message"), "message", "id", n=10)


@query("count_heavy_predicate", f"""SELECT count(*) AS n FROM stream
    WHERE (user_id = 1 OR event_type = 'none' OR user_id % 7 = 3 OR length(event_type) > 6 OR value > 180
      OR message LIKE 'User 8%' OR k > 95 OR k % 10 = 0 OR exception LIKE '%9' OR level = 'warn') AND {IN_RANGE}""", STREAM_SQL)
def count_heavy_predicate(t):
    # Promoted properties are tested as columns; cheap tests come first, the variant last.
    heavy = op_or(
        F.col("user_id") == 1, F.col("user_id") % 7 == 3, F.col("value") > 180, F.col("k") > 95, F.col("k") % 10 == 0,
        F.length("event_type") > 6, like_text(F.col("message"), "User 8%"), like_text(F.col("exception"), "%9"),
        F.col("level") == "warn", prop_equals("event_type", "none"), prop_equals("Missing", True))
    return q.group_by(time_range(t.stream, START, END).where(heavy), aggs={"n": count_all()})


@query("count_total", "SELECT count(*) AS n FROM stream", STREAM_SQL)
def count_total(t):
    return q.group_by(t.stream, aggs={"n": count_all()})


@query("count_by_hour", f"SELECT {stamp_sql('date_trunc(' + chr(39) + 'hour' + chr(39) + ', ts)')} AS time, count(*) AS n FROM stream GROUP BY 1",
       STREAM_SQL)
def count_by_hour(t):
    return q.time_slices(t.stream, "1h", aggs={"n": count_all()}).select(stamp("time"), "n")


@query("items_by_part_size", """SELECT p_size AS size, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def items_by_part_size(t):
    items = t.table("lineitem").join(t.table("part"), F.col("l_partkey") == F.col("p_partkey"))
    return q.group_by(items, {"size": F.col("p_size")}, {"n": count_all()})


@query("first_binding_per_route", """SELECT event_type, level, arg_min(user_id, (ts, id)) AS user_id, arg_min(k, (ts, id)) AS k
    FROM stream GROUP BY 1, 2""", STREAM_SQL)
def first_binding_per_route(t):
    from ..functions.aggregates import first_of

    return q.group_by(t.stream, ["event_type", "level"],
                      {"user_id": first_of(F.col("user_id")), "k": first_of(F.col("k"))})


@query("extremes_of_properties", f"""SELECT min(value) AS low, max(value) AS high, round(avg(value), 6) AS middle
    FROM stream WHERE {IN_RANGE}""", STREAM_SQL)
def extremes_of_properties(t):
    value = prop("value", "double")
    return q.group_by(time_range(t.stream, START, END), aggs={
        "low": min_of(value), "high": max_of(value), "middle": F.round(F.avg(value), 6)})
