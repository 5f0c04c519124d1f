"""Metric definitions, dimensions, counters, gauges and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import prop
from ..operators import metrics as m
from .benchmark_queries import stamp, stamp_sql
from .registry import query
from .views import HISTOGRAM_CELLS_SQL, SERIES_SQL, STREAM_SQL

ALL_DEFINITIONS_SQL = """definitions(name, kind, unit, description, of_open) AS (VALUES ('quantity', 'Gauge', 'items', 'Items on the line', false),
    ('revenue', 'Sum', 'USD', 'Revenue after discount', false), ('discount', 'Gauge', '1', 'Discount share', true))"""


@query("metric_definitions", "SELECT name, kind, unit, description FROM definitions WHERE NOT of_open OR EXISTS (SELECT 1 FROM lineitem WHERE l_linestatus = 'O')",
       ALL_DEFINITIONS_SQL)
def metric_definitions(t):
    return m.metric_definitions(t.series)


@query("metric_definitions_by_group", """SELECT DISTINCT name, kind, unit, description, l_linestatus AS status FROM lineitem JOIN definitions ON NOT of_open OR l_linestatus = 'O'""",
       ALL_DEFINITIONS_SQL)
def metric_definitions_by_group(t):
    return m.metric_definitions(t.series, groups="status")


@query("search_metrics", """SELECT name, kind, unit, description FROM definitions WHERE contains(lower(description), 'disc')""", ALL_DEFINITIONS_SQL)
def search_metrics(t):
    return m.search_metrics(t.series, "DISC")


@query("metric_view", """SELECT DISTINCT name, kind, unit, description, l_returnflag AS flag FROM lineitem JOIN definitions ON NOT of_open WHERE l_linestatus = 'F'""",
       ALL_DEFINITIONS_SQL)
def metric_view(t):
    return m.metric_view(t.series, m.MetricView("Fulfilled", (F.col("status") == "F",), {"flag": F.col("flag")}))


@query("metric_dimensions", "SELECT unnest(['flag', 'status']) AS dimension")
def metric_dimensions(t):
    return m.metric_dimensions(t.samples, "discount")


@query("dimension_values", "SELECT DISTINCT l_returnflag AS value FROM lineitem")
def dimension_values(t):
    return m.dimension_values(t.samples, prop("flag"))


@query("counter_rate", f"""SELECT flag, {stamp_sql("time")} AS time, round(sum(revenue), 2) AS total, round(sum(revenue) / 2592000.0, 6) AS per_second FROM (
    SELECT flag, revenue, time_bucket(INTERVAL '30 days', ts, TIMESTAMP '1995-01-01') AS time FROM series
    WHERE ts >= TIMESTAMP '1995-01-01' AND ts < TIMESTAMP '2003-01-01') GROUP BY 1, 2""", SERIES_SQL)
def counter_rate(t):
    rows = m.counter_rate(t.series, F.col("revenue"), "30 days", "flag", "1995-01-01", "2003-01-01")
    return rows.select("flag", stamp("time"), F.round("total", 2).alias("total"), F.round("per_second", 6).alias("per_second"))


@query("gauge_stat", f"""SELECT status, {stamp_sql("time")} AS time, min(discount) AS low, max(discount) AS high, round(avg(discount), 6) AS mean,
    arg_max(discount, (ts, id)) AS last FROM (SELECT *, time_bucket(INTERVAL '10 days', ts, TIMESTAMP '1995-01-01') AS time FROM series
    WHERE ts >= TIMESTAMP '1995-01-01' AND discount IS NOT NULL) GROUP BY 1, 2 HAVING max(discount) > 0.05""", SERIES_SQL)
def gauge_stat(t):
    rows = m.gauge_stat(t.series, F.col("discount"), "10 days", "status", "1995-01-01", having=F.col("high") > 0.05)
    return rows.select("status", stamp("time"), "low", "high", F.round("mean", 6).alias("mean"), "last")


FIXED_SQL = HISTOGRAM_CELLS_SQL + """, weighted AS (SELECT event_type, date_trunc('day', ts) AS time,
    CASE WHEN cell = 0 THEN 10.0 WHEN cell = 20 THEN 200.0 ELSE cell * 10.0 + 5 END::DOUBLE AS v, n FROM cells)"""


def _weighted_sql(keys: str, source: str, percentiles: dict[str, float], shown: str | None = None) -> str:
    picks = ", ".join(f"min(v) FILTER (WHERE upto >= greatest(1, ceil({p} * total / 100.0))) AS {n}" for n, p in percentiles.items())
    return f"""SELECT {shown or keys}, {picks} FROM (SELECT {keys}, v, sum(n) OVER (PARTITION BY {keys} ORDER BY v) AS upto,
      sum(n) OVER (PARTITION BY {keys}) AS total FROM {source}) GROUP BY {keys}"""


@query("phist", _weighted_sql("event_type", "weighted", {"p50": 50, "p99": 99}), FIXED_SQL)
def phist(t):
    from ..operators.joins import lateral_unnest

    rows = lateral_unnest(t.histograms, "buckets", "bucket")
    return m.phist(rows, m.bucket_value(), F.col("bucket.count"), {"p50": 50, "p99": 99}, "event_type")


@query("fixed_hist_percentile", _weighted_sql("event_type, time", "weighted", {"p95": 95, "p99": 99}, f"event_type, {stamp_sql('time')} AS time"), FIXED_SQL)
def fixed_hist_percentile(t):
    rows = m.fixed_hist_percentile(t.histograms, F.col("buckets"), {"p95": 95, "p99": 99}, "1d", "event_type")
    return rows.select("event_type", stamp("time"), "p95", "p99")


@query("hist_throughput", f"SELECT {stamp_sql('time')} AS time, sum(n)::BIGINT AS throughput FROM (SELECT date_trunc('day', ts) AS time, n FROM cells) GROUP BY 1", HISTOGRAM_CELLS_SQL)
def hist_throughput(t):
    return m.hist_throughput(t.histograms, F.col("count"), "1d").select(stamp("time"), "throughput")


@query("hist_max", f"SELECT event_type, {stamp_sql('time')} AS time, min(low) AS low, max(high) AS high FROM (SELECT event_type, date_trunc('day', ts) AS time, low, high FROM cells) GROUP BY 1, 2",
       HISTOGRAM_CELLS_SQL)
def hist_max(t):
    return m.hist_max(t.histograms, F.col("min"), F.col("max"), "1d", "event_type").select("event_type", stamp("time"), "low", "high")


# Bucket indexes at scale 3: gamma is 2^(1/8), so no group reaches 160 buckets and the scale stays.
EXP_SQL = STREAM_SQL + """, indexed AS (SELECT event_type, date_trunc('day', ts) AS time, value,
    CAST(ceil(log2(value) * 8) AS BIGINT) AS i FROM stream WHERE value > 0),
exp_cells AS (SELECT event_type, time, i, (pow(2, (i - 1) / 8.0) + pow(2, i / 8.0)) / 2 AS v, count(*) AS n FROM indexed GROUP BY ALL)"""


@query("build_exp_histogram", f"""SELECT event_type, {stamp_sql("time")} AS time, round(v, 6) AS midpoint, n AS count FROM exp_cells""", EXP_SQL)
def build_exp_histogram(t):
    built = m.build_exp_histogram(t.stream, F.col("value"), "event_type", "1d", scale=3)
    rows = built.select("event_type", "time", F.explode("histogram.buckets").alias("b"))
    return rows.select("event_type", stamp("time"), F.round("b.midpoint", 6).alias("midpoint"), F.col("b.count").alias("count"))


@query("exp_histogram_totals", f"""SELECT event_type, {stamp_sql("time")} AS time, min(value) AS low, max(value) AS high, count(*) AS n, round(sum(value), 4) AS total, 3 AS scale
    FROM indexed GROUP BY event_type, time""", EXP_SQL)
def exp_histogram_totals(t):
    built = m.build_exp_histogram(t.stream, F.col("value"), "event_type", "1d", scale=3)
    h = F.col("histogram")
    return built.select("event_type", stamp("time"), h["min"].alias("low"), h["max"].alias("high"), h["count"].alias("n"),
                        F.round("sum", 4).alias("total"), h["scale"].alias("scale"))


@query("exp_hist_percentile", f"""SELECT event_type, round(p50, 6) AS p50, round(p95, 6) AS p95 FROM ({_weighted_sql("event_type", "exp_cells", {"p50": 50, "p95": 95})})""", EXP_SQL)
def exp_hist_percentile(t):
    built = m.build_exp_histogram(t.stream, F.col("value"), "event_type", "1d", scale=3).withColumnRenamed("time", "ts")
    rows = m.exp_hist_percentile(built, F.col("histogram.buckets"), {"p50": 50, "p95": 95}, by="event_type")
    return rows.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


# Every scale from 12 down, the number of buckets at each, and the first one within 160.
DOWNSCALED_SQL = STREAM_SQL + """, raw AS (SELECT event_type, CAST(ceil(log2(value) * 4096) AS BIGINT) AS i FROM stream WHERE value > 0),
steps AS (SELECT unnest(generate_series(0, 23)) AS k),
sizes AS (SELECT event_type, k, count(DISTINCT CAST(ceil(i / pow(2, k)) AS BIGINT)) AS size FROM raw, steps GROUP BY 1, 2),
chosen AS (SELECT event_type, min(k) AS k FROM sizes WHERE size <= 160 GROUP BY 1)"""


@query("exp_histogram_scale", """SELECT event_type, CAST(12 - k AS INTEGER) AS scale, count(DISTINCT CAST(ceil(i / pow(2, k)) AS BIGINT)) AS buckets, count(*) AS n
    FROM raw JOIN chosen USING (event_type) GROUP BY event_type, k""", DOWNSCALED_SQL)
def exp_histogram_scale(t):
    built = m.build_exp_histogram(t.stream, F.col("value"), "event_type", scale=12)
    return built.select("event_type", F.col("histogram.scale").alias("scale"), F.size("histogram.buckets").cast("bigint").alias("buckets"),
                        F.col("histogram.count").alias("n"))


# Days are built at scales 10 to 12 in turn and merged; the twin builds from the values themselves, from the lowest of these scales down.
MERGED_SQL = STREAM_SQL + """, raw AS (SELECT event_type, value, CAST(ceil(log2(value) * 1024) AS BIGINT) AS i FROM stream WHERE value > 0),
steps AS (SELECT unnest(generate_series(0, 21)) AS k),
sizes AS (SELECT event_type, k, count(DISTINCT CAST(ceil(i / pow(2, k)) AS BIGINT)) AS size FROM raw, steps GROUP BY 1, 2),
chosen AS (SELECT event_type, min(k) AS k FROM sizes WHERE size <= 160 GROUP BY 1)"""


@query("merge_exp_histograms", """SELECT event_type, CAST(10 - k AS INTEGER) AS scale, round((pow(2, (j - 1) * pow(2, k - 10)) + pow(2, j * pow(2, k - 10))) / 2, 6) AS midpoint, n AS count,
    min(low) OVER w AS low, max(high) OVER w AS high, CAST(sum(n) OVER w AS BIGINT) AS n, round(sum(total) OVER w, 4) AS total
    FROM (SELECT event_type, k, CAST(ceil(i / pow(2, k)) AS BIGINT) AS j, count(*) AS n, min(value) AS low, max(value) AS high, sum(value) AS total
      FROM raw JOIN chosen USING (event_type) GROUP BY ALL) WINDOW w AS (PARTITION BY event_type)""", MERGED_SQL)
def merge_exp_histograms(t):
    turn = F.datediff("ts", F.lit("1970-01-01")) % 3
    days = [m.build_exp_histogram(t.stream.where(turn == i), F.col("value"), "event_type", "1d", scale=10 + i) for i in range(3)]
    merged = m.merge_exp_histograms(days[0].unionByName(days[1]).unionByName(days[2]), total=F.col("sum"), keys="event_type")
    h = F.col("histogram")
    rows = merged.select("event_type", h["scale"].alias("scale"), h["min"].alias("low"), h["max"].alias("high"), h["count"].alias("n"),
                         F.round("sum", 4).alias("total"), F.explode("histogram.buckets").alias("b"))
    return rows.select("event_type", "scale", F.round("b.midpoint", 6).alias("midpoint"), F.col("b.count").alias("count"), "low", "high", "n", "total")


@query("downscale_exp_histogram", f"""SELECT event_type, CAST(3 - k AS INTEGER) AS scale, round((pow(2, (j - 1) * pow(2, k - 3)) + pow(2, j * pow(2, k - 3))) / 2, 6) AS midpoint, sum(n)::BIGINT AS count
    FROM (SELECT event_type, k, CAST(ceil(i / pow(2, k)) AS BIGINT) AS j, n FROM totals JOIN (SELECT event_type, min(k) AS k FROM (
      SELECT event_type, k, count(DISTINCT CAST(ceil(i / pow(2, k)) AS BIGINT)) AS size FROM totals, (SELECT unnest(generate_series(0, 14)) AS k) GROUP BY 1, 2) WHERE size <= 20 GROUP BY 1)
      USING (event_type)) GROUP BY event_type, k, j""", EXP_SQL + ", totals AS (SELECT event_type, i, sum(n) AS n FROM exp_cells GROUP BY 1, 2)")
def downscale_exp_histogram(t):
    built = m.build_exp_histogram(t.stream, F.col("value"), "event_type", scale=3)
    small = m.downscale_exp_histogram(built, target_buckets=20)
    rows = small.select("event_type", F.col("histogram.scale").alias("scale"), F.explode("histogram.buckets").alias("b"))
    return rows.select("event_type", "scale", F.round("b.midpoint", 6).alias("midpoint"), F.col("b.count").alias("count"))


@query("sample_metrics", f"""SELECT event_type, {stamp_sql("time")} AS time, round(sum(value), 4) AS revenue, arg_max(k, (ts, id)) AS stock, count(*) AS observed
    FROM (SELECT *, date_trunc('hour', ts) AS time FROM stream) GROUP BY event_type, time""", STREAM_SQL)
def sample_metrics(t):
    rows = m.sample_metrics(t.stream, "1h", "event_type", {"revenue": F.col("value")}, {"stock": F.col("k")}, {"spread": F.col("value")})
    return rows.select("event_type", stamp("time"), F.round("revenue", 4).alias("revenue"), "stock", F.col("spread.count").alias("observed"))
