"""Files and tables: the given tables are written to the shared scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import prop
from ..operators import ingest, lifecycle, sinks
from ..operators.extraction import compile_pattern, extract_fields
from ..operators.filters import time_range
from ..operators.framing import frame_lines
from ..operators.signals import catalogue
from ..session import scratch_path
from ..sources import clef
from ..sources.lines import read_lines
from .benchmark_queries import stamp, stamp_sql
from .ingest_queries import LOG_SQL, PATTERN
from .registry import query
from .views import LEVEL_SQL, STREAM_SQL


@query("text_files_to_events", f"""SELECT {stamp_sql("ts")} AS ts, full_level AS level, message,
    CASE WHEN exception IS NOT NULL THEN exception || chr(10) END AS exception FROM logs""", LOG_SQL)
def text_files_to_events(t):
    path = scratch_path(t.spark, "text")
    t.log_text.select("text").write.text(f"{path}/first")
    lines = read_lines(t.spark, [f"{path}/first/part-*.txt"])
    frames = frame_lines(lines, compile_pattern(PATTERN).start, block="block")
    events = ingest.build_events(extract_fields(frames.where(~F.col("is_orphan")).select("text"), PATTERN, keep=()))
    return events.select(stamp("ts"), "level", "message", "exception")


@query("several_text_inputs", """SELECT (length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS n_lines, count(*) * 2 AS n FROM (SELECT text || '' AS text FROM documents) GROUP BY 1""")
def several_text_inputs(t):
    path = scratch_path(t.spark, "inputs")
    marked = t.table("documents").select(F.concat(F.lit("\x02"), F.regexp_replace("text", "[\r\x02]", " ")).alias("text"))
    for part in ("log-1", "log-2"):
        marked.write.text(f"{path}/{part}")
    frames = frame_lines(read_lines(t.spark, [f"{path}/log-1/*.txt", f"{path}/log-2/*.txt"]), r"\A\x02", block="block")
    return frames.groupBy(F.col("n_lines").cast("bigint").alias("n_lines")).agg(F.count(F.lit(1)).alias("n"))


@query("clef_files_to_events", f"""SELECT event_id, {stamp_sql("ts")} AS ts, CASE WHEN event_type = 'click' THEN 'Information' ELSE {LEVEL_SQL} END AS level,
    'User ' || user_id || ' did ' || event_type AS message, printf('%032x', user_id + 1) AS trace_id FROM events""")
def clef_files_to_events(t):
    path = scratch_path(t.spark, "clef")
    t.clef_lines.write.text(path)
    events = clef.read_clef(t.spark, f"{path}/*.txt")
    return events.select(prop("event_id", "bigint").alias("event_id"), stamp("ts"), "level", "message", "trace_id")


@query("invalid_lines_ignored", """SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'signup') GROUP BY 1""")
def invalid_lines_ignored(t):
    path = scratch_path(t.spark, "invalid")
    t.raw_lines.select("source", F.col("line").alias("value")).write.partitionBy("source").text(path)
    events = clef.read_clef(t.spark, path, invalid="ignore", reference_time="2024-01-01")
    stamped = events.select(F.when(prop("n", "bigint").isNull(), "signup").when(F.col("ts") == "2024-01-01", "view").otherwise("click").alias("event_type"))
    return stamped.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("event_table_range", f"""SELECT id, {stamp_sql("ts")} AS ts, CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date FROM stream
    WHERE ts >= TIMESTAMP '2024-01-09 06:00:00' AND ts < TIMESTAMP '2024-01-12 18:00:00'""", STREAM_SQL)
def event_table_range(t):
    path = scratch_path(t.spark, "table")
    sinks.write_events(t.stream.select("id", "ts", "level", "message", "properties", F.lit(None).cast("string").alias("trace_id")), path)
    table = time_range(sinks.read_events(t.spark, path), "2024-01-09 06:00:00", "2024-01-12 18:00:00")
    return table.select("id", stamp("ts"), F.col("event_date").cast("string").alias("event_date"))


@query("clef_round_trip", f"""SELECT id, {stamp_sql("ts")} AS ts, level, message, exception, user_id FROM stream""", STREAM_SQL)
def clef_round_trip(t):
    path = scratch_path(t.spark, "export")
    rows = t.stream.select("ts", "level", "message_template", "exception", F.to_variant_object(F.struct("id", "user_id")).alias("properties"))
    sinks.write_clef(rows, path)
    events = clef.read_clef(t.spark, path)
    return events.select(prop("id").alias("id"), stamp("ts"), "level", "message", "exception", prop("user_id", "bigint").alias("user_id"))


@query("csv_round_trip", "SELECT c_custkey, '\"' || c_name || '\", in' AS name, CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END AS positive, 'null' AS nothing FROM customer")
def csv_round_trip(t):
    path = scratch_path(t.spark, "csv")
    rows = t.table("customer").select("c_custkey", F.concat(F.lit('"'), F.col("c_name"), F.lit('", in')).alias("name"),
                                      (F.col("c_acctbal") > 0).alias("positive"), F.lit(None).cast("string").alias("nothing"))
    sinks.write_csv(rows, path)
    back = t.spark.read.csv(path, header=True, escape='"', schema="c_custkey BIGINT, name STRING, positive STRING, nothing STRING")
    return back


@query("ndjson_round_trip", "SELECT doc_id, md5(text) AS digest, lang, n_chars FROM documents")
def ndjson_round_trip(t):
    path = scratch_path(t.spark, "json")
    docs = t.table("documents")
    sinks.write_ndjson(docs, path)
    back = t.spark.read.schema(docs.schema).json(path)
    return back.select("doc_id", F.md5("text").alias("digest"), "lang", "n_chars")


@query("delete_from_table", "SELECT id, level FROM stream WHERE NOT (level = 'Error' AND ts < TIMESTAMP '2024-01-20') AND NOT (ts >= TIMESTAMP '2024-01-25')", STREAM_SQL)
def delete_from_table(t):
    path = scratch_path(t.spark, "delete")
    sinks.write_events(t.stream.select("id", "ts", "level"), path)
    lifecycle.delete_from_table(t.spark, path, end="2024-01-20", signal=catalogue()["Errors"])
    lifecycle.delete_from_table(t.spark, path, start="2024-01-25")
    return t.spark.read.parquet(path).select("id", "level")


@query("delete_from_streamed_table", """SELECT n FROM (SELECT event_id AS n, date_trunc('second', ts) AS ts FROM events WHERE event_type = 'click')
    WHERE NOT (ts < TIMESTAMP '2024-01-20' AND n % 3 = 0) AND NOT (ts >= TIMESTAMP '2024-01-25')""")
def delete_from_streamed_table(t):
    """Deletion from, and compaction of, the table that a stream has written."""
    from ..streaming import ingestion

    base = scratch_path(t.spark, "streamed")
    sinks_in = t.raw_lines.where(F.col("source") == "click").select("line")
    sinks_in.repartition(3).write.text(f"{base}/in")
    ingestion.ingest_stream(t.spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", files_per_trigger=2, available_now=True).awaitTermination()
    lifecycle.delete_from_table(t.spark, f"{base}/out", prop("n", "bigint") % 3 == 0, end="2024-01-20")
    lifecycle.compact_table(t.spark, f"{base}/out")
    lifecycle.delete_from_table(t.spark, f"{base}/out", start="2024-01-25")
    return t.spark.read.parquet(f"{base}/out").select(prop("n", "bigint").alias("n"))


@query("retain_in_table", "SELECT id, level FROM stream WHERE ts >= TIMESTAMP '2024-01-11' AND NOT (ts < TIMESTAMP '2024-01-21' AND level = 'warn')", STREAM_SQL)
def retain_in_table(t):
    path = scratch_path(t.spark, "retain")
    sinks.write_events(t.stream.select("id", "ts", "level"), path)
    policies = [lifecycle.RetentionPolicy("20d"), lifecycle.RetentionPolicy("10d", catalogue()["Warnings"])]
    lifecycle.retain_in_table(t.spark, path, policies, "2024-01-31")
    return t.spark.read.parquet(path).select("id", "level")
