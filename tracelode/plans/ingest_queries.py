"""Lines, framing, extraction, event building, validation and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.aggregates import count_all
from ..functions.levels import normalise_level, severity_of
from ..functions.values import prop
from ..operators import extraction as ex, ingest, query as q, sinks
from ..operators.framing import frame_lines, frame_parts
from ..session import scratch_path
from ..sources import clef
from ..sources.lines import read_lines
from .benchmark_queries import stamp, stamp_sql
from .registry import query
from .views import LEVEL_SQL, STREAM_SQL

PATTERN = "{@t:timestamp} [{@l:level}] {@m:*}{:n}{@x:*}"

LOG_SQL = f"""logs AS (SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'web' ELSE 'app' END AS source, ts,
  {LEVEL_SQL} AS level, CASE event_type WHEN 'error' THEN 'Error' WHEN 'purchase' THEN 'Warning' WHEN 'view' THEN 'Debug'
    ELSE 'Information' END AS full_level,
  'User ' || user_id || ' did ' || event_type || ' at ' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) AS message,
  CASE WHEN event_type = 'error' THEN 'TimeoutError: user ' || user_id || chr(10) || '   at step ' || json_extract_string(props, '$.k') END AS exception,
  user_id, event_type, value FROM events)"""

RECORD_START = r"\A\d{4}-\d\d-\d\d \d\d:"


@query("read_lines", """SELECT 'events' AS source, count(*) AS lines, CAST(sum(length(props)) AS BIGINT) AS chars FROM events""")
def line_totals(t):
    path = scratch_path(t.spark, "lines")
    t.events.select("props").write.text(path)
    return q.group_by(read_lines(t.spark, path), {"source": F.lit("events")}, {"lines": count_all(), "chars": F.sum(F.length("line"))})


@query("frame_log_lines", f"""SELECT source, event_id * 8 AS frame_start, CASE WHEN exception IS NULL THEN 1 ELSE 3 END AS n_lines,
    false AS is_orphan, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ' +00:00 [' || level || '] ' || message || chr(10)
      || CASE WHEN exception IS NULL THEN '' ELSE exception || chr(10) END AS text FROM logs""", LOG_SQL)
def frame_log_lines(t):
    return frame_lines(t.log_lines, RECORD_START).select("source", "frame_start", F.col("n_lines").cast("int"), "is_orphan", "text")


@query("frame_log_parts", f"""SELECT source, frame_start, part::INT AS part, substr(text, part * 60 + 1, 60) AS text FROM (SELECT *, unnest(range((length(text) + 59) // 60)) AS part FROM (
    SELECT source, event_id * 8 AS frame_start, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ' +00:00 [' || level || '] ' || message || chr(10)
      || CASE WHEN exception IS NULL THEN '' ELSE exception || chr(10) END AS text FROM logs))""", LOG_SQL)
def frame_log_parts(t):
    return frame_parts(t.log_lines, RECORD_START, 60).select("source", "frame_start", "part", "text")


DOCUMENT_LINES_SQL = """lines AS (
  SELECT source, doc_id * 1048576 + n - 1 AS line_no, line, regexp_matches(line, '^[A-Z]') AS opens FROM (
    SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line,
      generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)),
owned AS (SELECT *, max(CASE WHEN opens THEN line_no END) OVER (PARTITION BY source ORDER BY line_no) AS owner FROM lines)"""


@query("frame_document_lines", """SELECT source, coalesce(owner, line_no) AS frame_start, owner IS NULL AS is_orphan,
    count(*) AS n_lines, md5(string_agg(line || chr(10), '' ORDER BY line_no)) AS digest
    FROM owned GROUP BY 1, 2, 3""", DOCUMENT_LINES_SQL)
def frame_document_lines(t):
    lines = t.table("documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    lines = lines.select("source", (F.col("doc_id") * 1_048_576 + F.col("n")).alias("line_no"), "line")
    frames = frame_lines(lines, r"\A[A-Z]")
    return frames.select("source", "frame_start", "is_orphan", "n_lines", F.md5("text").alias("digest"))


@query("extract_log_fields", f"""SELECT event_id, {stamp_sql("ts")} AS ts, full_level AS level, message,
    CASE WHEN exception IS NOT NULL THEN exception || chr(10) END AS exception, CAST(NULL AS VARCHAR) AS unmatched FROM logs""", LOG_SQL)
def extract_log_fields(t):
    framed = t.log_text.withColumn("text", F.concat("text", F.lit("\n")))
    fields = ex.extract_fields(framed, PATTERN, keep=("event_id",))
    return fields.select("event_id", stamp("`@t`", "ts"), F.col("`@l`").alias("level"), F.col("`@m`").alias("message"),
                         F.col("`@x`").alias("exception"), "unmatched")


@query("extract_framed_events", f"""SELECT {stamp_sql("ts")} AS ts, full_level AS level, message,
    CASE WHEN exception IS NOT NULL THEN exception || chr(10) END AS exception FROM logs""", LOG_SQL)
def extract_framed_events(t):
    start = ex.compile_pattern(PATTERN).start
    frames = frame_lines(t.log_lines, start).where(~F.col("is_orphan")).select("text")
    events = ingest.build_events(ex.extract_fields(frames, PATTERN, keep=()))
    return events.select(stamp("ts"), "level", "message", "exception")


@query("extract_unmatched", f"""SELECT event_id, level AS first, 'at ' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR)
      || CASE WHEN exception IS NULL THEN '' ELSE chr(10) || exception END AS unmatched, event_type AS kind, user_id AS number FROM logs""", LOG_SQL)
def extract_unmatched(t):
    fields = ex.extract_fields(t.log_text, "{:*}[{first:ident}] User {number:nat} did {kind:alpha} {:nat}", keep=("event_id",))
    return fields.select("event_id", "first", "unmatched", "kind", F.col("number").cast("bigint"))


@query("extract_lookahead", """SELECT event_id, user_id || '] [' || event_type AS inside, value FROM events""")
def extract_lookahead(t):
    text = t.events.select("event_id", F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit("] ["), F.col("event_type"),
                                                F.lit("] = "), F.col("value").cast("string")).alias("text"))
    fields = ex.extract_fields(text, "[{inside:**}] = {value:dec}", keep=("event_id",))
    return fields.select("event_id", "inside", F.col("value").cast("double"))


@query("extract_groups", """SELECT event_id, 'did ' || event_type || ' #' || user_id AS action, event_type AS kind, user_id AS number FROM events""")
def extract_groups(t):
    text = t.events.select("event_id", F.concat(F.lit("did "), F.col("event_type"), F.lit(" #"), F.col("user_id").cast("string"),
                                                F.lit(" done")).alias("text"))
    fields = ex.extract_fields(text, "{action:=did {kind:alpha} #{number:int}}{:s}done", keep=("event_id",))
    return fields.select("event_id", "action", "kind", "number")


@query("extract_document_lead", """SELECT doc_id, nullif(regexp_extract(text, '^([^\\s\\p{Z}]+)', 1), '') AS first_word,
    nullif(regexp_extract(text, '^[^\\s\\p{Z}]+[ \\t]+([^\\r\\n]+)', 1), '') AS rest_of_line FROM documents""".replace("\\\\", "\\"))
def extract_document_lead(t):
    fields = ex.extract_fields(t.table("documents"), "{first_word}{:s}{rest_of_line:line}{:*}", keep=("doc_id",))
    return fields.select("doc_id", "first_word", "rest_of_line")


@query("match_plain_types", """SELECT event_id, event_type AS ident, user_id AS nat, -user_id AS int, value AS dec, event_type AS alpha,
    event_type || user_id AS alphanum, event_type || '#' || user_id AS token FROM events""")
def match_plain_types(t):
    kind, user, value = F.col("event_type"), F.col("user_id").cast("string"), F.col("value").cast("string")
    text = F.concat_ws(" ", kind, user, F.concat(F.lit("-"), user), value, kind, F.concat(kind, user), F.concat(kind, F.lit("#"), user))
    pattern = "{ident:ident} {nat:nat} {int:int} {dec:dec} {alpha:alpha} {alphanum:alphanum} {token:token}"
    fields = ex.extract_fields(t.events.select("event_id", text.alias("text")), pattern, keep=("event_id",))
    return fields.select("event_id", "ident", F.col("nat").cast("bigint"), "int", F.col("dec").cast("double"), "alpha", "alphanum", "token")


@query("match_date_types", f"""SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.%f') AS iso,
    strftime(ts - INTERVAL '10 hours', '%Y-%m-%d %H:%M:%S.%f') AS spaced, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.%f') AS w3c,
    strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.%f') AS unix, strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S.%f') AS unix_ms,
    strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.%f') AS syslog FROM events""")
def match_date_types(t):
    ts = F.col("ts").cast("timestamp")
    text = F.concat_ws("\t", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS' +10:00'"),
                       F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.unix_seconds(ts).cast("string"), F.unix_millis(ts).cast("string"),
                       F.concat(F.date_format(ts, "MMM "), F.lpad(F.date_format(ts, "d"), 2, " "), F.date_format(ts, " HH:mm:ss")))
    pattern = "{iso:iso8601dt}{:t}{spaced:serilogdt}{:t}{w3c:w3cdt}{:t}{unix:unixdt}{:t}{unix_ms:unixdt}{:t}{syslog:syslogdt}"
    fields = ex.extract_fields(t.events.select("event_id", text.alias("text")), pattern, reference_time="2024-06-01", keep=("event_id",))
    return fields.select("event_id", *[stamp(c) for c in ("iso", "spaced", "w3c", "unix", "unix_ms", "syslog")])


@query("match_trailing_content", """SELECT doc_id, CASE WHEN regexp_matches(text, '^[^\\s]') THEN length(text) END AS chars FROM documents""".replace("\\\\", "\\"))
def match_trailing_content(t):
    fields = ex.extract_fields(t.table("documents"), "{@m:trailingindent}", keep=("doc_id",))
    return fields.select("doc_id", F.length("`@m`").cast("bigint").alias("chars"))


@query("build_events", f"""SELECT event_id, {stamp_sql("ts")} AS ts, full_level AS level,
    CASE full_level WHEN 'Error' THEN 4 WHEN 'Warning' THEN 3 WHEN 'Debug' THEN 1 ELSE 2 END AS severity, 'User' AS message,
    user_id AS number, event_type AS kind FROM logs""", LOG_SQL)
def build_events(t):
    fields = ex.extract_fields(t.log_text, "{@t:timestamp} [{@l:level}] {@m:alpha} {number:int} did {kind:alpha}", keep=("event_id",))
    events = ingest.build_events(fields, reference_time="2024-01-01", keep=("event_id",))
    return events.select("event_id", stamp("ts"), "level", "severity", "message", prop("number", "bigint").alias("number"), prop("kind").alias("kind"))


@query("parse_clef", f"""SELECT event_id, {stamp_sql("ts")} AS ts, CASE WHEN event_type = 'click' THEN 'Information' ELSE {LEVEL_SQL} END AS level,
    'User ' || user_id || ' did ' || event_type AS message, 'User {{user_id}} did {{event_type}}' AS message_template,
    CASE WHEN event_type = 'error' THEN 'TimeoutError: user ' || user_id END AS exception, printf('%032x', user_id + 1) AS trace_id, value FROM events""")
def parse_clef(t):
    events = clef.parse_clef(t.clef_lines)
    return events.select(prop("event_id", "bigint").alias("event_id"), stamp("ts"), "level", "message", "message_template", "exception",
                         "trace_id", prop("value", "double").alias("value"))


@query("validate_clef", """SELECT event_id, CASE event_type WHEN 'view' THEN 'no time' WHEN 'error' THEN 'not JSON'
    WHEN 'signup' THEN 'a time that cannot be read' WHEN 'purchase' THEN 'JSON, but not an object' END AS reason FROM events""")
def validate_clef(t):
    return clef.validate_clef(t.raw_lines).select("event_id", "reason")


@query("validate_size_limit", """SELECT doc_id, CASE WHEN strlen(to_json({'t': text})) + 1 > 4096 THEN 'longer than an event may be' END AS reason FROM documents""")
def validate_size_limit(t):
    line = F.to_json(F.struct(F.col("text").alias("@t")))
    checked = t.table("documents").select("doc_id", F.when(
        clef.rejection_reason(line, 4096) == clef.TOO_LARGE, clef.TOO_LARGE).alias("reason"))
    return checked


@query("rejection_log", """SELECT CASE event_type WHEN 'view' THEN 'no time' WHEN 'error' THEN 'not JSON'
    WHEN 'signup' THEN 'a time that cannot be read' ELSE 'JSON, but not an object' END AS reason, event_type AS source, count(*) AS n, max(event_id) AS latest,
    CASE event_type WHEN 'view' THEN '{"n":' || max(event_id) || '}' WHEN 'error' THEN '{"n":' || max(event_id)
      WHEN 'signup' THEN '{"@t":"not a time ' || max(event_id) || '"}' ELSE '["' || max(event_id) || '"]' END AS document_start
    FROM events WHERE event_type <> 'click' GROUP BY event_type""")
def rejection_log(t):
    _, rejected = clef.split_valid(t.raw_lines)
    return clef.rejection_log(rejected, at="event_id")


@query("add_properties", "SELECT id, 'Production' AS environment, 17 AS user_id, true AS checked, event_type FROM stream", STREAM_SQL)
def add_properties(t):
    rows = ingest.add_properties(t.stream, {"Environment": "Production", "user_id": "17", "Checked": "true", "Empty": ""})
    return rows.select("id", prop("Environment").alias("environment"), prop("user_id", "int").alias("user_id"),
                       prop("Checked", "boolean").alias("checked"), prop("event_type").alias("event_type"))


@query("override_level", "SELECT 'FATAL' AS level, 5 AS severity, count(*) AS n FROM stream GROUP BY 1, 2", STREAM_SQL)
def override_level(t):
    return q.group_by(ingest.override_level(t.stream, "FATAL"), ["level", "severity"], {"n": count_all()})


@query("set_template", "SELECT 'Event {event_type}' AS message_template, 'Event ' || event_type AS message, count(*) AS n FROM stream GROUP BY 1, 2", STREAM_SQL)
def set_template(t):
    rows = ingest.render_messages(ingest.set_template(t.stream, "Event {event_type}"))
    return q.group_by(rows, ["message_template", "message"], {"n": count_all()})


@query("normalise_levels", """SELECT p_partkey, CASE lower(letter) WHEN 't' THEN 'Trace' WHEN 'v' THEN 'Verbose' WHEN 'd' THEN 'Debug' WHEN 'i' THEN 'Information'
    WHEN 'w' THEN 'Warning' WHEN 'e' THEN 'Error' WHEN 'f' THEN 'Fatal' WHEN 'c' THEN 'Critical' ELSE letter END AS level
    FROM (SELECT p_partkey, substr(p_type, 1, 1) AS letter FROM part)""")
def normalise_levels(t):
    return t.table("part").select("p_partkey", normalise_level(F.substring("p_type", 1, 1)).alias("level"))


@query("filter_ingest", "SELECT count(*) AS n FROM stream WHERE severity >= 3", STREAM_SQL)
def filter_ingest(t):
    return q.group_by(ingest.filter_ingest(t.stream, severity_of(F.col("level")) >= 3), aggs={"n": count_all()})


@query("ingest_policies", """SELECT id, CASE WHEN event_type = 'view' THEN '2024-03-01 00:00:00.000000' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS ts,
    CASE WHEN event_type = 'purchase' THEN 'shop' END AS origin FROM stream
    WHERE (event_type <> 'click' OR value > 20) AND (event_type <> 'signup' OR severity >= 3)""", STREAM_SQL)
def ingest_policies(t):
    policies = [ingest.IngestPolicy("click", filter=F.col("value") > 20), ingest.IngestPolicy("signup", minimum_level="Warning"),
                ingest.IngestPolicy("purchase", properties={"Origin": "shop"}), ingest.IngestPolicy("view", use_server_time=True)]
    rows = ingest.apply_ingest_policies(t.stream, policies, "event_type", F.lit("2024-03-01").cast("timestamp"))
    return rows.select("id", stamp("ts"), prop("Origin").alias("origin"))


@query("unflatten", """SELECT c_custkey, c_name AS name, c_mktsegment AS segment, c_acctbal AS kept FROM customer""")
def unflatten(t):
    flat = t.table("customer").select(
        "c_custkey", F.col("c_name").alias("Customer.Name"), F.col("c_mktsegment").alias("Customer.Market.Segment"),
        F.col("c_nationkey").alias("Balance"), F.col("c_acctbal").alias("Balance.Amount"))
    nested = ingest.unflatten(flat)
    return nested.select("c_custkey", F.col("Customer.Name").alias("name"), F.col("Customer.Market.Segment").alias("segment"),
                         F.col("`Balance.Amount`").alias("kept"))


@query("sanitise_trace_ids", """SELECT o_orderkey, CASE WHEN o_orderkey > 0 THEN printf('%032x', o_orderkey) END AS trace_id,
    CASE WHEN o_orderstatus = 'F' AND o_orderkey > 0 THEN printf('%016x', o_orderkey) END AS span_id FROM orders""")
def sanitise_trace_ids(t):
    rows = t.table("orders").select("o_orderkey", F.format_string("%032x", "o_orderkey").alias("trace_id"),
                                    F.when(F.col("o_orderstatus") == "F", F.format_string("%016x", "o_orderkey"))
                                    .when(F.col("o_orderstatus") == "O", F.format_string("%015x", "o_orderkey"))
                                    .otherwise(F.format_string("%015xG", "o_orderkey")).alias("span_id"))
    return ingest.sanitise_trace_ids(rows)


@query("render_messages", """SELECT id, '{Order} ' || event_type || ' by ' || user_id || ' {Missing} 100%' AS message FROM stream""", STREAM_SQL)
def render_messages(t):
    rows = t.stream.withColumn("message_template", F.lit("{{Order}} {event_type} by {@user_id:000} {Missing} 100%"))
    return ingest.render_messages(rows).select("id", "message")


@query("arrival_order", f"SELECT id, {stamp_sql('ts')} AS ts, id AS second FROM stream", STREAM_SQL)
def arrival_order(t):
    rows = ingest.arrival_order(t.stream.select("id", "ts"), "ts", "id")
    return rows.select("id", stamp("arrived.ts", "ts"), F.col("arrived.id").alias("second"))


@query("clef_export", """SELECT '{"@l":"Error","@mt":"User {user_id} did error","@t":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '0Z","@x":"' || exception || '","id":"'
    || id || '","user":' || user_id || '}' AS line FROM stream WHERE level = 'Error'
    UNION ALL SELECT '{"@l":"' || level || '","@mt":"User {user_id} did ' || event_type || '","@t":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '0Z","id":"' || id || '","user":' || user_id || '}'
    FROM stream WHERE level NOT IN ('Error', 'Information')
    UNION ALL SELECT '{"@mt":"User {user_id} did signup","@t":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '0Z","id":"' || id || '","user":' || user_id || '}'
    FROM stream WHERE level = 'Information'""", STREAM_SQL)
def clef_export(t):
    rows = t.stream.select(
        "ts", "level", "message_template", "exception",
        F.to_variant_object(F.struct("id", F.col("user_id").alias("user"))).alias("properties"))
    return rows.select(sinks.clef_line(rows).alias("line"))


@query("csv_export", """SELECT '"' || c_custkey || '","' || replace('say "' || c_name || '"', '"', '""') || '","'
    || CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END || '","null"' AS line FROM customer""")
def csv_export(t):
    rows = t.table("customer").select("c_custkey", F.concat(F.lit('say "'), F.col("c_name"), F.lit('"')).alias("quote"),
                                      (F.col("c_acctbal") > 0).alias("positive"), F.lit(None).cast("string").alias("nothing"))
    return sinks.csv_cells(rows).select(sinks.csv_line(rows).alias("line"))
