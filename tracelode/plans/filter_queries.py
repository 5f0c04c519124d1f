"""Search, signals, property tests, projections and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values as v
from ..functions.aggregates import count_all
from ..functions.logic import is_member
from ..functions.text import like_text
from ..operators import filters, query as q
from ..operators.signals import Signal, by_property, by_template, catalogue, intersect, level_in, union, WARNING_SPELLINGS
from .benchmark_queries import stamp, stamp_sql
from .registry import query
from .views import LOGS_SQL, SPANS_SQL, STREAM_SQL


@query("search_newest", f"""SELECT id, {stamp_sql("ts")} AS ts, message FROM stream
    WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' AND level = 'Error'
    ORDER BY stream.ts DESC, id DESC LIMIT 50""", STREAM_SQL)
def search_newest(t):
    found = filters.search(t.stream, F.col("level") == "Error", "2024-01-05", "2024-01-25", limit=50)
    return found.select("id", stamp("ts"), "message")


@query("search_with_signal", f"""SELECT id, {stamp_sql("ts")} AS ts FROM stream
    WHERE lower(level) IN ('warn') AND value > 20 ORDER BY stream.ts DESC, id DESC""", STREAM_SQL)
def search_with_signal(t):
    found = filters.search(t.stream, F.col("value") > 20, signal=catalogue()["Warnings"])
    return found.select("id", stamp("ts"))


@query("time_range_scan", """SELECT id, level FROM stream WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'""",
       STREAM_SQL)
def time_range_scan(t):
    return filters.time_range(t.stream, "2024-01-10", "2024-01-12").select("id", "level")


@query("where_all", "SELECT id FROM stream WHERE value > 10 AND user_id < 100 AND event_type <> 'view'", STREAM_SQL)
def where_all(t):
    return filters.where_all(t.stream, F.col("value") > 10, F.col("user_id") < 100, F.col("event_type") != "view").select("id")


@query("signal_union", "SELECT id FROM stream WHERE level IN ('Error', 'warn')", STREAM_SQL)
def signal_union(t):
    stock = catalogue()
    return filters.apply_signal(t.stream, stock["Errors"] | stock["Warnings"]).select("id")


@query("signal_intersection", "SELECT id FROM stream WHERE level = 'Error' AND event_type = 'error' AND value > 50", STREAM_SQL)
def signal_intersection(t):
    both = intersect(catalogue()["Errors"], None, by_property("Error events", "event_type", "error"),
                     Signal("Dear", F.col("value") > 50))
    return filters.apply_signal(t.stream, both).select("id")


@query("signal_nested", """SELECT id FROM stream WHERE (level IN ('Error', 'warn')) AND user_id < 500
    OR exception IS NOT NULL AND value < 5""", STREAM_SQL)
def signal_nested(t):
    stock = catalogue()
    low = Signal("Low users", F.col("user_id") < 500)
    cheap = Signal("Cheap", F.col("value") < 5)
    return filters.apply_signal(t.stream, union(stock["Errors"] | stock["Warnings"]) & low | stock["Exceptions"] & cheap).select("id")


@query("signal_catalogue", """SELECT 'Errors' AS signal, count(*) AS n FROM stream WHERE level = 'Error'
    UNION ALL SELECT 'Warnings', count(*) FROM stream WHERE level = 'warn'
    UNION ALL SELECT 'Information', count(*) FROM stream WHERE level IN ('INF', 'Information')
    UNION ALL SELECT 'Exceptions', count(*) FROM stream WHERE exception IS NOT NULL
    UNION ALL SELECT 'Logs', count(*) FROM stream UNION ALL SELECT 'Spans', 0
    UNION ALL SELECT 'Success', 0 UNION ALL SELECT 'Bad Request', 0 UNION ALL SELECT 'Not Found', 0
    UNION ALL SELECT 'Internal Server Error', 0""", STREAM_SQL)
def signal_catalogue(t):
    from ..functions.aggregates import count_where
    from ..operators.signals import signal_column

    stock = catalogue()
    counts = t.stream.agg(*[count_where(signal_column(s)).alias(n) for n, s in stock.items()])
    names = ", ".join(f"'{n}', `{n}`" for n in stock)
    return counts.selectExpr(f"stack({len(stock)}, {names}) AS (signal, n)")


@query("signal_by_template", "SELECT id FROM stream WHERE message_template IN ('User {user_id} did click', 'User {user_id} did error')",
       STREAM_SQL)
def signal_by_template(t):
    picked = by_template("Clicks and errors", "User {user_id} did click", "User {user_id} did error")
    return filters.apply_signal(t.stream, picked).select("id")


@query("signal_status_class", """SELECT event_type, count(*) AS n FROM stream WHERE value >= 10 AND value < 20 GROUP BY 1""", STREAM_SQL)
def signal_status_class(t):
    from ..operators.signals import by_status

    return q.group_by(filters.apply_signal(t.stream, by_status("Tens", 10, 20, "value")), "event_type", {"n": count_all()})


@query("text_search", "SELECT id FROM stream WHERE contains(lower(message), 'user 42') OR contains(lower(exception), 'user 42')",
       STREAM_SQL)
def text_search(t):
    return filters.text_search(t.stream, "USER 42").select("id")


@query("text_search_documents", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the ')")
def text_search_documents(t):
    docs = t.table("documents").select("doc_id", F.col("text").alias("message"), F.lit(None).cast("string").alias("exception"))
    return filters.text_search(docs, "THE ").select("doc_id")


@query("property_path", "SELECT id, event_type AS kind, k FROM stream WHERE event_type = 'purchase'", STREAM_SQL)
def property_path(t):
    return (t.stream.where(v.prop("Detail.Origin.Kind") == "purchase")
            .select("id", v.prop("Detail.Origin.Kind").alias("kind"), v.prop("Detail.k", "bigint").alias("k")))


@query("wildcard_any", "SELECT id FROM stream WHERE user_id = 42 OR k = 42", STREAM_SQL)
def wildcard_any(t):
    items = v.prop("Items", "array<bigint>")
    return t.stream.where(v.some(items, lambda x: x == 42)).select("id")


@query("wildcard_all", "SELECT id FROM stream WHERE user_id < 40 AND k < 40", STREAM_SQL)
def wildcard_all(t):
    items = v.prop("Items", "array<bigint>")
    return t.stream.where(v.every(items, lambda x: x < 40)).select("id")


@query("has_and_null_tests", """SELECT count(*) AS present, count(*) FILTER (WHERE exception IS NULL) AS no_exception,
    CAST(0 AS BIGINT) AS missing, count(*) FILTER (WHERE exception IS NOT NULL) AS with_exception FROM stream""", STREAM_SQL)
def has_and_null_tests(t):
    return q.group_by(t.stream, aggs={
        "present": F.count_if(v.has_prop("user_id")), "no_exception": F.count_if(v.is_null(F.col("exception"))),
        "missing": F.count_if(v.has_prop("Nothing.Here")), "with_exception": F.count_if(v.is_not_null(F.col("exception")))})


@query("case_insensitive_filters", """SELECT id FROM stream WHERE lower(level) LIKE 'inf%' AND lower(event_type) IN ('click', 'signup')""",
       STREAM_SQL)
def case_insensitive_filters(t):
    return filters.where_all(t.stream, like_text(F.col("level"), "INF%", ci=True),
                             is_member(F.col("event_type"), ["CLICK", "Signup"], ci=True)).select("id")


@query("events_in_trace", f"""SELECT id, {stamp_sql("ts")} AS ts FROM logs WHERE trace_id = '00000000000000000000000000000003'""", LOGS_SQL)
def events_in_trace(t):
    return filters.events_in_trace(t.logs, "00000000000000000000000000000003").select("id", stamp("ts"))


@query("one_span_of_trace", f"""SELECT service, message, {stamp_sql("start")} AS start FROM spans
    WHERE trace_id = '00000000000000000000000000000003' AND span_id = 'a000000000000002'""", SPANS_SQL)
def one_span_of_trace(t):
    return filters.events_in_trace(t.spans, "00000000000000000000000000000003", "a000000000000002").select(
        "service", "message", stamp("start"))


@query("bounded_by_start", f"SELECT count(*) AS n FROM stream WHERE ts >= TIMESTAMP '2024-01-20'", STREAM_SQL)
def bounded_by_start(t):
    return q.group_by(filters.bounded(t.stream, start="2024-01-20"), aggs={"n": count_all()})


@query("select_columns", "SELECT id, round(value * 2, 4) AS twice, upper(level) AS level_name FROM stream", STREAM_SQL)
def select_columns(t):
    return q.select_columns(t.stream, "id", twice=F.round(F.col("value") * 2, 4), level_name=F.upper("level"))


@query("conditional", "SELECT id, CASE WHEN value > 50 THEN 'high' WHEN value > 10 THEN 'middle' ELSE 'low' END AS band FROM stream", STREAM_SQL)
def conditional(t):
    return t.stream.select("id", F.when(F.col("value") > 50, "high").when(F.col("value") > 10, "middle").otherwise("low").alias("band"))


@query("let_bindings", "SELECT id, k * 2 + 1 AS odd, (k * 2 + 1) * 10 AS tens FROM stream", STREAM_SQL)
def let_bindings(t):
    bound = q.let(t.stream, double=F.col("k") * 2, odd=F.col("double") + 1, tens=F.col("odd") * 10)
    return bound.select("id", "odd", "tens")


@query("literals", """SELECT id, '[' || user_id || ',' || k || ']' AS list, '{"kind":"' || event_type || '","k":' || k || '}' AS object FROM stream""",
       STREAM_SQL)
def literals(t):
    return t.stream.select("id", F.to_json(F.array("user_id", "k")).alias("list"),
                           F.to_json(F.struct(F.col("event_type").alias("kind"), "k")).alias("object"))


@query("event_as_object", """SELECT doc_id, length(to_json({'doc_id': doc_id, 'lang': lang, 'source': source, 'n_chars': n_chars})) AS json_chars
    FROM documents""")
def event_as_object(t):
    return q.event_as_object(t.table("documents").select("doc_id", "lang", "source", "n_chars")).select("doc_id", "json_chars")


@query("latest_as_table", """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '0Z' AS timestamp, level, message, exception
    FROM stream ORDER BY ts DESC, id DESC LIMIT 10""", STREAM_SQL)
def latest_as_table(t):
    return q.latest_as_table(t.stream, 10).select("timestamp", "level", "message", "exception")


@query("distinct_values", "SELECT DISTINCT level, event_type FROM stream", STREAM_SQL)
def distinct_values(t):
    return q.distinct_values(t.stream, level=F.col("level"), event_type=F.col("event_type"))


@query("order_by_case_insensitive", """SELECT lang, source, n FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2)
    ORDER BY lower(source), source, lang LIMIT 1024""")
def order_by_case_insensitive(t):
    rows = q.group_by(t.table("documents"), ["lang", "source"], {"n": count_all()})
    return q.limit(q.order_by(rows, "source", "lang", ci=True), 1024)


@query("order_by_time", f"SELECT {stamp_sql('ts')} AS ts, id FROM stream ORDER BY stream.ts, id", STREAM_SQL)
def order_by_time(t):
    return q.order_by(t.stream.select("ts", "id"), "ts", "id").select(stamp("ts"), "id")


@query("limited_top_k", "SELECT id, value FROM stream ORDER BY value DESC, id DESC LIMIT 25", STREAM_SQL)
def limited_top_k(t):
    return q.top_k(t.stream.select("id", "value"), "value", "id", n=25, desc=True)


@query("warnings_or_spellings", "SELECT level, count(*) AS n FROM stream WHERE lower(level) IN ('w','wa','war','wrn','warn','warning') GROUP BY 1",
       STREAM_SQL)
def warnings_or_spellings(t):
    return q.group_by(t.stream.where(level_in(WARNING_SPELLINGS)), "level", {"n": count_all()})
