"""Lateral joins, span joins, trees and latency."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.aggregates import count_all
from ..functions.values import prop
from ..operators import joins, query as q, tracing
from .benchmark_queries import stamp, stamp_sql
from .registry import query
from .views import HISTOGRAM_CELLS_SQL, LOGS_SQL, SPANS_SQL, STREAM_SQL


HELD_SPANS_SQL = SPANS_SQL + ", held AS MATERIALIZED (SELECT trace_id, span_id, parent_id, service, message FROM spans)"


@query("lateral_unnest", "SELECT id, unnest([user_id, k]) AS item FROM stream", STREAM_SQL)
def lateral_unnest(t):
    return joins.lateral_unnest(t.stream, prop("Items", "array<bigint>"), "item").select("id", "item")


@query("lateral_unnest_words", """SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(string_split(line, ' ')) AS word
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY 1, 2""")
def lateral_unnest_words(t):
    documents = joins.brought_together(t.table("documents").select("doc_id", "text"), "doc_id", "text")
    lines = joins.lateral_unnest(documents, F.split("text", "\n"), "line")
    words = joins.lateral_unnest(lines, F.split("line", " "), "word")
    return q.group_by(words, ["doc_id", "word"], {"n": count_all()})


@query("lateral_buckets", """SELECT event_type, CASE WHEN cell > 0 THEN cell * 10.0 END::DOUBLE AS low, sum(n)::BIGINT AS n FROM cells GROUP BY 1, 2""", HISTOGRAM_CELLS_SQL)
def lateral_buckets(t):
    rows = joins.lateral_unnest(t.histograms, "buckets", "bucket")
    return q.group_by(rows, {"event_type": F.col("event_type"), "low": F.col("bucket.from")}, {"n": F.sum("bucket.count")})


@query("span_parents", """SELECT s.span_id, s.trace_id, p.service AS parent_service, p.message AS parent_message
    FROM held s LEFT JOIN held p ON s.trace_id = p.trace_id AND s.parent_id = p.span_id""", HELD_SPANS_SQL)
def span_parents(t):
    return joins.span_parents(t.spans, ("service", "message")).select("span_id", "trace_id", "parent_service", "parent_message")


@query("logs_in_spans", """SELECT l.id, l.level, s.service AS span_service, s.message AS span_message
    FROM logs l JOIN spans s ON l.trace_id = s.trace_id AND l.span_id = s.span_id""", LOGS_SQL + ", " + SPANS_SQL)
def logs_in_spans(t):
    return joins.logs_in_spans(t.logs, t.spans, ("service", "message")).select("id", "level", "span_service", "span_message")


@query("orphan_spans", """SELECT k.span_id, k.parent_id FROM kept k LEFT JOIN kept p ON p.trace_id = k.trace_id AND p.span_id = k.parent_id
    WHERE k.parent_id IS NOT NULL AND p.span_id IS NULL""", SPANS_SQL + ", kept AS MATERIALIZED (SELECT trace_id, span_id, parent_id FROM spans WHERE service <> '1-URGENT')")
def orphan_spans(t):
    return joins.orphan_spans(t.spans.where(F.col("service") != "1-URGENT")).select("span_id", "parent_id")


@query("traces_with", """SELECT trace_id, count(*) AS n FROM spans WHERE trace_id IN (SELECT trace_id FROM spans WHERE elapsed_us > 499500000
    AND span_kind = 'Client') GROUP BY 1""", SPANS_SQL)
def traces_with(t):
    slow = (F.col("elapsed_us") > 499_500_000) & (F.col("span_kind") == "Client")
    return q.group_by(joins.traces_with(t.spans, slow), "trace_id", {"n": count_all()})


@query("with_elapsed", """SELECT span_id, elapsed_us FROM spans""", SPANS_SQL)
def with_elapsed(t):
    return tracing.with_elapsed(t.spans.drop("elapsed_us")).select("span_id", "elapsed_us")


@query("trace_spans", f"""SELECT span_id, parent_id, service, message AS span_name, span_kind AS kind, {stamp_sql("start")} AS start,
    strftime(start, '%Y-%m-%dT%H:%M:%S.%f') || '0Z' AS start_iso, elapsed_us / 1000.0 AS ms FROM spans
    WHERE trace_id = '00000000000000000000000000000005' ORDER BY spans.start, span_id""", SPANS_SQL)
def trace_spans(t):
    rows = tracing.trace_spans(t.spans, "00000000000000000000000000000005")
    return rows.select("span_id", "parent_id", "service", "span_name", "kind", stamp("start"), "start_iso", "ms")


@query("trace_tree", """SELECT trace_id, span_id, depth, path FROM tree""",
       "RECURSIVE " + SPANS_SQL + """, tree AS (
  SELECT trace_id, span_id, 0 AS depth, span_id AS path FROM spans WHERE parent_id IS NULL
  UNION ALL SELECT s.trace_id, s.span_id, t.depth + 1, t.path || '/' || s.span_id FROM spans s JOIN tree t ON s.trace_id = t.trace_id AND s.parent_id = t.span_id)""")
def trace_tree(t):
    return tracing.trace_tree(t.spans)


@query("latency_by_service", """SELECT service, spans, floor(p_us / 1000 * 100.0 + 0.5) / 100.0 AS p_ms, floor(max_us / 1000 * 100.0 + 0.5) / 100.0 AS max_ms FROM (
    SELECT service, max(total) AS spans, min(us) FILTER (WHERE rn >= greatest(1, ceil(95 * total / 100.0))) AS p_us, max(us) AS max_us FROM (
      SELECT service, CAST(elapsed_us AS DOUBLE) AS us, row_number() OVER (PARTITION BY service ORDER BY elapsed_us) AS rn, count(*) OVER (PARTITION BY service) AS total
      FROM spans) GROUP BY 1) ORDER BY p_ms DESC, service""", SPANS_SQL)
def latency_by_service(t):
    return tracing.latency_by_service(t.spans)
