"""Property discovery, deletion, retention and space."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import prop, template_id_of
from ..operators import discovery, lifecycle
from ..operators.signals import catalogue
from .benchmark_queries import stamp, stamp_sql
from .registry import query
from .views import STREAM_SQL


@query("property_paths", """SELECT DISTINCT path FROM (SELECT unnest(list_filter([
      CASE WHEN event_type IS NOT NULL THEN 'event_type' END, CASE WHEN user_id IS NOT NULL THEN 'user_id' END, CASE WHEN value IS NOT NULL THEN 'value' END,
      'Detail', 'Items', CASE WHEN k IS NOT NULL THEN 'Detail.k' END, CASE WHEN id IS NOT NULL THEN 'Detail.Origin' END,
      CASE WHEN event_type IS NOT NULL THEN 'Detail.Origin.Kind' END], lambda p: p IS NOT NULL)) AS path FROM stream)""", STREAM_SQL)
def property_paths(t):
    return discovery.property_paths(t.stream)


@query("property_paths_from_names", """SELECT path FROM (
    SELECT DISTINCT '@Scope[''' || p_name || ''']' AS path FROM part WHERE contains(p_name, ' ')
    UNION SELECT DISTINCT '@Scope[''' || p_name || '''].size' FROM part WHERE contains(p_name, ' '))""")
def property_paths_from_names(t):
    rows = t.table("part").select(F.to_variant_object(F.map_from_arrays(
        F.array("p_name"), F.array(F.struct(F.col("p_size").alias("size"))))).alias("scope"))
    return discovery.property_paths(rows)


@query("available_properties", """SELECT DISTINCT name FROM (SELECT unnest(list_filter([CASE WHEN event_type IS NOT NULL THEN 'event_type' END,
      CASE WHEN user_id IS NOT NULL THEN 'user_id' END, CASE WHEN value IS NOT NULL THEN 'value' END, 'Detail', 'Items'], lambda p: p IS NOT NULL)) AS name FROM stream)""", STREAM_SQL)
def available_properties(t):
    return discovery.available_properties(t.stream)


# DuckDB has no CRC-32: the type ids of the five templates of the given events.
TYPE_IDS_SQL = " ".join(f"WHEN '{kind}' THEN {template_id_of(f'User {{user_id}} did {kind}')}" for kind in ("click", "error", "purchase", "signup", "view"))


@query("space_by_template", f"""SELECT count(*) AS occurrences, CAST(sum(length('{{"id":"' || id || '","message_template":"' || message_template || '","level":"' || level
      || '","user_id":' || user_id || ',"event_type_id":' || CASE event_type {TYPE_IDS_SQL} END || '}}')) AS BIGINT) AS total_chars, message_template FROM stream GROUP BY message_template""", STREAM_SQL)
def space_by_template(t):
    # Only text and whole numbers: engines print fractions and times in their own ways.
    rows = discovery.space_by_template(t.stream.select("id", "message_template", "level", "user_id", "event_type_id"))
    return rows.select("occurrences", "total_chars", "message_template")


@query("space_report")
def space_report(t):
    return discovery.space_by_template(t.stream)


@query("delete_by_filter", "SELECT id FROM stream WHERE NOT (event_type = 'view' AND value < 30)", STREAM_SQL)
def delete_by_filter(t):
    return lifecycle.delete_events(t.stream, (prop("event_type") == "view") & (F.col("value") < 30)).select("id")


@query("delete_by_range", f"SELECT id, {stamp_sql('ts')} AS ts FROM stream WHERE NOT (ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-20')", STREAM_SQL)
def delete_by_range(t):
    return lifecycle.delete_events(t.stream, start="2024-01-08", end="2024-01-20").select("id", stamp("ts"))


@query("delete_by_signal", "SELECT id FROM stream WHERE NOT (level = 'Error' AND ts >= TIMESTAMP '2024-01-08')", STREAM_SQL)
def delete_by_signal(t):
    return lifecycle.delete_events(t.stream, start="2024-01-08", signal=catalogue()["Errors"]).select("id")


@query("retention", """SELECT id FROM stream WHERE ts >= TIMESTAMP '2024-01-06' AND NOT (ts < TIMESTAMP '2024-01-24' AND level IN ('INF', 'Information'))""", STREAM_SQL)
def retention(t):
    policies = [lifecycle.RetentionPolicy("25d"), lifecycle.RetentionPolicy("7d", catalogue()["Information"])]
    return lifecycle.apply_retention(t.stream, policies, "2024-01-31").select("id")
