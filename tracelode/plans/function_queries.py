"""One query per scalar function or operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import levels, logic, numbers as n, text as x, times as tm, values as v
from ..operators import query as q
from .benchmark_queries import stamp
from .registry import query
from .views import STREAM_SQL


@query("fn_concat", "SELECT id, event_type || '/' || level AS joined FROM stream", STREAM_SQL)
def fn_concat(t):
    return t.stream.select("id", x.concat_text(F.col("event_type"), "/", F.col("level")).alias("joined"))


@query("fn_text_tests", """SELECT id, contains(message, 'did c') AS has_part, starts_with(message, 'User 9') AS starts,
    ends_with(message, 'error') AS ends, contains(lower(message), 'did c') AS has_part_ci,
    starts_with(lower(level), 'in') AS starts_ci, ends_with(lower(level), 'or') AS ends_ci FROM stream""", STREAM_SQL)
def fn_text_tests(t):
    message, level = F.col("message"), F.col("level")
    return t.stream.select(
        "id", x.contains_text(message, "did c").alias("has_part"), x.starts_with(message, "User 9").alias("starts"),
        x.ends_with(message, "error").alias("ends"), x.contains_text(message, "DID C", ci=True).alias("has_part_ci"),
        x.starts_with(level, "IN", ci=True).alias("starts_ci"), x.ends_with(level, "OR", ci=True).alias("ends_ci"))


@query("fn_positions", """SELECT doc_id, instr(text, 'en') - 1 AS first_at, instr(lower(text), 'en') - 1 AS first_ci,
    CASE WHEN contains(text, 'en') THEN length(text) - 2 - instr(reverse(text), 'ne') + 1 ELSE -1 END AS last_at,
    length(text) AS size FROM documents""")
def fn_positions(t):
    text = F.col("text")
    return t.table("documents").select(
        "doc_id", x.index_of(text, "en").alias("first_at"), x.index_of(text, "EN", ci=True).alias("first_ci"),
        x.last_index_of(text, "en").alias("last_at"), x.length_of(text).alias("size"))


@query("fn_replace", r"""SELECT id, replace(message, 'User', 'Account') AS plain, regexp_replace(message, 'user', 'x$', 'gi') AS ci,
    regexp_replace(message, '([0-9]+) did', '<\1>$\0', 'g') AS regex FROM stream""", STREAM_SQL)
def fn_replace(t):
    message = F.col("message")
    return t.stream.select(
        "id", x.replace_text(message, "User", "Account").alias("plain"), x.replace_text(message, "user", "x$", ci=True).alias("ci"),
        x.replace_text(message, "([0-9]+) did", "<$1>$$$0", regex=True).alias("regex"))


@query("fn_substring", """SELECT doc_id, CASE WHEN length(text) >= 10 THEN substr(text, 11) END AS tail,
    CASE WHEN length(text) >= 5 THEN substr(text, 6, 20) END AS part, CAST(NULL AS VARCHAR) AS undefined FROM documents""")
def fn_substring(t):
    text = F.col("text")
    return t.table("documents").select(
        "doc_id", x.substring_of(text, 10).alias("tail"), x.substring_of(text, 5, 20).alias("part"),
        x.substring_of(text, -1).alias("undefined"))


@query("fn_case", "SELECT DISTINCT lower(level) AS low, upper(level) AS up FROM stream", STREAM_SQL)
def fn_case(t):
    return t.stream.select(x.to_lower(F.col("level")).alias("low"), x.to_upper(F.col("level")).alias("up")).distinct()


@query("fn_like", r"""SELECT id, message LIKE '%did c%' AS any_text, regexp_full_match(message, 'User .? did .*') AS short_id,
    lower(level) LIKE '%n%' AS ci, NOT message LIKE 'User 1%' AS unlike FROM stream""", STREAM_SQL)
def fn_like(t):
    message = F.col("message")
    return t.stream.select(
        "id", x.like_text(message, "%did c%").alias("any_text"), x.like_text(message, "User ? did %").alias("short_id"),
        x.like_text(F.col("level"), "%N%", ci=True).alias("ci"),
        logic.op_not(x.like_text(message, "User 1%")).alias("unlike"))


@query("fn_matches_regex", r"""SELECT id, regexp_full_match(message, 'User [0-9]{1,2} did (click|view)') AS hit,
    regexp_full_match(lower(level), 'err.*') AS hit_ci FROM stream""", STREAM_SQL)
def fn_matches_regex(t):
    return t.stream.select("id", x.matches_regex(F.col("message"), "User [0-9]{1,2} did (click|view)").alias("hit"),
                           x.matches_regex(F.col("level"), "ERR.*", ci=True).alias("hit_ci"))


@query("fn_hex", "SELECT id, '0x' || upper(to_hex(user_id)) AS hex FROM stream", STREAM_SQL)
def fn_hex(t):
    return t.stream.select("id", x.to_hex_string(F.col("user_id") + 0.7).alias("hex"))


@query("fn_to_number", """SELECT p_partkey, TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) AS number,
    TRY_CAST(p_brand AS DOUBLE) AS bad FROM part""")
def fn_to_number(t):
    return t.table("part").select("p_partkey", n.to_number(F.replace("p_brand", F.lit("Brand#"), F.lit(""))).alias("number"),
                                  n.to_number(F.col("p_brand")).alias("bad"))


@query("fn_parse_datetime", """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.000000') AS parsed,
    CAST(NULL AS VARCHAR) AS bad FROM events""")
def fn_parse_datetime(t):
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t.events.select("event_id", tm.parse_datetime(text).alias("parsed"),
                           tm.parse_datetime(F.concat(F.lit("about "), text)).alias("bad")).select(
        "event_id", stamp("parsed"), stamp("bad"))


@query("fn_now", "SELECT id, date_diff('day', CAST(ts AS DATE), DATE '2024-02-01') AS age_days FROM stream", STREAM_SQL)
def fn_now(t):
    return t.stream.select("id", F.datediff(tm.now("2024-02-01 00:00:00"), "ts").cast("bigint").alias("age_days"))


@query("fn_date_part", """SELECT id, year(s) AS year, month(s) AS month, day(s) AS day, hour(s) AS hour, minute(s) AS minute,
    second(s) AS second, floor(epoch_us(s) % 1000000 / 1000)::BIGINT AS ms, dayofweek(s) AS weekday, dayofyear(s) AS yearday,
    CAST(NULL AS BIGINT) AS unknown FROM (SELECT id, ts + INTERVAL '90 minutes' AS s FROM stream)""", STREAM_SQL)
def fn_date_part(t):
    ts, offset = F.col("ts"), 90 * tm.UNITS_US["m"]
    names = {"year": "year", "month": "month", "day": "day", "hour": "hour", "minute": "minute", "second": "second",
             "ms": "millisecond", "weekday": "weekday", "yearday": "dayofyear", "unknown": "fortnight"}
    return t.stream.select("id", *[tm.date_part(ts, part, offset).alias(name) for name, part in names.items()])


@query("fn_offset_in", """SELECT o_orderkey, CASE WHEN o_orderdate IS NOT NULL THEN 34200000000 END AS darwin,
    19800000000 AS kolkata FROM orders""")
def fn_offset_in(t):
    ts = F.col("o_orderdate").cast("timestamp")
    return t.table("orders").select("o_orderkey", tm.offset_in("Australia/Darwin", ts).alias("darwin"),
                                    tm.offset_in("Asia/Kolkata", ts).alias("kolkata"))


@query("fn_iso_string", """SELECT id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '0Z' AS utc,
    strftime(ts + INTERVAL '10 hours', '%Y-%m-%dT%H:%M:%S.%f') || '0+10:00' AS east FROM stream""", STREAM_SQL)
def fn_iso_string(t):
    return t.stream.select("id", tm.to_iso_string(F.col("ts")).alias("utc"),
                           tm.to_iso_string(F.col("ts"), 10 * tm.UNITS_US["h"]).alias("east"))


@query("fn_time_of_day", "SELECT id, (epoch_us(ts) + 7200000000) % 86400000000 AS us FROM stream", STREAM_SQL)
def fn_time_of_day(t):
    return t.stream.select("id", tm.time_of_day(F.col("ts"), 2).alias("us"))


@query("fn_timespan", """SELECT id, epoch_us(ts) % 259200000000 AS parsed, floor(epoch_us(ts) % 259200000000 / 86400000000)::BIGINT AS days,
    round(epoch_us(ts) % 259200000000 / 1000.0, 3) AS ms, CAST(NULL AS BIGINT) AS bad FROM stream""", STREAM_SQL)
def fn_timespan(t):
    span = tm.ticks_us(F.col("ts")) % (3 * tm.UNITS_US["d"])
    shown = tm.to_time_string(span)
    parsed = tm.parse_timespan(shown)
    return t.stream.select("id", parsed.alias("parsed"), F.floor(parsed / tm.UNITS_US["d"]).cast("bigint").alias("days"),
                           F.round(tm.total_milliseconds(shown, text=True), 3).alias("ms"),
                           tm.parse_timespan(F.col("message")).alias("bad"))


@query("fn_time_string", """SELECT id, CASE WHEN us >= 86400000000 THEN (us // 86400000000) || '.' ELSE '' END
    || strftime(make_timestamp(us % 86400000000), '%H:%M:%S')
    || CASE WHEN us % 1000000 > 0 THEN '.' || lpad(CAST(us % 1000000 AS VARCHAR), 6, '0') || '0' ELSE '' END AS shown
    FROM (SELECT id, epoch_us(ts) % 259200000000 AS us FROM stream)""", STREAM_SQL)
def fn_time_string(t):
    return t.stream.select("id", tm.to_time_string(tm.ticks_us(F.col("ts")) % (3 * tm.UNITS_US["d"])).alias("shown"))


@query("fn_bucket", """SELECT id, round((pow(g, i - 1) + pow(g, i)) / 2, 6) AS bucket, round(-(pow(g, i - 1) + pow(g, i)) / 2, 6) AS mirrored
    FROM (SELECT id, CAST(1.01 AS DOUBLE) / 0.99 AS g, ceil(ln(value) / ln(CAST(1.01 AS DOUBLE) / 0.99)) AS i FROM stream)""", STREAM_SQL)
def fn_bucket(t):
    value = F.col("value")
    return t.stream.select("id", F.round(n.bucket(value, 0.01), 6).alias("bucket"),
                           F.round(n.bucket(-value, 0.01), 6).alias("mirrored"))


@query("fn_round", """SELECT c_custkey, floor(c_acctbal + 0.5) AS whole, floor((c_acctbal - 5000) * 10.0 + 0.5) / 10.0 AS tenths FROM customer""")
def fn_round(t):
    return t.table("customer").select("c_custkey", n.round_to(F.col("c_acctbal")).alias("whole"),
                                      n.round_to(F.col("c_acctbal") - 5000, 1).alias("tenths"))


@query("fn_arithmetic", """SELECT id, k + 1 AS added, k - 50 AS taken, k * user_id AS multiplied,
    CASE WHEN k <> 50 THEN value / (k - 50) END AS divided,
    CASE WHEN k <> 0 THEN user_id % k END AS remainder, round(pow(k, 2), 4) AS squared, -k AS negated FROM stream""", STREAM_SQL)
def fn_arithmetic(t):
    k, user, value = F.col("k"), F.col("user_id"), F.col("value")
    return t.stream.select(
        "id", n.add(k, 1).alias("added"), n.subtract(k, 50).alias("taken"), n.multiply(k, user).alias("multiplied"),
        n.divide(value, k - 50).alias("divided"), n.remainder(user, k).alias("remainder"),
        F.round(n.power(k, 2), 4).alias("squared"), n.negate(k).alias("negated"))


@query("fn_equality", """SELECT id, event_type = 'click' AS same, event_type <> 'click' AS other, false AS wrong_type, true AS wrong_type_other,
    CAST(NULL AS BOOLEAN) AS missing, level = 'INF' AS same_ci FROM stream""", STREAM_SQL)
def fn_equality(t):
    return t.stream.select(
        "id", v.prop_equals("event_type", "click").alias("same"), v.prop_differs("event_type", "click").alias("other"),
        v.prop_equals("event_type", 7).alias("wrong_type"), v.prop_differs("event_type", 7).alias("wrong_type_other"),
        v.prop_equals("nothing", 7).alias("missing"), logic.equals(F.col("level"), "inf", ci=True).alias("same_ci"))


@query("fn_ordering", "SELECT id, k < user_id AS lt, k <= user_id AS le, k > user_id AS gt, k >= user_id AS ge FROM stream", STREAM_SQL)
def fn_ordering(t):
    k, user = v.prop("Detail.k", "bigint"), v.prop("user_id", "bigint")
    return t.stream.select("id", (k < user).alias("lt"), (k <= user).alias("le"), (k > user).alias("gt"), (k >= user).alias("ge"))


@query("fn_logic", """SELECT id, coalesce(exception LIKE '%7', false) AND value > 10 AS both,
    coalesce(exception LIKE '%7', false) OR value > 90 AS either, NOT coalesce(exception LIKE '%7', false) AS negated FROM stream""", STREAM_SQL)
def fn_logic(t):
    odd, dear = F.col("exception").like("%7"), F.col("value") > 10
    return t.stream.select("id", logic.op_and(odd, dear).alias("both"), logic.op_or(odd, F.col("value") > 90).alias("either"),
                           logic.op_not(odd).alias("negated"))


@query("fn_membership", """SELECT id, event_type IN ('click', 'view') AS listed, level IN ('INF', 'Error') AS listed_ci,
    user_id = 7 OR k = 7 AS in_array FROM stream""", STREAM_SQL)
def fn_membership(t):
    items = v.prop("Items", "array<bigint>")
    return t.stream.select("id", logic.is_member(F.col("event_type"), ["click", "view"]).alias("listed"),
                           logic.is_member(F.col("level"), ["inf", "ERROR"], ci=True).alias("listed_ci"),
                           logic.is_member(F.lit(7).cast("bigint"), items).alias("in_array"))


@query("fn_coalesce", "SELECT id, coalesce(exception, message) AS text FROM stream", STREAM_SQL)
def fn_coalesce(t):
    return t.stream.select("id", v.coalesce_values(F.col("exception"), v.prop("nothing"), F.col("message")).alias("text"))


@query("fn_element_at", """SELECT id, user_id AS first, k AS second, CAST(NULL AS BIGINT) AS outside, event_type AS by_key,
    event_type AS by_key_ci FROM stream""", STREAM_SQL)
def fn_element_at(t):
    items = v.prop("Items", "array<bigint>")
    pairs = F.create_map(F.lit("Kind"), F.col("event_type"), F.lit("Level"), F.col("level"))
    return t.stream.select(
        "id", v.element_at(items, 0).alias("first"), v.element_at(items, 1).alias("second"), v.element_at(items, 2).alias("outside"),
        v.element_at(pairs, "Kind").alias("by_key"), v.element_at(pairs, "KIND", ci=True).alias("by_key_ci"))


@query("fn_keys_values", """SELECT id, 'Detail,Items,event_type,user_id,value' AS keys, 2 AS n_values FROM stream""", STREAM_SQL)
def fn_keys_values(t):
    properties = F.col("properties")
    return t.stream.select("id", F.array_join(F.array_sort(v.keys_of(properties, variant=True)), ",").alias("keys"),
                           F.size(v.values_of(v.member(properties, "Detail"), variant=True)).alias("n_values"))


@query("fn_some_every", "SELECT id, k > 90 OR user_id > 90 AS some_high, k < 50 AND user_id < 50 AS every_low FROM stream", STREAM_SQL)
def fn_some_every(t):
    pairs = F.create_map(F.lit("k"), F.col("k"), F.lit("user"), F.col("user_id"))
    return t.stream.select("id", v.some(pairs, lambda x: x > 90, is_map=True).alias("some_high"),
                           v.every(v.prop("Items", "array<bigint>"), lambda x: x < 50).alias("every_low"))


@query("fn_json", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, true AS bad_is_undefined,
    '{"id":' || event_id || ',"kind":"' || event_type || '"}' AS json FROM events""")
def fn_json(t):
    parsed = v.from_json_text(F.col("props"))
    return t.events.select(
        "event_id", v.prop("k", "bigint", parsed).alias("k"),
        v.from_json_text(F.concat(F.lit("{"), F.col("props"))).isNull().alias("bad_is_undefined"),
        v.to_json_text(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("json"))


@query("fn_type_of", """SELECT id, 'number' AS user_type, 'string' AS kind_type, 'array' AS items_type, 'object' AS detail_type,
    'undefined' AS missing_type, CASE WHEN k % 2 = 0 THEN 'null' ELSE 'boolean' END AS mixed_type FROM stream""", STREAM_SQL)
def fn_type_of(t):
    properties = F.col("properties")
    mixed = F.try_parse_json(F.when(F.col("k") % 2 == 0, "null").otherwise("true"))
    named = {"user_type": "user_id", "kind_type": "event_type", "items_type": "Items", "detail_type": "Detail",
             "missing_type": "nothing"}
    return t.stream.select("id", *[v.type_of(v.member(properties, path)).alias(name) for name, path in named.items()],
                           v.type_of(mixed).alias("mixed_type"))


@query("fn_has", "SELECT id, true AS present, false AS absent, exception IS NOT NULL AS failed FROM stream", STREAM_SQL)
def fn_has(t):
    return t.stream.select("id", v.has(v.prop("user_id", "bigint")).alias("present"), v.has_prop("user_id.x").alias("absent"),
                           v.has(F.col("exception")).alias("failed"))


@query("fn_template_id", "SELECT message_template, count(*) AS n, CAST(1 AS BIGINT) AS ids FROM stream GROUP BY 1", STREAM_SQL)
def fn_template_id(t):
    return q.group_by(t.stream, "message_template", {
        "n": F.count(F.lit(1)), "ids": F.count_distinct(v.template_id(F.col("message_template")))})


@query("fn_levels", """SELECT level, CASE level WHEN 'warn' THEN 'Warning' WHEN 'INF' THEN 'Information' WHEN 'dbg' THEN 'Debug' ELSE level END AS full_name,
    severity, count(*) AS n FROM stream GROUP BY ALL""", STREAM_SQL)
def fn_levels(t):
    level = F.col("level")
    return q.group_by(t.stream, {"level": level, "full_name": levels.normalise_level(level), "severity": levels.severity_of(level)},
                      {"n": F.count(F.lit(1))})


@query("fn_accessor", """SELECT p_partkey, CASE WHEN contains(p_name, ' ') THEN '@Properties[''' || p_name || ''']' ELSE p_name END AS name FROM part""")
def fn_accessor(t):
    return t.table("part").select("p_partkey", v.accessor(F.lit("@Properties"), F.col("p_name"), prefix_optional=True).alias("name"))


@query("fn_scalar_row", "SELECT count(*) AS n, count(*) * 2 AS twice FROM events")
def fn_scalar_row(t):
    total = t.events.agg(F.count(F.lit(1)).alias("n"))
    return q.select_columns(total, "n", twice=F.col("n") * 2)
