import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tracelode.functions.values import prop
from tracelode.operators import ingest, sinks
from tracelode.operators.extraction import compile_pattern, extract_fields
from tracelode.operators.framing import frame_lines
from tracelode.session import configure
from tracelode.sources import clef
from tracelode.sources.lines import read_lines

BOM = "﻿"


def write(path, *lines, bom=True):
    path.write_text((BOM if bom else "") + "\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def loop(i, **more):
    return json.dumps({"@t": f"2017-04-20T04:24:47.{i:07d}Z", "@mt": "Loop {Counter}", "Counter": i, **more})


def test_events(spark, tmp_path):
    levels = {3: "Error", 4: "Error", 5: "WARN", 6: "Trace", 7: "Debug", 8: "Information"}
    path = write(tmp_path / "events.clef", *[loop(i, **({"@l": levels[i]} if i in levels else {})) for i in range(15)])
    events = clef.read_clef(spark, path)
    assert events.count() == 15
    assert {r["level"]: r["count"] for r in events.groupBy("level").count().collect()} == {
        "Information": 10, "Error": 2, "WARN": 1, "Trace": 1, "Debug": 1}
    row = events.where(prop("Counter", "bigint") == 5).first()
    assert row.message == "Loop 5" and row.severity == 3 and row.message_template == "Loop {Counter}"
    assert events.select("event_type_id").distinct().count() == 1
    assert [r.message for r in events.orderBy("arrived").collect()] == [f"Loop {i}" for i in range(15)]


def test_missing_time_is_arrival(spark, tmp_path):
    path = write(tmp_path / "events.ndjson", *[json.dumps({"Counter": i}) for i in range(15)])
    events = clef.read_clef(spark, path, reference_time="2024-05-06 07:08:09")
    assert events.where(F.col("ts") == "2024-05-06 07:08:09").count() == 15


def test_spans(spark, tmp_path):
    base = {"@t": "2022-02-03T04:10:06Z", "@st": "2022-02-03T04:05:06Z", "@tr": "00112233445566778899aabbccddeeff",
            "@sp": "0011223344556677", "@ps": "8899aabbccddeeff", "@ra": {"a": 1}, "@sa": {"b": 1}}
    path = write(tmp_path / "spans.clef", *[json.dumps({**base, "@m": m, **x}) for m, x in (
        ("one", {}), ("two", {"@l": "Warning"}), ("three", {"@l": "ERR"}))])
    spans = clef.read_clef(spark, path)
    assert spans.select("trace_id", "span_id").distinct().count() == 1
    assert {r.elapsed_us for r in spans.collect()} == {300_000_000}
    assert spans.select(prop("a", "int", "resource").alias("a"), prop("b", "int", "scope").alias("b")).distinct().collect() == [(1, 1)]


def test_escaped_names_and_given_types(spark, tmp_path):
    path = write(tmp_path / "x.clef", json.dumps({"@t": "2024-01-01T00:00:00Z", "@i": "00c0ffee", "@@odd": 1, "@m": "x"}))
    row = clef.read_clef(spark, path).select("event_type_id", prop("@odd", "int").alias("odd")).first()
    assert row == (0x00C0FFEE, 1)


def test_invalid_lines(spark, tmp_path):
    path = write(tmp_path / "bad.clef", loop(1), "[1]", "oops", loop(2))
    assert clef.read_clef(spark, path, invalid="ignore").count() == 2
    with pytest.raises(Exception, match="not a JSON object"):
        clef.read_clef(spark, path).collect()
    with pytest.raises(ValueError):
        clef.read_clef(spark, path, invalid="maybe")


def test_validation(spark):
    now = dt.datetime.now(dt.timezone.utc).isoformat()
    limit = 4_000
    good = [{"@t": now}, {"@t": now, "": "no name"}, {"@t": now, "@mt": "{order.id} of {order.owner}", "order": {"id": 7}},
            {"@t": now, "@mt": "took {ms}", "@i": "00c0ffee", "ms": 3.5}, {"@t": now, "big": 2 ** 53 + 1}, {"@t": now, "pad": "p" * (limit - 500)},
            {"@t": now, "@tr": "0f", "@sp": "1e", "@ra": {"host": "n1"}, "@sa": {"lib": "http"}}, {"@t": now, "@m": "braces {are: 'kept'}"}]
    bad = [("{}", clef.NO_TIMESTAMP), ("{unquoted: 1", clef.BAD_JSON), ('{"@t":"some day"}', clef.BAD_TIMESTAMP), ("plain words", clef.BAD_JSON),
           ('"text"', clef.NOT_OBJECT), (json.dumps({"@t": now, "pad": "p" * (limit + 500)}), clef.TOO_LARGE)]
    rows = [(json.dumps(g), None) for g in good] + bad
    df = spark.createDataFrame(rows, "line string, want string")
    assert clef.validate_clef(df, limit=limit).where(~F.col("reason").eqNullSafe(F.col("want"))).count() == 0
    valid, rejected = clef.split_valid(df, limit=limit)
    assert (valid.count(), rejected.count()) == (8, 6)


def test_repeated_keys_are_valid_and_the_last_counts(spark):
    configure(spark)
    df = spark.createDataFrame([('{"@t":"2024-05-06T07:08:09Z","n":1,"n":2}',)], "line string")
    assert clef.validate_clef(df).first().reason is None
    row = clef.parse_clef(df).select("ts", prop("n", "int").alias("n")).first()
    assert row == (dt.datetime(2024, 5, 6, 7, 8, 9), 2)


def test_rejection_log(spark):
    rows = [("s", 1, "x" * 3000), ("s", 2, "y" * 3000), ("t", 3, "{}")]
    _, rejected = clef.split_valid(spark.createDataFrame(rows, "source string, at int, line string"))
    assert max(len(r.document_start) for r in clef.rejection_log(rejected, at="at").collect()) == 3000
    log = clef.rejection_log(rejected, at="at", chars=1024).collect()
    assert [(r.reason, r.source, r.n, len(r.document_start)) for r in log] == [
        (clef.NO_TIMESTAMP, "t", 1, 2), (clef.BAD_JSON, "s", 2, 1024)]


def read_text(spark, pattern, *paths):
    frames = frame_lines(read_lines(spark, list(paths)), compile_pattern(pattern).start, block="block")
    return ingest.build_events(extract_fields(frames.where(~F.col("is_orphan")).select("text"), pattern, keep=()))


def test_text_with_stack_traces(spark, tmp_path):
    path = write(tmp_path / "events.txt", "2021-11-30 05:06:07.008 +02:00 [INF] job 17 began",
                 "2021-11-30 05:06:09.250 +02:00 [ERR] job 17 failed", "DivisionByZero: share of nothing",
                 "   in split_evenly, line 12", "2021-11-30 05:06:10.500 +02:00 [INF] job 18 began")
    events = read_text(spark, "{@t:timestamp} [{@l:level}] {@m:*}{:n}{@x:*}", path)
    assert {r["level"]: r["count"] for r in events.groupBy("level").count().collect()} == {"Information": 2, "Error": 1}
    failed = events.where(F.col("exception").contains("split_evenly")).collect()
    assert len(failed) == 1 and failed[0].message == "job 17 failed"
    assert failed[0].ts == dt.datetime(2021, 11, 30, 3, 6, 9, 250000)


def test_levelled_text_keeps_its_spelling(spark, tmp_path):
    path = write(tmp_path / "levelled.txt", "INFO This is a test", "WARN This is only a test")
    assert sorted(r.level for r in read_text(spark, "{@l:token} {@m:line}", path).collect()) == ["INFO", "WARN"]


def test_wildcards_blank_lines_and_level_override(spark, tmp_path):
    write(tmp_path / "log-1.txt", "one", "two", "", "three", bom=False)
    write(tmp_path / "log-2.txt", "four", bom=False)
    events = read_text(spark, "{@m:line}", str(tmp_path / "log-*.txt"))
    assert sorted(r.message for r in events.collect()) == ["four", "one", "three", "two"]
    assert ingest.override_level(events, "OK").where("level = 'OK'").count() == 4


def test_event_defaults(spark):
    row = ingest.build_events(spark.createDataFrame([(None,)], "unmatched string"), reference_time="2024-01-01").first()
    assert (row.level, row.severity, row.message, row.exception) == ("Information", 2, "", None)
    assert row.ts == dt.datetime(2024, 1, 1)


def test_supplied_values(spark):
    df = spark.createDataFrame([("2018-02-01T13:00:00.123Z", "WRN", "Hello, world", "Failed", "TP", 42, "rem")],
                               "`@t` string, `@l` string, `@m` string, `@x` string, MachineName string, Count int, unmatched string")
    row = ingest.build_events(df).select("ts", "level", "severity", "message", "exception", prop("MachineName").alias("m"),
                                         prop("Count", "int").alias("c"), prop("@unmatched").alias("u")).first()
    assert row == (dt.datetime(2018, 2, 1, 13, 0, 0, 123000), "WRN", 3, "Hello, world", "Failed", "TP", 42, "rem")


def test_property_text():
    assert [ingest.parse_scalar(x) for x in ("", " ", None, "true", "false", "12", "-1.5", "x y")] == [
        None, None, None, True, False, 12, -1.5, "x y"]


def test_trace_identifiers(spark):
    good_trace, good_span = "0123456789abcdef0123456789abcdef", "fedcba9876543210"
    rows = [(good_trace, good_span, good_span), ("abc", "def", "0123"), ("0" * 32, "0" * 16, "0" * 16),
            (good_trace.upper(), good_span.upper(), "z" * 16), (None, None, None)]
    got = ingest.sanitise_trace_ids(spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string")).collect()
    assert [tuple(r) for r in got] == [(good_trace, good_span, good_span)] + [(None, None, None)] * 4


def test_unflatten(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5, 6)], "`a.b` int, `a.c.d` int, e int, `e.f` int, `.g` int, `h.1` int")
    out = ingest.unflatten(df)
    assert out.columns == ["e", ".g", "h.1", "a", "e.f"]
    assert out.first().asDict(recursive=True) == {"e": 3, ".g": 5, "h.1": 6, "a": {"b": 1, "c": {"d": 2}}, "e.f": 4}
    deep = ingest.unflatten(spark.createDataFrame([(1,)], "`a.b.c.d.e.f.g.h.i.j.k.l.m` int")).first().asDict(recursive=True)
    level = 0
    while isinstance(deep, dict):
        last = list(deep)
        deep, level = deep[last[0]], level + 1
    assert level == 13 and last == ["m"]
    flat = ingest.unflatten(spark.createDataFrame([(1,)], "`a.b.c` int"), 1).first().asDict(recursive=True)
    assert flat == {"a": {"b.c": 1}}


def test_policies(spark):
    rows = [("k1", "info", 1), ("k1", "err", 2), ("k2", "info", 3), ("other", "dbg", 4)]
    df = spark.createDataFrame(rows, "source_key string, level string, n int").withColumns({
        "ts": F.lit("2024-01-01").cast("timestamp"), "properties": F.to_variant_object(F.struct("n"))})
    policies = [ingest.IngestPolicy("k1", minimum_level="Warning", properties={"Env": "prod"}),
                ingest.IngestPolicy("k2", filter=F.col("n") > 5)]
    got = ingest.apply_ingest_policies(df, policies).select("n", prop("Env").alias("env")).orderBy("n").collect()
    assert [tuple(r) for r in got] == [(2, "prod"), (4, None)]


def test_templates(spark):
    df = spark.createDataFrame([("{{x}} {Name} {Count:000} {@Obj} {Missing} }", '{"Name":"n","Count":7,"Obj":{"a":1}}')], "t string, p string")
    df = df.select(F.col("t").alias("message_template"), F.parse_json("p").alias("properties"))
    assert ingest.render_messages(df).first().message == '{x} n 7 {"a":1} {Missing} }'


def test_table_and_exports(spark, tmp_path):
    path = write(tmp_path / "in.clef", loop(0), loop(1, **{"@l": "Error", "@x": "boom", "@@odd": 2, "Text": 'say "hi"'}))
    events = clef.read_clef(spark, path)
    sinks.write_events(events, str(tmp_path / "table"))
    sinks.write_events(events, str(tmp_path / "table"))
    table = sinks.read_events(spark, str(tmp_path / "table"))
    assert table.count() == 4 and {str(r.event_date) for r in table.collect()} == {"2017-04-20"}

    sinks.write_clef(events, str(tmp_path / "clef"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "clef")).collect()]
    assert sorted(lines, key=lambda x: x["Counter"]) == [
        {"@t": "2017-04-20T04:24:47.0000000Z", "@mt": "Loop {Counter}", "Counter": 0},
        {"@t": "2017-04-20T04:24:47.0000000Z", "@mt": "Loop {Counter}", "@l": "Error", "@x": "boom", "@@odd": 2, "Counter": 1,
         "Text": 'say "hi"'}]
    again = clef.read_clef(spark, str(tmp_path / "clef"))
    assert sorted(r.message for r in again.collect()) == ["Loop 0", "Loop 1"]

    rows = events.orderBy("arrived").select(F.lit('a "b"').alias("q"), F.lit(True).alias("yes"), "exception", prop("Counter", "int").alias("n"))
    sinks.write_csv(rows.coalesce(1), str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("*.csv")))
    assert text == '"q","yes","exception","n"\n"a ""b""","true","null","0"\n"a ""b""","true","boom","1"\n'

    sinks.write_ndjson(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_metric_export(spark, tmp_path):
    sample = json.dumps({"@t": "2024-01-01T00:00:00Z", "a": 1, "@d": {"a": {"kind": "Sum", "description": "xyz"}}})
    path = write(tmp_path / "m.clef", sample, loop(1))
    series = clef.read_series(spark, path)
    line = json.loads(series.select(sinks.clef_line(series).alias("x")).first().x)
    assert line == {"@t": "2024-01-01T00:00:00.0000000Z", "a": 1, "@d": {"a": {"kind": "Sum", "description": "xyz"}}}


def test_events_have_the_columns_of_the_stream(spark, tmp_path):
    from pyspark.sql.types import StructType

    from tracelode.model import STREAM_SCHEMA

    names = StructType.fromDDL(STREAM_SCHEMA).names
    text = spark.createDataFrame([("x", 1)], "`@m` string, n int")
    assert ingest.build_events(text).columns == names
    for name in ("a.clef", "b.clef"):
        write(tmp_path / name, loop(0), loop(1))
    events = clef.read_clef(spark, str(tmp_path / "*.clef"))
    assert set(names) <= set(events.columns) and events.select("id").distinct().count() == 4
