import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tracelode.functions import aggregates as a
from tracelode.functions.values import prop
from tracelode.operators.alerts import Alert, raise_alert
from tracelode.operators.signals import Signal
from tracelode.streaming import alerting, framing, ingestion, live

SCHEMA = "id string, ts timestamp, level string, value double"


def add(spark, path, rows):
    spark.createDataFrame([(str(i), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute), level, float(i)) for i, minute, level in rows],
                          SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_tail_and_resume(spark, tmp_path):
    add(spark, tmp_path / "in", [(1, 0, "Error"), (2, 1, "info")])
    errors = live.tail(stream(spark, tmp_path / "in"), F.col("level") == "Error")
    out = live.drain(errors, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert out.count() == 1
    add(spark, tmp_path / "in", [(3, 2, "Error")])
    assert live.drain(errors, str(tmp_path / "out"), str(tmp_path / "cp")).count() == 2


def test_dedupe(spark, tmp_path):
    for rows in ([(1, 0, "a"), (2, 1, "a")], [(2, 1, "a"), (3, 2, "a")]):
        add(spark, tmp_path / "in", rows)
    out = live.drain(live.dedupe_stream(stream(spark, tmp_path / "in"), "1 hour"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.id for r in out.collect()) == ["1", "2", "3"]


def test_slices_appear_once_closed(spark, tmp_path):
    for rows in ([(1, 0, "a"), (2, 65, "a")], [(3, 70, "b"), (4, 200, "a")]):
        add(spark, tmp_path / "in", rows)
    slices = live.stream_time_slices(stream(spark, tmp_path / "in"), "1h", {"n": a.count_all()}, "level", "10 minutes").drop("_window")
    out = live.drain(slices, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted((r.level, r.time.hour, r.n) for r in out.collect()) == [("a", 0, 1), ("a", 1, 1), ("b", 1, 1)]


def test_ingestion_restarts_and_quarantine(spark, tmp_path):
    incoming = tmp_path / "in"
    incoming.mkdir()

    def put(name, *lines):
        (incoming / name).write_text("\n".join(lines) + "\n")

    def run():
        ingestion.ingest_stream(spark, str(incoming), str(tmp_path / "out"), str(tmp_path / "cp"), str(tmp_path / "bad"),
                                enrich=lambda df: df.where("level <> 'Debug'"), files_per_trigger=1, available_now=True).awaitTermination()

    good = json.dumps({"@t": "2024-01-01T00:00:00Z", "@mt": "Hi {N}", "N": 1, "@tr": "abc"})
    put("a.clef", good, "oops", json.dumps({"@t": "2024-01-01T00:00:00Z", "@l": "Debug"}))
    run()
    put("b.clef", good.replace("1}", "2}"), "{}")
    run()
    run()
    events = spark.read.parquet(str(tmp_path / "out"))
    rows = events.select("message", "trace_id", "id", prop("N", "int").alias("n")).collect()
    assert len(rows) == 2 and {r.message for r in rows} == {"Hi 1"} and len({r.id for r in rows}) == 2 and {r.trace_id for r in rows} == {None}
    assert sorted(r.reason for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == ["no time", "not JSON"]


LINES = "source string, line_no bigint, line string"


def test_frames_over_batches(spark, tmp_path):
    batches = [[("s", 0, " lost"), ("s", 1, "+a"), ("s", 2, " b")], [("s", 3, " c"), ("t", 0, "+x")], [("s", 4, "+d"), ("t", 1, " y")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, LINES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        lines = spark.readStream.schema(LINES).parquet(str(tmp_path / "in"))
        framing.frame_stream(lines, r"\A\+", str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "cp"), deadline="1h",
                             available_now=True).awaitTermination()
    framing.release_frames(spark, str(tmp_path / "state"), str(tmp_path / "out"), len(batches) - 1)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.source, r.frame_start, r.text, r.is_orphan) for r in rows) == [
        ("s", 0, " lost\n", True), ("s", 1, "+a\n b\n c\n", False), ("s", 4, "+d\n", False), ("t", 0, "+x\n y\n", False)]


def test_frames_after_the_deadline(spark, tmp_path):
    for rows in ([("s", 1, "+a")], [("s", 2, " late"), ("s", 3, "+b")]):
        spark.createDataFrame(rows, LINES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        lines = spark.readStream.schema(LINES).parquet(str(tmp_path / "in"))
        framing.frame_stream(lines, r"\A\+", str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "cp"), deadline="1us",
                             available_now=True).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.frame_start, r.text, r.is_orphan) for r in rows) == [(1, "+a\n", False), (2, " late\n", True)]


def test_alert_over_batches_equals_batch(spark, tmp_path):
    minutes = [0, 3, 9, 10, 12, 25, 26, 60]
    alert = Alert("x", "1m", F.col("n") > 0, {"n": a.count_all()}, signal=Signal("e", F.col("level") == "Error"), suppression="10m", channels=("c",))
    for i, minute in enumerate(minutes):
        add(spark, tmp_path / "in", [(i, minute, "Error"), (100 + i, minute, "info")])
        if i % 3 == 2 or minute == minutes[-1]:
            alerting.stream_alert(stream(spark, tmp_path / "in"), alert, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "cp"),
                                  available_now=True).awaitTermination()
    got = sorted(r.time.minute for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = sorted(r.time.minute for r in raise_alert(spark.read.parquet(str(tmp_path / "in")), alert).collect())
    assert batch == [0, 0, 10, 25] and got == [0, 10, 25]
    with pytest.raises(ValueError):
        alerting.stream_firings(stream(spark, tmp_path / "in"), Alert("p", "1m", F.col("p") > 1, percentiles={"p": (F.col("value"), 95)}))


def test_subscriber_survives_failures(spark, tmp_path):
    add(spark, tmp_path / "in", [(1, 0, "Error"), (2, 1, "Error"), (3, 2, "info"), (4, 3, "Error")])
    seen = str(tmp_path / "seen")
    open(seen, "w").close()

    def handle(row):
        if row.id == "1":
            raise RuntimeError("no")
        with open(seen, "a") as out:
            out.write(row.id + "\n")

    live.subscribe(stream(spark, tmp_path / "in"), handle, str(tmp_path / "cp"), F.col("level") == "Error", available_now=True).awaitTermination()
    assert sorted(open(seen).read().split()) == ["2", "4"]


def test_a_silent_source_is_released_while_another_is_busy(spark, tmp_path):
    import time

    def put(*rows):
        spark.createDataFrame(rows, LINES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        lines = spark.readStream.schema(LINES).parquet(str(tmp_path / "in"))
        framing.frame_stream(lines, r"\A\+", str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "cp"), deadline="4s",
                             available_now=True).awaitTermination()

    put(("quiet", 1, "+a"), ("busy", 1, "+x"))
    began = time.time()
    n = 2
    while time.time() < began + 4.5:
        put(("busy", n, "+y"))
        n += 1
    put(("busy", n, "+z"))
    rows = spark.read.parquet(str(tmp_path / "out")).where("source = 'quiet'").collect()
    assert [(r.frame_start, r.text) for r in rows] == [(1, "+a\n")]
    assert len(list((tmp_path / "state").glob("batch=*"))) == 2


def test_last_windows_of_an_ended_alert(spark, tmp_path):
    alert = Alert("x", "1m", F.col("n") > 0, {"n": a.count_all()}, signal=Signal("e", F.col("level") == "Error"), suppression="10m", channels=("c",))
    for minutes in ([0, 3, 12], [21, 22, 40], [58, 60, 60, 68]):  # the last window is open when the input ends
        add(spark, tmp_path / "in", [(n, m, level) for m in minutes for n, level in ((m, "Error"), (100 + m, "info"))])
    table = spark.read.schema(SCHEMA).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds no new input
        out = alerting.drain_alert(stream(spark, tmp_path / "in"), table, alert, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "cp"))
        got = sorted((r.time, r.n, r.channel) for r in out.collect())
        assert got == sorted((r.time, r.n, r.channel) for r in raise_alert(table, alert).collect())
        assert [t.hour * 60 + t.minute for t, _, _ in got] == [0, 12, 22, 40, 58, 68]


def test_last_slices_of_an_ended_stream(spark, tmp_path):
    for rows in ([(1, 0, "a"), (2, 65, "a")], [(3, 70, "b"), (4, 200, "a")]):
        add(spark, tmp_path / "in", rows)
    table = spark.read.schema(SCHEMA).parquet(str(tmp_path / "in"))
    out = live.drain_time_slices(stream(spark, tmp_path / "in"), table, str(tmp_path / "out"), str(tmp_path / "cp"), "1h", {"n": a.count_all()}, "level")
    assert sorted((r.level, r.time.hour, r.n) for r in out.collect()) == [("a", 0, 1), ("a", 1, 1), ("a", 3, 1), ("b", 1, 1)]


def test_deletion_from_a_streamed_table(spark, tmp_path):
    from tracelode.operators import lifecycle

    incoming = tmp_path / "in"
    incoming.mkdir()
    for batch in range(3):
        (incoming / f"{batch}.clef").write_text("".join(json.dumps({"@t": f"2024-01-0{1 + n % 2}T00:00:00Z", "N": 10 * batch + n}) + "\n" for n in range(4)))
    ingestion.ingest_stream(spark, str(incoming), str(tmp_path / "out"), str(tmp_path / "cp"), files_per_trigger=1, available_now=True).awaitTermination()

    def left():
        return sorted(r.n for r in spark.read.parquet(str(tmp_path / "out")).select(prop("N", "int").alias("n")).collect())

    assert len(left()) == 12
    assert lifecycle.delete_from_table(spark, str(tmp_path / "out"), prop("N", "int") < 10, end="2024-01-02") == 2
    assert left() == [1, 3, 10, 11, 12, 13, 20, 21, 22, 23]
    assert lifecycle.compact_table(spark, str(tmp_path / "out")) == 2 and lifecycle.compact_table(spark, str(tmp_path / "out")) == 0
    assert left() == [1, 3, 10, 11, 12, 13, 20, 21, 22, 23]
    assert lifecycle.delete_from_table(spark, str(tmp_path / "out"), start="2024-01-02") == 6 and left() == [10, 12, 20, 22]


def test_deletion_of_events_without_a_time(spark, tmp_path):
    from tracelode.operators import lifecycle, sinks

    rows = [(str(i), None if i % 2 else dt.datetime(2024, 1, 1), "Error" if i < 4 else "info", 1.0) for i in range(8)]
    path = str(tmp_path / "events")
    sinks.write_events(spark.createDataFrame(rows, SCHEMA), path)
    assert lifecycle.delete_from_table(spark, path, F.col("level") == "Error") == 4
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["4", "5", "6", "7"]
    assert lifecycle.delete_from_table(spark, path, F.col("ts").isNull()) == 2
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["4", "6"]
    assert lifecycle.retain_in_table(spark, path, [lifecycle.RetentionPolicy("1d")], "2024-01-09") == 2


def test_a_record_that_never_ends_leaves_in_parts(spark, tmp_path):
    """Two sources over six batches; one of them opens a single record. What is carried over stays a part long."""
    batches, text, n = [], {"long": "", "short": []}, 0
    for b in range(6):
        rows = []
        for i in range(40):
            line = "+begin" if n == 0 else f" é line {n} of it"
            rows.append(("long", n, line))
            text["long"] += line + "\n"
            opens = n % 7 == 3
            rows.append(("short", n, f"+{n}" if opens else f" {n}"))
            if opens or not text["short"]:
                text["short"].append([n, ""])
            text["short"][-1][1] += rows[-1][2] + "\n"
            n += 1
        batches.append(rows)
    for b, rows in enumerate(batches):
        spark.createDataFrame(rows, LINES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        lines = spark.readStream.schema(LINES).parquet(str(tmp_path / "in"))
        framing.frame_parts_stream(lines, r"\A\+", 50, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "cp"), deadline="1h",
                                   available_now=True).awaitTermination()
        held = spark.read.parquet(str(tmp_path / "state" / f"batch={b}")).collect()
        assert len(held) == 2 and all(len(r.line) < 50 for r in held)
    framing.release_parts(spark, str(tmp_path / "state"), str(tmp_path / "out"), 5)
    got = sorted((r.source, r.frame_start, r.part, r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect() if not r.is_orphan)
    records = [("long", 0, text["long"]), *(("short", a, t) for a, t in text["short"] if t[0] == "+")]
    assert got == sorted((s, a, k, t[i:i + 50]) for s, a, t in records for k, i in enumerate(range(0, len(t), 50)))
