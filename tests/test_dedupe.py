"""De-duplication over closed and open dates, against a set of (date, id)."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tracelode.model import DATE_COLUMN
from tracelode.streaming import dedupe

SCHEMA = "id string, ts timestamp, value int"
DAY = dt.datetime(2024, 1, 1)


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, tmp_path, **options):
    events = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    dedupe.dedupe_to_table(events, str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "cp"), available_now=True, **options).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def state(spark, tmp_path, name):
    return spark.read.parquet(str(tmp_path / "state" / name))


def test_late_events_and_repeats_over_many_dates(spark, tmp_path):
    draw, sent, expected = random.Random(5), [], set()
    for b in range(6):
        rows = [(f"e{b}-{i}", DAY + dt.timedelta(days=2 * b, hours=i % 30), i) for i in range(60)]
        rows += draw.sample(sent, min(len(sent), 40))  # delivered again, some of them days later
        rows += [(f"late{b}-{i}", DAY + dt.timedelta(days=draw.randrange(max(1, 2 * b))), i) for i in range(5)]
        rows += rows[:7]
        sent += rows
        expected |= {(r[0], r[1].date()) for r in rows}
        put(spark, tmp_path / "in", rows)
        table = run(spark, tmp_path)
        got = [(r["id"], r["ts"].date()) for r in table.collect()]
        assert len(got) == len(set(got)) and set(got) == expected
    newest = max(d for _, d in expected)
    closed = {r[0] for r in state(spark, tmp_path, "filters").select(DATE_COLUMN).distinct().collect()}
    # Two dates are open at most; every other date with events has a filter, and one size.
    assert closed == {d for _, d in expected if d < newest - dt.timedelta(days=1)}
    assert state(spark, tmp_path, "sizes").count() == len(closed)
    assert state(spark, tmp_path, "open").agg(F.max("since")).first()[0] == newest - dt.timedelta(days=1)


def test_a_batch_that_is_repeated_ends_as_if_run_once(spark, tmp_path):
    put(spark, tmp_path / "in", [("a", DAY, 1), ("b", DAY, 2)])
    run(spark, tmp_path)
    put(spark, tmp_path / "in", [("c", DAY + dt.timedelta(days=5), 3), ("a", DAY, 1), ("d", DAY, 4)])
    run(spark, tmp_path)
    put(spark, tmp_path / "in", [("d", DAY, 4), ("e", DAY, 5), ("c", DAY + dt.timedelta(days=5), 3)])
    first = sorted(r["id"] for r in run(spark, tmp_path).collect())
    (tmp_path / "cp" / "commits" / "2").unlink()  # the driver is lost before it notes the end of batch 2
    (tmp_path / "cp" / "commits" / ".2.crc").unlink(missing_ok=True)
    again = run(spark, tmp_path)
    assert first == sorted(r["id"] for r in again.collect()) == ["a", "b", "c", "d", "e"]
    put(spark, tmp_path / "in", [("e", DAY, 5)])
    assert run(spark, tmp_path).count() == 5


def test_nulls_and_empty_batches(spark, tmp_path):
    put(spark, tmp_path / "in", [(None, DAY, 1), (None, DAY, 1), ("a", None, 2), ("a", DAY, 3), ("a", None, 2)])
    assert run(spark, tmp_path).count() == 4
    put(spark, tmp_path / "in", [])
    assert run(spark, tmp_path).count() == 4
    put(spark, tmp_path / "in", [("a", None, 2), ("a", DAY, 3), (None, None, 4), ("b", DAY + dt.timedelta(days=9), 5)])
    assert run(spark, tmp_path, open_dates=1).count() == 6
    put(spark, tmp_path / "in", [("a", None, 2), ("a", DAY, 3), ("b", DAY + dt.timedelta(days=9), 5)])
    assert run(spark, tmp_path).count() == 6


def test_only_dates_with_possible_repeats_are_read(spark, tmp_path, monkeypatch):
    put(spark, tmp_path / "in", [(f"{d}-{i}", DAY + dt.timedelta(days=d), i) for d in range(6) for i in range(20)])
    run(spark, tmp_path)
    asked, ids = [], dedupe._Store.ids
    monkeypatch.setattr(dedupe._Store, "ids", lambda self, dates, before, kind: asked.append(set(dates)) or ids(self, dates, before, kind))
    put(spark, tmp_path / "in", [("1-3", DAY + dt.timedelta(days=1), 3), ("5-3", DAY + dt.timedelta(days=5), 3)])
    assert run(spark, tmp_path).count() == 120
    day = DAY.date()
    assert asked[:2] == [{day + dt.timedelta(days=5)}, {day + dt.timedelta(days=1)}]


def test_filters_merge_and_never_deny_a_member(spark):
    ids = spark.range(5000).select(F.lit(DAY.date()).alias(DATE_COLUMN), F.col("id").cast("string").alias("id"))
    sizes = dedupe.sizes_of(ids)
    halves = [dedupe.build_filters(ids.where(F.col("id").cast("int") % 2 == k), sizes) for k in (0, 1)]
    both = halves[0].unionByName(halves[1])
    assert dedupe.possible_repeats(ids, sizes, both).where("not _seen").count() == 0
    others = spark.range(5000, 10000).select(F.lit(DAY.date()).alias(DATE_COLUMN), F.col("id").cast("string").alias("id"))
    assert dedupe.possible_repeats(others, sizes, both).where("_seen").count() < 500


def test_a_batch_of_one_file_is_compared_by_many_tasks(spark, tmp_path, monkeypatch):
    seen, append = [], dedupe._append
    monkeypatch.setattr(dedupe, "_append", lambda store, rows, n: seen.append(rows._jdf.queryExecution().executedPlan().toString()) or append(store, rows, n))
    put(spark, tmp_path / "in", [(f"{i}", DAY, i) for i in range(50)] * 2 + [(None, DAY, 1)])
    assert run(spark, tmp_path).count() == 51
    plan = seen[0]  # rows are exchanged before they are first compared, read upwards
    assert plan.rindex("REPARTITION_BY_COL") > plan.rindex("Aggregate")
