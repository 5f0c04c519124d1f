import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tracelode.operators import lifecycle, rollups as r, sinks
from tracelode.operators.query import group_by, time_slices
from tracelode.operators.signals import Signal

START = dt.datetime(2024, 3, 1)


@pytest.fixture(autouse=True)
def definitions(spark):
    """Columns need a session, so these are made with the first test."""
    global LOUD, ODD, KEPT
    v = F.col("value")
    LOUD, ODD = Signal("Loud", v > 150), Signal("Odd", F.col("kind").isin("b"))
    KEPT = r.Rollup("1h", {"n": r.count(), "big": r.count(v > 50), "total": r.total(v), "low": r.least(v), "high": r.greatest(v), "middle": r.mean(v),
                           "users": r.distinct(F.col("user")), "p95": r.percentile(v, 95), "p5": r.percentile(v, 5)},
                    {"kind": F.col("kind")}, (LOUD, ODD))


def events(spark, days, seed=1, per_day=600):
    rng = random.Random(seed)
    rows = [(f"{seed}-{d}-{i}", START + dt.timedelta(days=d, seconds=rng.randrange(86400)), rng.choice(["a", "b", None]),
             rng.choice([None, float("nan"), *[rng.lognormvariate(4, 1) for _ in range(12)]]), rng.randrange(300)) for d in days for i in range(per_day)]
    return spark.createDataFrame([*rows, (f"{seed}-none", None, "a", 1.0, 1)], "id string, ts timestamp, kind string, value double, user int")


def exact(df, every, by, start=None, end=None):
    v = F.col("value")
    aggs = {"n": F.count(F.lit(1)), "big": F.count_if(v > 50), "total": F.sum(v), "low": F.min(v), "high": F.max(v), "middle": F.avg(v), "users": F.countDistinct("user")}
    df = df.where("ts is not null")
    return time_slices(df, every, start, end, by, aggs) if every else group_by(df, by, aggs)


def close(a, b):
    return a == b or (a is not None and b is not None and (a != a and b != b or abs(a - b) <= 1e-9 * max(1, abs(a))))


def same(got, want, keys):
    got, want = ({tuple(x[k] for k in keys): x for x in rows} for rows in (got.collect(), want.collect()))
    assert got.keys() == want.keys() and got
    for k, x in got.items():
        for name in ("n", "big", "total", "low", "high", "middle"):
            assert close(x[name], want[k][name]), (k, name, x[name], want[k][name])
        assert abs(x["users"] - want[k]["users"]) <= max(1, 0.05 * want[k]["users"])


def ranks_hold(spark, path, df, by):
    values = {}
    for x in df.where("ts is not null and value is not null and not isnan(value)").collect():
        values.setdefault(tuple(x[k] for k in by), []).append(x["value"])
    for x in r.rolled_chart(spark, KEPT, path, by=by, measures=("p95", "p5")).collect():
        own = values[tuple(x[k] for k in by)]
        for p in (95, 5):
            below, upto = (sum(v < x[f"p{p}"] for v in own) / len(own), sum(v <= x[f"p{p}"] for v in own) / len(own))
            assert below - r.RANK_ERROR <= p / 100 <= upto + r.RANK_ERROR


@pytest.mark.parametrize("every, by", [("1h", ("kind",)), ("6h", ()), ("1d", ("kind",)), ("2d", ()), (None, ("kind",)), (None, ())])
def test_charts_equal_those_of_the_events(spark, tmp_path_factory, every, by):
    base = tmp_path_factory.mktemp("rolled")
    df = events(spark, range(4)).drop("id").where("value is null or not isnan(value)").persist()
    sinks.write_events(df, f"{base}/events")
    r.refresh(spark, KEPT, f"{base}/events", f"{base}/rollup")
    start, end = START + dt.timedelta(hours=6), START + dt.timedelta(days=3)
    for a, b in ((None, None), (start, end)):
        if every is None and a:
            continue
        got = r.rolled_chart(spark, KEPT, f"{base}/rollup", a, b, every, by)
        same(got, exact(df, every, list(by), a, b), [*by, *(["time"] if every else [])])
    for signal in (LOUD, ODD):
        got = r.rolled_chart(spark, KEPT, f"{base}/rollup", every=every, by=by, signal=signal.name)
        same(got, exact(df.where(signal.predicate), every, list(by)), [*by, *(["time"] if every else [])])
    ranks_hold(spark, f"{base}/rollup", df, by)


def test_refresh_reads_only_what_changed(spark, tmp_path):
    source, path = f"{tmp_path}/events", f"{tmp_path}/rollup"
    first = events(spark, range(3))
    sinks.write_events(first, source)
    day = [(START + dt.timedelta(days=d)).date() for d in range(6)]
    assert r.refresh(spark, KEPT, source, path) == day[:3]
    assert r.refresh(spark, KEPT, source, path) == []
    late = events(spark, [1, 4], seed=2)
    sinks.write_events(late, source)
    assert r.refresh(spark, KEPT, source, path) == [day[1], day[4]]
    both = first.unionByName(late).where("value is null or not isnan(value)")
    counted = {x.time.date(): x.n for x in r.rolled_chart(spark, KEPT, path, every="1d", by=()).collect()}
    assert counted == {day[0]: 600, day[1]: 1200, day[2]: 600, day[4]: 600} and both.count() < 3001
    lifecycle.delete_from_table(spark, source, F.col("kind") == "a", START, START + dt.timedelta(days=1))
    assert r.refresh(spark, KEPT, source, path) == [day[0]]
    assert "a" not in {x.kind for x in r.rolled_chart(spark, KEPT, path, START, START + dt.timedelta(days=1)).collect()}
    lifecycle.delete_from_table(spark, source, start=START + dt.timedelta(days=2), end=START + dt.timedelta(days=3))
    assert r.refresh(spark, KEPT, source, path) == []  # the rollup outlives its events
    assert r.refresh(spark, KEPT, source, path, forget=True) == [day[2]]
    assert r.refresh(spark, KEPT, source, path, forget=True) == []
    assert {x.time.date() for x in r.rolled_chart(spark, KEPT, path, every="1d", by=()).collect()} == {day[0], day[1], day[4]}
    other = r.Rollup("1h", {"n": r.count()})
    assert r.refresh(spark, other, source, path) == [day[0], day[1], day[4]]


def test_only_dates_of_the_range_and_named_states_are_read(spark, tmp_path):
    sinks.write_events(events(spark, range(3), per_day=20), f"{tmp_path}/events")
    r.refresh(spark, KEPT, f"{tmp_path}/events", f"{tmp_path}/rollup")
    chart = r.rolled_chart(spark, KEPT, f"{tmp_path}/rollup", START, START + dt.timedelta(days=1), "1d", (), ("n",))
    plan = chart._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "users" not in plan and "p95" not in plan
    assert chart.collect()[0].n == 20


def test_odd_rollups(spark, tmp_path):
    for bad in (lambda: r.Rollup("7h", {"n": r.count()}), lambda: r.Rollup("1h", {"time": r.count()}), lambda: r.Rollup("1h", {"n": r.count()}, signals=(Signal("*", F.lit(True)),))):
        with pytest.raises(ValueError):
            bad()
    empty = events(spark, []).where("false")
    assert r.roll_up(empty, KEPT).count() == 0
    sinks.write_events(events(spark, [0], per_day=3).withColumn("value", F.lit(None).cast("double")), f"{tmp_path}/events")
    r.refresh(spark, KEPT, f"{tmp_path}/events", f"{tmp_path}/rollup")
    row = r.rolled_chart(spark, KEPT, f"{tmp_path}/rollup", by=()).first()
    assert (row.n, row.big, row.total, row.low, row.middle, row.p95) == (3, 0, None, None, None, None)
    for options in (dict(every="90m"), dict(start="2024-03-01 00:30:00"), dict(signal="Quiet")):
        with pytest.raises(ValueError):
            r.rolled_chart(spark, KEPT, f"{tmp_path}/rollup", **options)
