import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.operators.alerts import CHUNK_STARTS, suppress

EPOCH = dt.datetime(1970, 1, 1)


def by_hand(times, width):
    kept, until = [], None
    for t in sorted(set(times)):
        if until is None or t >= until:
            kept.append(t)
            until = t + width
    return kept


def firings(spark, rows):
    return spark.createDataFrame([(a, i) for i, (a, _) in enumerate(rows)], "alert string, group int").join(
        spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "group int, us bigint"), "group").select("alert", "group", F.timestamp_micros("us").alias("time"))


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("per_chunk", [1, 5, 1 << 16])
def test_against_the_rule(spark, seed, per_chunk):
    r = random.Random(seed)
    width = 10_000_000
    rows = [("a", r.randrange(-200, 4000) * 500_000) for _ in range(400)] + [("b", i * 3_333_333) for i in range(300)] + [("c", r.randrange(10) * 90_000_000) for _ in range(20)]
    rows += [("d", 7), ("e", 0), ("e", width - 1), ("e", width), ("e", 2 * width - 1), (None, 5), ("d", None)] + rows[:40]
    got = suppress(firings(spark, rows), "10 seconds", window="2 seconds", per_chunk=per_chunk).select("alert", F.unix_micros("time").alias("t"), "group").collect()
    want = {a: set(by_hand([t for b, t in rows if a == b and t is not None], width)) for a in "abcde"}
    assert sorted((x.alert, x.t, x.group) for x in got) == sorted((a, t, i) for i, (a, t) in enumerate(rows) if a is not None and t is not None and t in want[a])


def test_no_firings(spark):
    assert suppress(firings(spark, [("a", 1)]).where("false"), "1m").count() == 0


def test_a_million_firings_of_one_alert_are_spread(spark):
    """One firing a minute or so for two years, silenced for ten minutes: sixteen chunks at least."""
    second = (F.col("id") * 60 + F.pmod(F.xxhash64("id"), F.lit(50))).cast("bigint")
    df = spark.range(1_000_000).select(F.lit("only").alias("alert"), F.timestamp_seconds(second).alias("time"))
    kept = suppress(df, "10 minutes")
    plan = kept._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "FlatMapGroupsInArrow" in plan
    at = np.sort(np.array([x[0] for x in df.select(F.unix_seconds("time")).toPandas().to_numpy()], np.int64))
    want, i = [], 0
    while i < len(at):
        want.append(int(at[i]))
        i = int(np.searchsorted(at, at[i] + 600))
    assert sorted(int(x[0]) for x in kept.select(F.unix_seconds("time")).collect()) == want and len(want) > 80_000
    assert at[-1] // (CHUNK_STARTS * 60) >= 14
