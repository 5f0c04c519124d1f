"""Delivery to a handler: each event once, failures listed and delivered again."""

import datetime as dt
import os
from collections import Counter

from pyspark.sql import functions as F

from tracelode.streaming import delivery

SCHEMA = "id string, ts timestamp, kind string, items array<int>"
DAY = dt.datetime(2024, 1, 1, 12, 0, 0, 123456)


def put(spark, tmp_path, *ids, kind="x"):
    rows = [(i, DAY, kind, [1, 2]) for i in ids]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def noting(path, fails=()):
    """A handler that notes every event it has done in a file of its own."""
    def handle(event):
        if event["id"] in fails:
            raise RuntimeError(f"no {event['id']}")
        assert event["kind"] == "x" and list(event["items"]) == [1, 2] and event["ts"].microsecond == 123456
        with open(os.path.join(path, "seen"), "a") as out:
            out.write(f"{event['id']}\n")
    return handle


def run(spark, tmp_path, handler, **options):
    events = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    delivery.deliver(events, handler, str(tmp_path / "ledger"), str(tmp_path / "cp"), F.col("kind") == "x", available_now=True, **options).awaitTermination()


def seen(tmp_path):
    return Counter((tmp_path / "seen").read_text().split())


def dead(spark, tmp_path):
    return sorted((r["id"], r["attempts"], r["error"]) for r in delivery.dead_letters(spark, str(tmp_path / "ledger")).collect())


def test_each_event_once_over_restarts(spark, tmp_path):
    put(spark, tmp_path, *"abcdef")
    put(spark, tmp_path, "other", kind="y")
    run(spark, tmp_path, noting(str(tmp_path), "be"), chunks=3)
    assert seen(tmp_path) == Counter("acdf")
    assert dead(spark, tmp_path) == [("b", 1, "RuntimeError: no b"), ("e", 1, "RuntimeError: no e")]
    for name in ("0", ".0.crc"):  # the driver is lost before it notes the end of the batch
        (tmp_path / "cp" / "commits" / name).unlink(missing_ok=True)
    run(spark, tmp_path, noting(str(tmp_path), "be"), chunks=3)
    assert seen(tmp_path) == Counter("acdf")
    assert delivery.outcomes(spark, str(tmp_path / "ledger")).count() == 6


def test_only_the_chunk_that_was_cut_off_is_repeated(spark, tmp_path):
    put(spark, tmp_path, *"abcdefgh")
    run(spark, tmp_path, noting(str(tmp_path)), chunks=4)
    chunks = {c: {r["id"] for r in rows} for c in range(4)
              for rows in [delivery.outcomes(spark, str(tmp_path / "ledger")).where(F.col("chunk") == c).collect()]}
    cut = max(chunks, key=lambda c: len(chunks[c]))
    (tmp_path / "ledger" / "batch=0" / f"chunk={cut}" / "_SUCCESS").unlink()
    assert delivery.outcomes(spark, str(tmp_path / "ledger")).count() == 8 - len(chunks[cut])
    for name in ("0", ".0.crc"):
        (tmp_path / "cp" / "commits" / name).unlink(missing_ok=True)
    run(spark, tmp_path, noting(str(tmp_path)), chunks=4)
    assert seen(tmp_path) == Counter("abcdefgh") + Counter(chunks[cut])
    assert delivery.outcomes(spark, str(tmp_path / "ledger")).count() == 8


def test_dead_letters_are_delivered_again(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    put(spark, tmp_path, *"abcd")
    run(spark, tmp_path, noting(str(tmp_path), "bcd"), tries=2)
    assert dead(spark, tmp_path) == [(i, 2, f"RuntimeError: no {i}") for i in "bcd"]
    still = delivery.redeliver(spark, ledger, noting(str(tmp_path), "cd"), SCHEMA)
    assert sorted(r["id"] for r in still.collect()) == ["c", "d"] and seen(tmp_path) == Counter("ab")
    put(spark, tmp_path, *"ef")
    run(spark, tmp_path, noting(str(tmp_path), "f"))
    assert dead(spark, tmp_path) == [("c", 3, "RuntimeError: no c"), ("d", 3, "RuntimeError: no d"), ("f", 1, "RuntimeError: no f")]
    assert delivery.redeliver(spark, ledger, noting(str(tmp_path), "d"), SCHEMA).count() == 1
    assert dead(spark, tmp_path) == [("d", 4, "RuntimeError: no d")] and seen(tmp_path) == Counter("abcef")
    # A round that was cut off has no effect.
    (tmp_path / "ledger" / "round=-2" / "_SUCCESS").unlink()
    assert [r[0] for r in dead(spark, tmp_path)] == ["c", "d", "f"]


def test_nothing_to_deliver(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    assert delivery.outcomes(spark, ledger).count() == 0 and dead(spark, tmp_path) == []
    assert delivery.redeliver(spark, ledger, print, SCHEMA).count() == 0
    put(spark, tmp_path)
    put(spark, tmp_path, None, "a")
    run(spark, tmp_path, noting(str(tmp_path), (None,)), chunks=2)
    assert dead(spark, tmp_path) == [(None, 1, "RuntimeError: no None")]


def test_variants_arrive_as_json(spark):
    events = spark.createDataFrame([("a", '{"n": 1}'), ("b", None)], "id string, v string").select("id", F.parse_json("v").alias("v"))

    def handle(event):
        assert event["v"] == '{"n":1}'

    assert sorted((r["id"], r["error"] is None) for r in delivery.handed_out(events, handle).collect()) == [("a", True), ("b", False)]
