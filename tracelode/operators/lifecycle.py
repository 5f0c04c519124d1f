"""Deletion and retention."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.logic import is_true, op_not
from ..functions.times import duration_us, from_us, ticks_us
from ..model import BATCH_COLUMN, DATE_COLUMN
from ..session import delete_folder, move_folder
from .signals import Signal, signal_column


def _matching(predicate=None, start=None, end=None, signal: Signal | Column | None = None) -> Column:
    parts = []
    if start is not None:
        parts.append(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        parts.append(F.col("ts") < F.lit(end).cast("timestamp"))
    if predicate is not None:
        parts.append(is_true(predicate))
    if signal is not None:
        parts.append(signal_column(signal))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def delete_events(df: DataFrame, predicate: Column | None = None, start=None, end=None,
                  signal: Signal | Column | None = None) -> DataFrame:
    """The events that survive a deletion. Without any condition nothing survives."""
    return df.where(op_not(_matching(predicate, start, end, signal)))


@dataclass(frozen=True)
class RetentionPolicy:
    """Events older than ``after`` go: all of them, or those of a signal."""

    after: str
    signal: Signal | Column | None = None
    source: str = "stream"

    def __post_init__(self):
        if self.source not in ("stream", "series"):
            raise ValueError("retention applies to 'stream' or 'series'")
        if self.signal is not None and self.source != "stream":
            raise ValueError("only the stream can be thinned by a signal")
        duration_us(self.after)

    def expired(self, now) -> Column:
        limit = from_us(ticks_us(F.lit(now)) - duration_us(self.after))
        old = F.col("ts") < limit
        return old if self.signal is None else old & signal_column(self.signal)


def apply_retention(df: DataFrame, policies: list[RetentionPolicy], now, source: str = "stream") -> DataFrame:
    """The events that no policy removes."""
    for policy in policies:
        if policy.source == source:
            df = df.where(op_not(policy.expired(now)))
    return df


def _partition_columns(table: DataFrame) -> list[str]:
    """The date, and the batch of tables that are written by a stream."""
    return [c for c in (DATE_COLUMN, BATCH_COLUMN) if c in table.columns]


def _folder(row, columns: list[str]) -> str:
    return "/".join(f"{c}={'__HIVE_DEFAULT_PARTITION__' if row[c] is None else row[c]}" for c in columns)


def replace_partitions(spark: SparkSession, path: str, rows: DataFrame, columns: list[str], touched: list) -> None:
    """Puts ``rows`` in the place of the touched partitions. They are written aside, in a folder that readers
    skip, and only then moved in, one whole partition at a time; those without rows go."""
    aside = f"{path.rstrip('/')}/_rewrite-{uuid.uuid4().hex}"
    try:
        rows.hint("rebalance", *columns).write.partitionBy(*columns).option("parquet.bloom.filter.enabled#trace_id", "true").parquet(aside)
        for row in touched:
            move_folder(spark, f"{aside}/{_folder(row, columns)}", f"{path.rstrip('/')}/{_folder(row, columns)}")
    finally:
        delete_folder(spark, aside)


def _within(columns: list[str], touched: list) -> Column:
    """Rows of some partitions, those without a date included."""
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(r[c])) for c in columns]) for r in touched], F.lit(False))


def delete_from_table(spark: SparkSession, path: str, predicate: Column | None = None, start=None, end=None,
                      signal: Signal | Column | None = None) -> int:
    """Deletes from a table written by ``write_events`` or ``ingest_stream`` and returns how many events went.

    Only partitions that hold a matching event are rewritten; those left empty are dropped. Events without
    a time match no range, and otherwise count like all others. The driver sees one row per touched partition.
    """
    table = spark.read.parquet(path)
    columns = _partition_columns(table)
    if start is not None:
        table = table.where(F.col(DATE_COLUMN) >= F.lit(start).cast("timestamp").cast("date"))
    if end is not None:
        table = table.where(F.col(DATE_COLUMN) <= F.lit(end).cast("timestamp").cast("date"))
    doomed = is_true(_matching(predicate, start, end, signal))
    touched = table.groupBy(*columns).agg(F.count_if(doomed).alias("gone")).where(F.col("gone") > 0).collect()
    if touched:
        replace_partitions(spark, path, table.where(_within(columns, touched)).where(~doomed), columns, touched)
    return sum(r["gone"] for r in touched)


def compact_table(spark: SparkSession, path: str) -> int:
    """Joins the batches of each date of a streamed table into its last one; returns how many dates were rewritten."""
    table = spark.read.parquet(path)
    columns = _partition_columns(table)
    if BATCH_COLUMN not in columns:
        return 0
    many = (table.groupBy(DATE_COLUMN).agg(F.collect_set(BATCH_COLUMN).alias("batches"), F.max(BATCH_COLUMN).alias(BATCH_COLUMN))
            .where(F.size("batches") > 1).collect())
    if many:
        rows = table.where(_within([DATE_COLUMN], many))
        newest = spark.createDataFrame([(r[DATE_COLUMN], r[BATCH_COLUMN]) for r in many], f"_date date, _batch {dict(table.dtypes)[BATCH_COLUMN]}")
        rows = rows.join(newest, F.col(DATE_COLUMN).eqNullSafe(F.col("_date"))).withColumn(BATCH_COLUMN, F.col("_batch")).drop("_date", "_batch")
        touched = [{DATE_COLUMN: r[DATE_COLUMN], BATCH_COLUMN: b} for r in many for b in r["batches"]]
        replace_partitions(spark, path, rows.select(*table.columns), columns, touched)
    return len(many)


def retain_in_table(spark: SparkSession, path: str, policies: list[RetentionPolicy], now, source: str = "stream") -> int:
    """Applies retention to a table. Only dates before the limit are looked at."""
    removed = 0
    for policy in policies:
        if policy.source == source:
            removed += delete_from_table(spark, path, policy.expired(now), end=_limit(policy, now))
    return removed


def _limit(policy: RetentionPolicy, now) -> dt.datetime:
    at = now if isinstance(now, dt.datetime) else dt.datetime.fromisoformat(str(now))
    return at - dt.timedelta(microseconds=duration_us(policy.after))
