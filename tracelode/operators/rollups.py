"""Incremental rollups: mergeable states per slice, key and signal, from which charts are drawn without the events.

A rollup is a table of states next to an event table, partitioned by date like it. Counts, sums, least and greatest values
merge exactly; distinct counts are HyperLogLog sketches and percentiles KLL sketches, so both merge within a known error.
:func:`refresh` reads only the dates whose files changed since they were last rolled up, and :func:`rolled_chart`
merges the states to any coarser slice and any fewer keys.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.logic import is_true
from ..functions.times import duration_us
from ..model import DATE_COLUMN
from .lifecycle import replace_partitions
from .query import slice_start
from .signals import Signal

#: Registers of a distinct count, as a power of two: its relative standard error is about 1.04 / sqrt(2 ** LG_K).
LG_K = 12
#: Size of a percentile sketch. The rank of its answer is off by less than :data:`RANK_ERROR` (99 times in 100).
KLL_K = 400
RANK_ERROR = 0.008
#: The signal of all events.
EVERYTHING = "*"
_DAY_US = 86_400_000_000


@dataclass(frozen=True)
class Measure:
    """``states`` are kept per slice, ``merge`` joins them, and ``result`` reads the merged ones."""

    kind: str
    value: Column | None = None
    p: float | None = None

    def states(self, name: str) -> dict[str, Column]:
        number = None if self.value is None else self.value.try_cast("double")
        return {
            "count": lambda: {name: F.count(F.lit(1)) if self.value is None else F.count_if(is_true(self.value))},
            "sum": lambda: {name: F.sum(number)},
            "min": lambda: {name: F.min(number)},
            "max": lambda: {name: F.max(number)},
            "mean": lambda: {f"{name}__sum": F.sum(number), f"{name}__n": F.count(number)},
            "distinct": lambda: {name: F.hll_sketch_agg(self.value.cast("string"), LG_K)},
            "percentile": lambda: {name: F.kll_sketch_agg_double(F.when(~F.isnan(number), number), F.lit(KLL_K))},
        }[self.kind]()

    def merge(self, name: str) -> dict[str, Column]:
        by_kind = {"min": F.min, "max": F.max, "distinct": F.hll_union_agg, "percentile": F.kll_merge_agg_double}
        return {state: by_kind.get(self.kind, F.sum)(state) for state in self.states(name)}

    def result(self, name: str) -> Column:
        if self.kind == "mean":
            return F.when(F.col(f"{name}__n") > 0, F.col(f"{name}__sum") / F.col(f"{name}__n"))
        if self.kind == "distinct":
            return F.hll_sketch_estimate(name)
        if self.kind == "percentile":
            return F.when(F.kll_sketch_get_n_double(name) > 0, F.kll_sketch_get_quantile_double(name, F.lit(self.p / 100.0)))
        return F.col(name)


def count(predicate: Column | None = None) -> Measure:
    """Events, or those that match."""
    return Measure("count", predicate)


def total(value: Column) -> Measure:
    return Measure("sum", value)


def least(value: Column) -> Measure:
    return Measure("min", value)


def greatest(value: Column) -> Measure:
    return Measure("max", value)


def mean(value: Column) -> Measure:
    return Measure("mean", value)


def distinct(value: Column) -> Measure:
    return Measure("distinct", value)


def percentile(value: Column, p: float) -> Measure:
    return Measure("percentile", value, p)


@dataclass(frozen=True)
class Rollup:
    """What is kept: ``every`` must divide a day, so that a slice never crosses a date partition."""

    every: str
    measures: dict[str, Measure]
    keys: dict[str, Column] = field(default_factory=dict)
    signals: tuple[Signal, ...] = ()
    where: Column | None = None

    def __post_init__(self):
        if _DAY_US % duration_us(self.every):
            raise ValueError(f"slices of {self.every} don't divide a day")
        taken = {"time", "signal", DATE_COLUMN} & {*self.keys, *self.measures} | self.keys.keys() & self.measures.keys()
        if taken or EVERYTHING in {s.name for s in self.signals}:
            raise ValueError(f"reserved or repeated names: {sorted(taken) or EVERYTHING}")

    def definition(self) -> str:
        """Tells rollups apart that keep other things."""
        return repr((self.every, sorted((n, m.kind, str(m.value)) for n, m in self.measures.items()), sorted((n, str(c)) for n, c in self.keys.items()),
                     sorted((s.name, str(s.predicate)) for s in self.signals), str(self.where), LG_K, KLL_K))


def roll_up(events: DataFrame, rollup: Rollup) -> DataFrame:
    """The states of ``events``: one row for each date, slice, combination of keys and signal. Events without a time have no slice.

    An event counts under :data:`EVERYTHING` and under each signal it matches. States are joined on the map side.
    """
    rows = events.where(F.col("ts").isNotNull())
    rows = rows if rollup.where is None else rows.where(rollup.where)
    names = F.array(F.lit(EVERYTHING), *(F.when(is_true(s.predicate), F.lit(s.name)) for s in rollup.signals))
    states = {n: c for name, m in rollup.measures.items() for n, c in m.states(name).items()}
    rows = rows.withColumns({"__names": F.array_compact(names), "__time": slice_start(F.col("ts"), rollup.every),
                             **{f"__key_{n}": c for n, c in rollup.keys.items()}})
    rows = rows.withColumn("__signal", F.explode("__names"))
    grouped = rows.groupBy(F.col("__signal").alias("signal"), *(F.col(f"__key_{n}").alias(n) for n in rollup.keys), F.col("__time").alias("time"))
    return grouped.agg(*(c.alias(n) for n, c in states.items())).withColumn(DATE_COLUMN, F.col("time").cast("date"))


def date_versions(spark: SparkSession, source: str, rollup: Rollup) -> DataFrame:
    """(date, version) of every date of an event table, from the names, sizes and times of its files; no file is opened.

    Works for tables by date and for those of a stream, by date and batch. Files without a date hold events without a time.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(source)
    each = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    return (files.where(F.col(DATE_COLUMN).isNotNull()).groupBy(F.col(DATE_COLUMN).cast("date").alias("date"))
            .agg(F.xxhash64(F.bit_xor(each), F.count(F.lit(1)), F.sum("length"), F.lit(rollup.definition())).alias("version")))


def refresh(spark: SparkSession, rollup: Rollup, source: str, path: str, forget: bool = False) -> list[dt.date]:
    """Brings the rollup at ``path`` up to date with the event table at ``source``; returns the dates that were read.

    A date is read again if its files or the rollup's definition changed since, so late events, deletions and compaction
    are followed. Dates that left the event table keep their slices (a rollup may outlive its events), unless
    ``forget``. Each date's slices are put in place as a whole and noted afterwards, so a refresh that broke off is repeated by the next one.
    The driver sees one row per changed date.
    """
    slices, ledger = f"{path.rstrip('/')}/slices", f"{path.rstrip('/')}/ledger"
    now, known = date_versions(spark, source, rollup), _ledger(spark, ledger)
    joined = now.join(known.withColumnRenamed("version", "__known"), "date", "full")
    changed = joined.where(~F.col("version").eqNullSafe(F.col("__known"))).select("date", "version").collect()
    stale = sorted((r for r in changed if r.version is not None or forget), key=lambda r: r.date)
    if stale:
        dates = [r.date for r in stale if r.version is not None]
        events = spark.read.parquet(source).where(F.col(DATE_COLUMN).isin(dates))
        replace_partitions(spark, slices, roll_up(events, rollup), [DATE_COLUMN], [{DATE_COLUMN: r.date} for r in stale])
        noted = spark.createDataFrame([(r.date, r.version) for r in stale], "date date, version bigint").coalesce(1)
        noted.withColumn("noted", F.lit(dt.datetime.now(dt.timezone.utc).isoformat())).write.mode("append").parquet(ledger)
    return [r.date for r in stale]


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of each date; a date that was forgotten has none."""
    schema = "date date, version bigint, noted string"
    notes = spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)
    newest = notes.groupBy("date").agg(F.max(F.struct("noted", "version")).alias("__n"))
    return newest.select("date", F.col("__n.version").alias("version")).where("version is not null")


def _aligned(at, width: int, what: str) -> dt.datetime | None:
    if at is None:
        return None
    at = at if isinstance(at, dt.datetime) else dt.datetime.fromisoformat(str(at))
    if (at - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1) % width:
        raise ValueError(f"{what} {at} lies inside a slice of the rollup")
    return at


def rolled_chart(spark: SparkSession, rollup: Rollup, path: str, start=None, end=None, every: str | None = None, by: tuple[str, ...] | None = None,
                 measures: tuple[str, ...] | None = None, signal: str = EVERYTHING, having: Column | None = None) -> DataFrame:
    """Keys, ``time`` if there is an interval, then measures: what a chart over the events themselves shows.

    ``every`` is a multiple of the rollup's slices and ``start`` and ``end`` are edges of them; ``by`` and ``measures``
    may name fewer than are kept. Only the dates of the range and the states of the named measures are read.
    """
    width = duration_us(rollup.every)
    start, end = _aligned(start, width, "start"), _aligned(end, width, "end")
    if every is not None and duration_us(every) % width:
        raise ValueError(f"{every} is no multiple of {rollup.every}")
    if signal not in {EVERYTHING, *(s.name for s in rollup.signals)}:
        raise ValueError(f"signal {signal} isn't rolled up")
    by = tuple(rollup.keys) if by is None else by
    wanted = {n: rollup.measures[n] for n in (rollup.measures if measures is None else measures)}
    rows = spark.read.parquet(f"{path.rstrip('/')}/slices").where(F.col("signal") == signal)
    if start is not None:
        rows = rows.where((F.col(DATE_COLUMN) >= F.lit(start.date())) & (F.col("time") >= F.lit(start)))
    if end is not None:
        rows = rows.where((F.col(DATE_COLUMN) <= F.lit(end.date())) & (F.col("time") < F.lit(end)))
    slots = [] if every is None else [slice_start(F.col("time"), every, start).alias("time")]
    merged = rows.groupBy(*by, *slots).agg(*(c.alias(n) for name, m in wanted.items() for n, c in m.merge(name).items()))
    result = merged.select(*by, *(["time"] if slots else []), *(m.result(name).alias(name) for name, m in wanted.items()))
    return result if having is None else result.where(having)
