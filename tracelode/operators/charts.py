"""Charts: saved queries with signals, a range and an optional time grouping."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.times import UNITS_US, duration_us
from .filters import apply_signal, time_range
from .query import group_by, time_slices
from .signals import Signal, intersect


@dataclass(frozen=True)
class Chart:
    """Measures over a source; ``percentiles`` hold (value, p) pairs."""

    title: str
    measures: dict[str, Column] = field(default_factory=dict)
    percentiles: dict[str, tuple] = field(default_factory=dict)
    where: Column | None = None
    group_by: dict[str, Column] = field(default_factory=dict)
    ci: tuple[str, ...] = ()
    signal: Signal | None = None
    query_signal: Signal | None = None
    having: Column | None = None
    order_by: tuple[Column | str, ...] = ()
    limit: int | None = None


def chart_range(now: dt.datetime, last, every=None) -> tuple[dt.datetime, dt.datetime]:
    """The range of the last so-and-so long; its start is rounded down to the unit of the interval."""
    start = now - dt.timedelta(microseconds=duration_us(last))
    if every is None:
        return start, now
    width = duration_us(every)
    start = start.replace(microsecond=0)
    if width >= UNITS_US["m"]:
        start = start.replace(second=0)
    if width >= UNITS_US["h"]:
        start = start.replace(minute=0)
    if width >= UNITS_US["d"]:
        start = start.replace(hour=0)
    return start, now


def render_chart(df: DataFrame, chart: Chart, start=None, end=None, last=None, now: dt.datetime | None = None, every=None,
                 signal: Signal | None = None, dashboard_signal: Signal | None = None, fill: bool = False) -> DataFrame:
    """One result: keys, then ``time`` when there is an interval, then measures."""
    if last is not None:
        start, end = chart_range(now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None), last, every)
    rows = apply_signal(time_range(df, start, end), intersect(signal, dashboard_signal, chart.signal, chart.query_signal))
    if chart.where is not None:
        rows = rows.where(chart.where)
    if every is not None:
        result = time_slices(rows, every, start, end, chart.group_by, chart.measures, chart.percentiles, chart.ci, chart.having, fill)
    else:
        result = group_by(rows, chart.group_by, chart.measures, chart.percentiles, chart.ci, chart.having)
    order = chart.order_by or ([*(["time"] if every is not None else []), *chart.group_by])
    if order:
        result = result.orderBy(*order)
    return result if chart.limit is None else result.limit(chart.limit)


def flatten_result(df: DataFrame, keys, measures) -> DataFrame:
    """Column order of a flat result: keys, ``time`` when present, measures."""
    middle = ["time"] if "time" in df.columns else []
    return df.select(*keys, *middle, *[m for m in measures if m not in keys and m != "time"])


def rounded_ms(value: Column) -> Column:
    """Whole milliseconds as display text."""
    return F.concat(F.round(value).cast("bigint").cast("string"), F.lit(" ms"))
