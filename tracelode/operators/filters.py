"""Scans and filters over ``stream``."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..model import DATE_COLUMN
from .signals import Signal, signal_predicate


def _instant(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def time_range(df: DataFrame, start=None, end=None, ts: str = "ts") -> DataFrame:
    """Inclusive start, exclusive end.

    On a table partitioned by date the bounds are repeated on the partition column, because
    Catalyst does not derive one from the other; whole days are then never opened.
    """
    dated = DATE_COLUMN in df.columns
    if start is not None:
        df = df.where(F.col(ts) >= _instant(start))
        if dated:
            df = df.where(F.col(DATE_COLUMN) >= _instant(start).cast("date"))
    if end is not None:
        df = df.where(F.col(ts) < _instant(end))
        if dated:
            df = df.where(F.col(DATE_COLUMN) <= _instant(end).cast("date"))
    return df


def where_all(df: DataFrame, *predicates: Column) -> DataFrame:
    """Events for which every predicate is true."""
    kept = [p for p in predicates if p is not None]
    return df.where(reduce(lambda a, b: a & b, kept)) if kept else df


def where_any(df: DataFrame, *predicates: Column) -> DataFrame:
    """Events for which some predicate is true; undefined ones do not poison the others."""
    return df.where(reduce(lambda a, b: a | b, predicates))


def apply_signal(df: DataFrame, signal: Signal | Column | None) -> DataFrame:
    return df if signal is None else df.where(signal_predicate(signal))


def search(df: DataFrame, predicate: Column | None = None, start=None, end=None,
           signal: Signal | Column | None = None, limit: int | None = None) -> DataFrame:
    """Matching events, newest first. With a limit this is a top-k, not a sort."""
    df = apply_signal(time_range(df, start, end), signal)
    if predicate is not None:
        df = df.where(predicate)
    ordered = df.orderBy(F.col("ts").desc(), F.col("id").desc())
    return ordered if limit is None else ordered.limit(limit)


def text_search(df: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring in the message or the exception."""
    wanted = text.lower()
    return df.where(F.contains(F.lower("message"), F.lit(wanted)) | F.contains(F.lower("exception"), F.lit(wanted)))


def events_in_trace(df: DataFrame, trace_id, span_id=None) -> DataFrame:
    df = df.where(F.col("trace_id") == trace_id)
    return df if span_id is None else df.where(F.col("span_id") == span_id)


def bounded(df: DataFrame, start=None, end=None, trace_id=None, id=None) -> DataFrame:
    """Refuse a scan of everything: some bound on time, trace or id is required."""
    if start is None and trace_id is None and id is None:
        raise ValueError("bound the query by a start time, a trace id or an event id")
    df = time_range(df, start, end)
    if trace_id is not None:
        df = events_in_trace(df, trace_id)
    return df if id is None else df.where(F.col("id") == id)


def last(reference: dt.datetime, span: dt.timedelta) -> tuple[dt.datetime, dt.datetime]:
    """The range that ends at ``reference`` and covers ``span``."""
    return reference - span, reference
