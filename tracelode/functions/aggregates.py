"""Aggregates as ``Column`` builders; all of them combine on the map side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .logic import is_true


def count_all() -> Column:
    return F.count(F.lit(1))


def count_of(value: Column) -> Column:
    """Events with a non-null value."""
    return F.count(value)


def count_where(predicate: Column) -> Column:
    """Events that match."""
    return F.count_if(is_true(predicate))


def count_distinct(value: Column, approximate: float | None = None) -> Column:
    return F.count_distinct(value) if approximate is None else F.approx_count_distinct(value, approximate)


def all_of(predicate: Column) -> Column:
    return F.bool_and(is_true(predicate))


def any_of(predicate: Column) -> Column:
    return F.bool_or(is_true(predicate))


def first_of(value: Column, ts: str = "ts", id: str = "id") -> Column:
    """Value on the earliest event; ties go to the smaller id."""
    return F.min_by(value, F.struct(F.col(ts), F.col(id)))


def last_of(value: Column, ts: str = "ts", id: str = "id") -> Column:
    """Value on the latest event; ties go to the larger id."""
    return F.max_by(value, F.struct(F.col(ts), F.col(id)))


def min_of(value: Column) -> Column:
    return F.min(value.try_cast("double"))


def max_of(value: Column) -> Column:
    return F.max(value.try_cast("double"))


def mean_of(value: Column) -> Column:
    return F.avg(value.try_cast("double"))


def sum_of(value: Column) -> Column:
    return F.sum(value.try_cast("double"))


def percentile_within(value: Column, p: float, err: float) -> Column:
    """Percentile with a permitted rank error, from a mergeable sketch of fixed size."""
    return F.percentile_approx(value, p / 100.0, int(round(1 / err)))


def interval_of(every) -> Column:
    """Length of a time slice in microseconds."""
    from .times import duration_us

    return F.lit(duration_us(every)).cast("bigint")
