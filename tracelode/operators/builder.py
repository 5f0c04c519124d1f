"""Queries in the order people say them: source, range, filter, grouping, measures, order, limit."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from .filters import apply_signal, bounded
from .joins import lateral_unnest
from .query import group_by, time_slices
from .signals import Signal, intersect


@dataclass(frozen=True)
class Query:
    """An immutable description of a query; each step returns a new one and :meth:`rows` builds the plan.

    A bound on time, trace or id is required, as is usual for tables of this size;
    :meth:`unbounded` says that a scan of everything is meant.
    """

    source: DataFrame
    bounds: dict = field(default_factory=dict)
    free: bool = False
    signals: tuple[Signal, ...] = ()
    predicates: tuple[Column, ...] = ()
    unnested: tuple[tuple[Column | str, str], ...] = ()
    keys: dict[str, Column] = field(default_factory=dict)
    ci: tuple[str, ...] = ()
    interval: str | None = None
    filled: bool = False
    columns: dict[str, Column] = field(default_factory=dict)
    measures: dict[str, Column] = field(default_factory=dict)
    ranks: dict[str, tuple] = field(default_factory=dict)
    condition: Column | None = None
    order: tuple[Column | str, ...] = ()
    cap: int | None = None

    def between(self, start=None, end=None) -> "Query":
        return replace(self, bounds={**self.bounds, "start": start, "end": end})

    def in_trace(self, trace_id: str) -> "Query":
        return replace(self, bounds={**self.bounds, "trace_id": trace_id})

    def with_id(self, id: str) -> "Query":
        return replace(self, bounds={**self.bounds, "id": id})

    def unbounded(self) -> "Query":
        return replace(self, free=True)

    def signal(self, *signals: Signal) -> "Query":
        return replace(self, signals=self.signals + signals)

    def where(self, *predicates: Column) -> "Query":
        return replace(self, predicates=self.predicates + predicates)

    def unnest(self, array: Column | str, alias: str) -> "Query":
        return replace(self, unnested=self.unnested + ((array, alias),))

    def group(self, *names: str, ci: tuple[str, ...] = (), **keys: Column) -> "Query":
        named = {**{n: F.col(n) for n in names}, **keys}
        return replace(self, keys={**self.keys, **named}, ci=self.ci + tuple(ci))

    def every(self, interval: str, fill: bool = False) -> "Query":
        return replace(self, interval=interval, filled=fill)

    def select(self, *names: str, **columns: Column) -> "Query":
        """Plain columns, for queries that do not aggregate."""
        return replace(self, columns={**self.columns, **{n: F.col(n) for n in names}, **columns})

    def measure(self, **measures: Column) -> "Query":
        return replace(self, measures={**self.measures, **measures})

    def percentile(self, **ranks: tuple) -> "Query":
        """(value, p) or (value, p, count) by name."""
        return replace(self, ranks={**self.ranks, **ranks})

    def having(self, condition: Column) -> "Query":
        return replace(self, condition=condition)

    def order_by(self, *order: Column | str) -> "Query":
        return replace(self, order=order)

    def limit(self, n: int | None) -> "Query":
        return replace(self, cap=n)

    def rows(self) -> DataFrame:
        df = self.source if self.free and not self.bounds else bounded(self.source, **self.bounds)
        df = apply_signal(df, intersect(*self.signals))
        for array, alias in self.unnested:
            df = lateral_unnest(df, array, alias)
        for predicate in self.predicates:
            df = df.where(predicate)
        if self.interval is not None:
            start, end = self.bounds.get("start"), self.bounds.get("end")
            result = time_slices(df, self.interval, start, end, self.keys, self.measures, self.ranks, self.ci, self.condition, self.filled)
            order = self.order or ("time", *self.keys)
        elif self.keys or self.measures or self.ranks:
            result = group_by(df, self.keys, self.measures, self.ranks, self.ci, self.condition)
            order = self.order
        else:
            # Time-ascending is the default order of plain rows.
            ordered = df.orderBy(*(self.order or ("ts", "id")))
            ordered = ordered if self.cap is None else ordered.limit(self.cap)
            return ordered.select(*[c.alias(n) for n, c in self.columns.items()]) if self.columns else ordered
        result = result.orderBy(*order) if order else result
        return result if self.cap is None else result.limit(self.cap)


def query(df: DataFrame) -> Query:
    return Query(df)
