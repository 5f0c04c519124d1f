"""Named, saved event filters and their algebra."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from ..functions.logic import is_true
from ..functions.values import prop, template_id_of


@dataclass(frozen=True)
class Signal:
    """A named predicate. ``a & b`` is intersection, ``a | b`` is union; both stay one scan.

    A filter keeps a row only if the predicate is true, and so do ``and`` and ``or`` of predicates that may
    be undefined: nothing is wrapped, so that scans see plain comparisons. :func:`signal_column` is for
    where the value itself is used.
    """

    name: str
    predicate: Column

    def __and__(self, other: "Signal") -> "Signal":
        return Signal(f"({self.name} and {other.name})", self.predicate & other.predicate)

    def __or__(self, other: "Signal") -> "Signal":
        return Signal(f"({self.name} or {other.name})", self.predicate | other.predicate)


def signal_predicate(signal: Signal | Column) -> Column:
    """For filters: undefined where the signal's value is."""
    return signal.predicate if isinstance(signal, Signal) else signal


def signal_column(signal: Signal | Column) -> Column:
    """True or false for every event."""
    return is_true(signal_predicate(signal))


def intersect(*signals: Signal | None) -> Signal | None:
    """Intersection of those given; ``None`` means no restriction."""
    result = None
    for signal in signals:
        if signal is not None:
            result = signal if result is None else result & signal
    return result


def union(*signals: Signal) -> Signal:
    result = signals[0]
    for signal in signals[1:]:
        result = result | signal
    return result


# The level spellings that each stock signal accepts.
ERROR_SPELLINGS = (
    "f", "fa", "fat", "ftl", "fata", "fatl", "fatal",
    "c", "cr", "cri", "crt", "crit", "critical",
    "alert", "emerg", "panic",
    "e", "er", "err", "eror", "erro", "error",
)
WARNING_SPELLINGS = ("w", "wa", "war", "wrn", "warn", "warning")
INFORMATION_SPELLINGS = ("inf", "info", "information")


def level_in(spellings) -> Column:
    return F.lower("level").isin(list(spellings))


def by_template(name: str, *templates: str) -> Signal:
    """Events raised by given message templates."""
    return Signal(name, F.col("event_type_id").isin([template_id_of(t) for t in templates]))


def by_property(name: str, path: str, value) -> Signal:
    kind = "string" if isinstance(value, str) else "double"
    return Signal(name, prop(path, kind) == value)


def by_status(name: str, low: int, high: int, path: str = "StatusCode") -> Signal:
    """A class of HTTP status codes, ``low`` inclusive to ``high`` exclusive."""
    code = prop(path, "double")
    return Signal(name, (code >= low) & (code < high))


def catalogue() -> dict[str, Signal]:
    """The stock signals."""
    return {s.name: s for s in (
        Signal("Errors", level_in(ERROR_SPELLINGS)),
        Signal("Warnings", level_in(WARNING_SPELLINGS)),
        Signal("Information", level_in(INFORMATION_SPELLINGS)),
        Signal("Exceptions", F.col("exception").isNotNull()),
        Signal("Logs", F.col("start").isNull()),
        Signal("Spans", F.col("start").isNotNull() & F.col("span_id").isNotNull()),
        by_status("Success", 200, 300),
        by_status("Bad Request", 400, 401),
        by_status("Not Found", 404, 405),
        by_status("Internal Server Error", 500, 501),
    )}
