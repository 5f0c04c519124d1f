"""Alerts: windowed conditions, suppression and notifications."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.levels import normalise_level
from ..functions.times import duration_us
from .filters import apply_signal
from .joins import lateral_unnest
from .query import time_slices
from .signals import Signal

# Fixed value: the event type of notifications.
NOTIFICATION_EVENT_TYPE = 0xA1E77001

#: Window starts that one task of a suppression holds, about.
CHUNK_STARTS = 1 << 16


@dataclass(frozen=True)
class Alert:
    """A condition over tumbling windows.

    ``lateral`` holds (array, alias) pairs that are unnested in turn; ``percentiles`` hold
    (value, p) or (value, p, count).
    """

    title: str
    window: str
    having: Column
    measures: dict[str, Column] = field(default_factory=dict)
    percentiles: dict[str, tuple] = field(default_factory=dict)
    signal: Signal | None = None
    lateral: tuple[tuple[Column | str, str], ...] = ()
    where: Column | None = None
    group_by: dict[str, Column] = field(default_factory=dict)
    ci: tuple[str, ...] = ()
    level: str = "Error"
    suppression: str | None = None
    channels: tuple[str, ...] = ()
    disabled: bool = False


def alert_input(df: DataFrame, alert: Alert) -> DataFrame:
    """The rows that an alert measures."""
    rows = apply_signal(df, alert.signal)
    for array, alias in alert.lateral:
        rows = lateral_unnest(rows, array, alias)
    if alert.where is not None:
        rows = rows.where(alert.where)
    return rows.where(F.lit(False)) if alert.disabled else rows


def evaluate_alert(df: DataFrame, alert: Alert, start=None, end=None) -> DataFrame:
    """Windows and groups that meet the condition: ``alert``, ``level``, keys, ``time``, measures."""
    result = time_slices(alert_input(df, alert), alert.window, start, end, alert.group_by, alert.measures,
                         alert.percentiles, alert.ci, alert.having)
    return result.select(F.lit(alert.title).alias("alert"), normalise_level(F.lit(alert.level)).alias("level"), "*")


def suppress(firings: DataFrame, period, alert: str = "alert", time: str = "time", window: str = "1 minute", per_chunk: int = CHUNK_STARTS) -> DataFrame:
    """Firings that notify: after each, later ones of the same alert are silent for the period.

    The rule is sequential, but a chunk of an alert's time needs to know only when the silence before it ends,
    and that is within a period of its start. So each chunk first tells, for every such end that makes a difference,
    when its own last silence would end; one short row per chunk is then followed in order; and
    each chunk at last names its notifications. The first and last step split one alert over as many tasks
    as it has chunks. A chunk is as many whole periods as hold ``per_chunk`` windows of the alert, one period at least; its
    length changes the work and never the result. A firing without an alert name or a time notifies nobody.
    """
    width = duration_us(period)
    chunk = max(1, per_chunk * duration_us(window) // width) * width
    starts = firings.select(F.col(alert).alias("_alert"), F.unix_micros(time).alias("_at")).distinct().where("_alert is not null and _at is not null")
    chunked = starts.withColumn("_chunk", F.floor(F.col("_at") / chunk))
    ends = chunked.groupBy("_alert", "_chunk").applyInArrow(_silences(width, chunk), "_alert STRING, _chunk BIGINT, _entries ARRAY<BIGINT>, _ends ARRAY<BIGINT>")
    entered = ends.groupBy("_alert").applyInArrow(_entries, "_alert STRING, _chunk BIGINT, _entry BIGINT")
    notified = (chunked.join(entered, ["_alert", "_chunk"]).where("_at >= _entry").groupBy("_alert", "_chunk")
                .applyInArrow(_notifications(width), "_alert STRING, _at BIGINT"))
    on = (F.col(alert) == F.col("_alert")) & (F.unix_micros(time) == F.col("_at"))
    return firings.join(notified, on, "left_semi")


def _silences(width: int, chunk: int) -> Callable[[pa.Table], pa.Table]:
    """For each firing that may be the first to notify in a chunk: when the silence after the chunk's last notification ends."""

    def end(rows: pa.Table) -> pa.Table:
        at = np.sort(rows.column("_at").to_numpy())
        number = rows.column("_chunk")[0].as_py()
        following = np.searchsorted(at, at + width)
        last = np.where(following < len(at), following, np.arange(len(at)))
        while True:  # pointers double their reach until all stand on a last notification
            further = last[last]
            if np.array_equal(further, last):
                break
            last = further
        # The silence before the chunk ends within a period of its start, so no later firing can come first, but one.
        n = min(int(np.searchsorted(at, number * chunk + width)) + 1, len(at))
        return pa.table({"_alert": rows.column("_alert").slice(0, 1), "_chunk": rows.column("_chunk").slice(0, 1),
                         "_entries": pa.array([at[:n]], pa.list_(pa.int64())), "_ends": pa.array([at[last[:n]] + width], pa.list_(pa.int64()))})

    return end


def _entries(chunks: pa.Table) -> pa.Table:
    """The first notification of each chunk of one alert, in the order of the chunks."""
    chunks = chunks.sort_by("_chunk")
    found, silent_until = [], None
    for number, entries, ends in zip(*(chunks.column(c) for c in ("_chunk", "_entries", "_ends"))):
        entries = entries.values.to_numpy()
        i = 0 if silent_until is None else int(np.searchsorted(entries, silent_until))
        if i < len(entries):
            found.append((number.as_py(), int(entries[i])))
            silent_until = ends.values[i].as_py()
    return pa.table({"_alert": pa.array([chunks.column("_alert")[0].as_py()] * len(found), pa.string()),
                     "_chunk": pa.array([c for c, _ in found], pa.int64()), "_entry": pa.array([e for _, e in found], pa.int64())})


def _notifications(width: int) -> Callable[[pa.Table], pa.Table]:
    def speak(rows: pa.Table) -> pa.Table:
        at = np.sort(rows.column("_at").to_numpy())
        kept, i = [], 0
        while i < len(at):
            kept.append(int(at[i]))
            i = int(np.searchsorted(at, at[i] + width))
        return pa.table({"_alert": pa.array([rows.column("_alert")[0].as_py()] * len(kept), pa.string()), "_at": pa.array(kept, pa.int64())})

    return speak


def notify(firings: DataFrame, channels) -> DataFrame:
    """One notification row per firing and channel."""
    names = F.array(*[F.lit(c) for c in channels]) if channels else F.array().cast("array<string>")
    return firings.select("*", F.lit(NOTIFICATION_EVENT_TYPE).cast("bigint").alias("event_type_id"), F.explode(names).alias("channel"))


def raise_alert(df: DataFrame, alert: Alert, start=None, end=None) -> DataFrame:
    """Evaluation, suppression and notification in one plan."""
    firings = evaluate_alert(df, alert, start, end)
    if alert.suppression is not None:
        firings = suppress(firings, alert.suppression, window=alert.window)
    return notify(firings, alert.channels)
