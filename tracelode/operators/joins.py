"""Lateral unnesting and the key joins of the tracing model.

Delivery is at least once, so a span may be stored repeatedly. Every join here first reduces its right-hand
side to the latest row per key; the same keys partition the join, so that costs no shuffle of its own, and
no copy of a parent can multiply its children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TRACE_KEYS = ("trace_id", "span_id")
#: Bytes that :func:`brought_together` aims at in a partition: what is unnested from them fits a task's memory.
PART_BYTES = 8 << 20


def lateral_unnest(df: DataFrame, array: str | Column, alias: str) -> DataFrame:
    """One row per array element next to its source row; rows without elements vanish."""
    return df.withColumn(alias, F.explode(F.col(array) if isinstance(array, str) else array))


def brought_together(df: DataFrame, key: str, unnested: str) -> DataFrame:
    """``df`` dealt by ``key`` to partitions of about :data:`PART_BYTES` of the text column ``unnested``.

    Elements that are unnested from it and grouped by the key and more are counted where they are: the texts are
    shuffled once and the elements, which take several times their size, are not. Rows of one key share a partition.
    """
    size = df.agg(F.sum(F.octet_length(unnested))).first()[0] or 0
    return df.repartition(int(size // PART_BYTES) + 1, key)


def span_key(trace: str | Column = "trace_id", span: str | Column = "span_id") -> Column:
    """A number that leads the ids of a span as a key: ids often begin alike, and sorts compare the first bytes of a key fast."""
    return F.xxhash64(trace, span)


def one_per_span(spans: DataFrame, columns: tuple[str, ...], prefix: str = "", key: str = "_key") -> DataFrame:
    """Its number as ``key``, (trace_id, span_id) and columns of the latest row of each span; ties go to the greatest values."""
    keyed, keys = spans.withColumn(key, span_key()), (key, *TRACE_KEYS)
    latest = [c for c in ("ts", "id") if c in spans.columns]
    if not columns:
        return keyed.select(*keys).distinct()
    order = F.struct(*[F.col(c).alias(f"_at_{c}") for c in latest], *[F.col(c).alias(f"{prefix}{c}") for c in columns])
    return keyed.groupBy(*keys).agg(F.max(order).alias("_held")).select(*keys, *[F.col(f"_held.`{prefix}{c}`") for c in columns])


def span_parents(spans: DataFrame, columns: tuple[str, ...] = ("service", "message", "start")) -> DataFrame:
    """Each span with its parent's columns under ``parent_*``; roots have none."""
    parents = one_per_span(spans, columns, "parent_").withColumnsRenamed({"trace_id": "_trace", "span_id": "_span"})
    on = (span_key(spans["trace_id"], spans["parent_id"]) == F.col("_key")) & (spans["trace_id"] == F.col("_trace")) & (spans["parent_id"] == F.col("_span"))
    return spans.join(parents, on, "left").drop("_key", "_trace", "_span")


def logs_in_spans(logs: DataFrame, spans: DataFrame, columns: tuple[str, ...] = ("service", "message", "start")) -> DataFrame:
    """Log events with the columns of the span they were recorded in under ``span_*``."""
    return logs.withColumn("_key", span_key()).join(one_per_span(spans, columns, "span_"), ["_key", *TRACE_KEYS]).drop("_key")


def orphan_spans(spans: DataFrame) -> DataFrame:
    """Spans that name a parent which is absent."""
    known = spans.select(F.col("trace_id").alias("_trace"), F.col("span_id").alias("_span"))
    named = spans.where(F.col("parent_id").isNotNull())
    on = (F.col("trace_id") == F.col("_trace")) & (F.col("parent_id") == F.col("_span"))
    return named.join(known, on, "left_anti")


def traces_with(df: DataFrame, predicate: Column) -> DataFrame:
    """All events of traces in which some event matches."""
    wanted = df.where(predicate & F.col("trace_id").isNotNull()).select("trace_id").distinct()
    return df.join(wanted, "trace_id", "left_semi")
