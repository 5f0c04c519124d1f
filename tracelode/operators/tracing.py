"""Span durations, traces, trees and service latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import round_to
from ..functions.times import to_iso_string
from ..session import cut_lineage, drop_scratch
from .joins import TRACE_KEYS, one_per_span, span_key
from .query import group_by

#: Column of :func:`span_key` within the rounds of :func:`trace_tree`.
KEY = "_key"


def with_elapsed(df: DataFrame) -> DataFrame:
    """Adds ``elapsed_us``; undefined for log events."""
    return df.withColumn("elapsed_us", F.unix_micros("ts") - F.unix_micros("start"))


def trace_spans(df: DataFrame, trace_id: str, limit: int | None = None, service: Column | None = None) -> DataFrame:
    """Spans of one trace in start order, all of them unless a limit is given."""
    spans = with_elapsed(df.where((F.col("trace_id") == trace_id) & F.col("start").isNotNull()))
    ordered = spans.orderBy("start", "span_id")
    return ((ordered if limit is None else ordered.limit(limit))
            .select("span_id", "parent_id", (F.col("service") if service is None else service).alias("service"),
                    F.col("message").alias("span_name"), F.col("span_kind").alias("kind"), "start",
                    to_iso_string(F.col("start")).alias("start_iso"), (F.col("elapsed_us") / 1000.0).alias("ms")))


def trace_tree(spans: DataFrame, path_column: str = "span_id") -> DataFrame:
    """Depth and path of every span, for all traces at once.

    Pointer doubling: each round every unfinished span jumps over its ancestor's ancestor, so a
    chain of depth d takes log2(d) joins. Only spans that others name as their parent take part in the
    rounds; the others, mostly the bulk, look up their parent's way once when it is known. Each round is written to
    the shared folder, and only spans that still move are written again; the driver sees one count per
    round. Spans below a missing parent start at depth 0 there; spans in a cycle are returned without
    depth. A span that is stored repeatedly is one node.
    """
    columns = tuple(dict.fromkeys(c for c in ("parent_id", path_column) if c not in TRACE_KEYS))
    used = [c for c in dict.fromkeys((*TRACE_KEYS, "ts", "id", *columns)) if c in spans.columns]
    rows = cut_lineage(spans.select(*used), "trace-spans")
    named = rows.where("parent_id is not null").select(
        span_key("trace_id", "parent_id").alias("_k"), F.col("trace_id").alias("_t"), F.col("parent_id").alias("_s")).distinct()
    latest = one_per_span(rows, columns, key=KEY)
    own = [] if path_column in TRACE_KEYS else [F.col(path_column).cast("string").alias("_own")]
    nodes = cut_lineage(latest.join(named, (F.col(KEY) == F.col("_k")) & (F.col("trace_id") == F.col("_t")) & (F.col("span_id") == F.col("_s")), "left")
                        .select("trace_id", "span_id", F.col("parent_id").alias("_up"), F.col("_s").isNotNull().alias("_named"), *own), "trace-nodes")
    nodes = nodes.select(span_key().alias(KEY), "trace_id", "span_id", "_up", F.lit(0).alias("depth"),
                         F.array(F.col("_own" if own else path_column).cast("string")).alias("_path"), "_named")
    drop_scratch(rows)
    roots = F.col("_up").isNull()
    inner, outer = nodes.where("_named").drop("_named"), nodes.where("not _named").drop("_named")
    # Roots stay out of the joins: their missing key would send them all to one task.
    moving, arrived = inner.where(~roots), inner.where(roots)
    pending = moving.count()
    while pending:
        jumped = cut_lineage(_jump(moving, moving.unionByName(arrived)), "trace-tree")
        moving, arrived = jumped.where(~roots), arrived.unionByName(jumped.where(roots))
        left = moving.count()
        if left == pending:
            # Any span with a way to its root would have let some span arrive: only cycles are left.
            break
        pending = left
    ways = moving.unionByName(arrived)
    return ways.unionByName(outer.where(roots)).unionByName(_jump(outer.where(~roots), ways)).select(
        "trace_id", "span_id", F.when(roots, F.col("depth")).alias("depth"),
        F.when(roots, F.array_join("_path", "/")).alias("path"))


def _jump(moving: DataFrame, known: DataFrame) -> DataFrame:
    """Moves each pointer to where its target points; a pointer to a span that is absent ends there."""
    target = known.select(F.col(KEY).alias("_k"), F.col("trace_id").alias("_t"), F.col("span_id").alias("_s"), F.col("_up").alias("_next"),
                          (F.col("depth") + 1).alias("_more"), F.col("_path").alias("_prefix"))
    on = (span_key("trace_id", "_up") == F.col("_k")) & (F.col("trace_id") == F.col("_t")) & (F.col("_up") == F.col("_s"))
    return moving.join(target, on, "left").select(
        KEY, "trace_id", "span_id", F.col("_next").alias("_up"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"),
        F.when(F.col("_t").isNull(), F.col("_path")).otherwise(F.concat("_prefix", "_path")).alias("_path"))


def latency_by_service(spans: DataFrame, by="service", p: float = 95, min_count: int = 0, limit: int | None = None) -> DataFrame:
    """Span count, percentile and maximum in milliseconds per service, slowest first.

    ``min_count`` leaves out services that do not have more spans than that.
    """
    elapsed = F.col("elapsed_us")
    keys = [by] if isinstance(by, str) else by
    rows = group_by(with_elapsed(spans).where(F.col("start").isNotNull()), keys,
                    {"spans": F.count(F.lit(1)), "max_us": F.max(elapsed)}, {"p_us": (elapsed, p)})
    names = list(keys)
    ordered = (rows.where(F.col("spans") > min_count)
            .select(*names, "spans", round_to(F.col("p_us") / 1000, 2).alias("p_ms"), round_to(F.col("max_us") / 1000, 2).alias("max_ms"))
            .orderBy(F.col("p_ms").desc(), *names))
    return ordered if limit is None else ordered.limit(limit)
