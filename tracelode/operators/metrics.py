"""Metric samples: definitions, dimensions, counters, gauges and histograms."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .discovery import PLACES, key_paths, placed_paths, written_path
from .filters import time_range, where_all
from .joins import lateral_unnest
from .percentiles import nearest_rank
from .query import group_by, slice_start, time_slices


def _named(keys) -> dict[str, Column]:
    if not keys:
        return {}
    return keys if isinstance(keys, dict) else {k: F.col(k) for k in ([keys] if isinstance(keys, str) else keys)}


def metric_definitions(series: DataFrame, matching: Column | None = None, groups=None, start=None, end=None,
                       limit: int | None = None, where: Column | None = None) -> DataFrame:
    """Distinct (name, kind, unit, description), once per value of the group keys.

    ``where`` tests samples; ``matching`` tests definitions by ``name``, ``kind``, ``unit`` and ``description``.
    Samples share few definition maps, so equal ones are merged before they are taken apart.
    """
    keys = _named(groups)
    ranged = time_range(series, start, end)
    if where is not None:
        ranged = ranged.where(where)
    maps = ranged.where(F.col("definitions").isNotNull()).select(
        F.map_entries("definitions").alias("_entries"), *[c.alias(f"_key_{k}") for k, c in keys.items()]).distinct()
    rows = maps.select(F.explode("_entries").alias("_e"), *[F.col(f"_key_{k}") for k in keys]).select(
        F.col("_e.key").alias("name"), *[F.col(f"_e.value.{f}").alias(f) for f in ("kind", "unit", "description")],
        *[F.col(f"_key_{k}") for k in keys])
    if matching is not None:
        rows = rows.where(matching)
    found = rows.distinct()
    if limit is not None:
        found = found.orderBy("name", "kind", *[f"_key_{k}" for k in keys]).limit(limit)
    return found.withColumnsRenamed({f"_key_{k}": k for k in keys})


def search_metrics(series: DataFrame, text: str, **options) -> DataFrame:
    """Metrics with a text in their name or description, ignoring case."""
    wanted = F.lit(text.lower())
    hit = F.contains(F.lower("name"), wanted) | F.coalesce(F.contains(F.lower("description"), wanted), F.lit(False))
    return metric_definitions(series, hit, **options)


def metric_dimensions(series: DataFrame, metric: str | None = None, start=None, end=None, limit: int | None = None) -> DataFrame:
    """Accessors present on samples that carry the metric, without the metrics themselves.

    Samples of equal shape are merged first; what is a metric and what is nested is then decided
    once per shape.
    """
    ranged = time_range(series, start, end)
    if metric is not None:
        ranged = ranged.where(F.map_contains_key("definitions", metric))
    have = [p for p in PLACES if p[0] in series.columns]
    shapes = ranged.select(*[F.schema_of_variant(c).alias(c) for c, _, _ in have],
                           F.array_sort(F.map_keys("definitions")).alias("_metrics")).distinct()
    shapes = shapes.withColumns({c: key_paths(F.col(c)) for c, _, _ in have})

    def leaves(column):
        """Paths that do not lead on to longer ones."""
        return F.filter(column, lambda p: ~F.exists(column, lambda q: (F.size(q) > F.size(p)) & (F.slice(q, 1, F.size(p)) == p)))

    staged = shapes.withColumns({c: leaves(F.col(c)) for c, _, _ in have})
    rows = staged.select("_metrics", F.explode(F.concat(*[placed_paths(*p) for p in have])).alias("p")).select("_metrics", "p.*")
    dotted = F.array_join("names", ".")
    is_metric = F.col("optional") & F.exists("_metrics", lambda m: (dotted == m) | F.startswith(dotted, F.concat(m, F.lit("."))))
    found = rows.where(~is_metric).select(written_path().alias("dimension")).distinct()
    return found if limit is None else found.orderBy("dimension").limit(limit)


def dimension_values(series: DataFrame, accessor: Column, start=None, end=None, limit: int | None = None) -> DataFrame:
    """Distinct values of one dimension."""
    found = time_range(series, start, end).select(accessor.alias("value")).where(F.col("value").isNotNull()).distinct()
    return found if limit is None else found.orderBy("value").limit(limit)


def counter_rate(series: DataFrame, metric: Column, every, by=None, start=None, end=None, fill: bool = False) -> DataFrame:
    """Sum of a delta counter per slice, and per second."""
    from ..functions.times import duration_us

    held = series.where(metric.isNotNull())
    return time_slices(held, every, start, end, by, {
        "total": F.sum(metric), "per_second": F.sum(metric) / (duration_us(every) / 1e6)}, fill=fill)


def gauge_stat(series: DataFrame, metric: Column, every, by=None, start=None, end=None, having: Column | None = None) -> DataFrame:
    """Smallest, largest, mean and last value of a gauge per slice and key."""
    held = series.where(metric.isNotNull())
    return time_slices(held, every, start, end, by, {
        "low": F.min(metric), "high": F.max(metric), "mean": F.avg(metric),
        "last": F.max_by(metric, F.struct("ts", "id"))}, having=having)


def bucket_value(bucket: str = "bucket") -> Column:
    """Where a fixed bucket counts: its middle, or the one bound it has."""
    low, high = F.col(f"{bucket}.from"), F.col(f"{bucket}.to")
    return F.coalesce((low + high) / 2, low, high)


def phist(df: DataFrame, value: Column, count: Column, percentiles: dict[str, float], by=None) -> DataFrame:
    """Percentiles of values that were counted beforehand."""
    keys = _named(by)
    staged = df.withColumns({k: c for k, c in keys.items()}) if keys else df
    return nearest_rank(staged, list(keys), value, percentiles, count)


def _hist_percentile(series, buckets, value, percentiles, every, by, start, end):
    keys = _named(by)
    ranged = time_range(series, start, end)
    rows = lateral_unnest(ranged.where(buckets.isNotNull()), buckets, "bucket")
    sliced = {**keys, **({"time": slice_start(F.col("ts"), every, start)} if every is not None else {})}
    return phist(rows, value, F.col("bucket.count"), percentiles, sliced)


def fixed_hist_percentile(series: DataFrame, buckets: Column, percentiles: dict[str, float], every=None, by=None,
                          start=None, end=None) -> DataFrame:
    """Percentiles from histograms with fixed buckets."""
    return _hist_percentile(series, buckets, bucket_value(), percentiles, every, by, start, end)


def exp_hist_percentile(series: DataFrame, buckets: Column, percentiles: dict[str, float], every=None, by=None,
                        start=None, end=None) -> DataFrame:
    """Percentiles from histograms with exponential buckets."""
    return _hist_percentile(series, buckets, F.col("bucket.midpoint"), percentiles, every, by, start, end)


def hist_throughput(series: DataFrame, count: Column, every, by=None, start=None, end=None) -> DataFrame:
    """Observations per slice, from the histograms' own counts."""
    return time_slices(series.where(count.isNotNull()), every, start, end, by, {"throughput": F.sum(count)})


def hist_max(series: DataFrame, low: Column, high: Column, every, by=None, start=None, end=None) -> DataFrame:
    """Extremes per slice, from the histograms' own bounds."""
    return time_slices(series.where(high.isNotNull()), every, start, end, by, {"low": F.min(low), "high": F.max(high)})


INITIAL_SCALE = 20
TARGET_BUCKETS = 160


def _index(value: Column, scale: int) -> Column:
    """Bucket i at scale s holds values in (gamma^(i-1), gamma^i] with gamma = 2^(2^-s)."""
    return F.ceil(F.log2(value) * float(2 ** scale)).cast("bigint")


def _midpoint(index: Column, scale: Column) -> Column:
    width = F.pow(F.lit(2.0), -scale)
    return (F.pow(F.lit(2.0), (index - 1) * width) + F.pow(F.lit(2.0), index * width)) / 2


def build_exp_histogram(df: DataFrame, value: Column, keys=None, every=None, scale: int = INITIAL_SCALE,
                        target_buckets: int = TARGET_BUCKETS, ts: str = "ts", start=None) -> DataFrame:
    """Raw positive values to one exponential histogram per key and slice: keys, ``time``, ``histogram``, ``sum``.

    The scale falls by one until no more than ``target_buckets`` remain. Values are counted per
    bucket, on the map side first; how far each group has to be coarsened is found by counting its
    distinct buckets at every scale, so the list that is finally collected has a fixed bound.
    """
    groups = {**_named(keys), **({"time": slice_start(F.col(ts), every, start)} if every is not None else {})}
    groups = groups or {"_all": F.lit(0)}
    names = list(groups)
    counted = (df.select(*[c.alias(n) for n, c in groups.items()], value.cast("double").alias("_v"))
               .where(F.col("_v") > 0)
               .groupBy(*names, _index(F.col("_v"), scale).alias("_i"))
               .agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.sum("_v").alias("_sum")))
    return _collected(_coarsened(counted, names, scale, target_buckets), names)


def _collected(rebucketed: DataFrame, names: list[str]) -> DataFrame:
    """One histogram for the buckets of each group, which all have its scale."""
    midpoint = _midpoint(F.col("_i"), F.col("_scale"))
    result = rebucketed.groupBy(*names, "_scale").agg(
        F.array_sort(F.collect_list(F.struct(midpoint.alias("midpoint"), F.col("_n").alias("count")))).alias("_buckets"),
        F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.sum("_n").alias("_n"), F.sum("_sum").alias("sum"))
    shaped = result.select(*names, F.struct(
        F.col("_buckets").alias("buckets"), F.col("_scale").cast("int").alias("scale"), F.col("_low").alias("min"),
        F.col("_high").alias("max"), F.col("_n").alias("count")).alias("histogram"), "sum")
    return shaped.drop("_all")


def _coarser(index: Column, steps) -> Column:
    """The bucket that holds bucket ``index`` when the scale is ``steps`` lower."""
    return F.ceil(index / F.pow(F.lit(2.0), steps)).cast("bigint")


def _coarsened(counted: DataFrame, names: list[str], scale: int | Column, target: int) -> DataFrame:
    """Counted buckets at the highest scale that keeps each group within ``target`` buckets."""
    # At scale -11 one bucket spans the whole range of a double on either side of 1. A group needs fewer
    # tries: a step at most halves its buckets, and buckets never outnumber the indices they lie between.
    target, most = max(target, 2), scale + 11
    log2 = lambda x: F.ceil(F.log2(F.greatest(x, F.lit(1.0)))).cast("int")
    bounds = counted.groupBy(*names).agg(F.count(F.lit(1)).alias("_d"), (F.max("_i") - F.min("_i")).alias("_range"))
    enough = log2(F.col("_range") / float(target - 2)) if target > 2 else F.lit(most)
    least = F.least(F.lit(most), log2(F.col("_d") / float(target)))
    bounds = bounds.select(*[F.col(n).alias(f"_r_{n}") for n in names], least.alias("_first"), F.greatest(least, F.least(F.lit(most), enough)).alias("_last"))
    same = [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names]
    sizes = (counted.select(*names, "_i").join(bounds, same)
             .select(*names, "_i", F.explode(F.sequence("_first", "_last")).alias("_k"))
             .select(*names, "_k", _coarser(F.col("_i"), F.col("_k")).alias("_j")).distinct()
             .groupBy(*names, "_k").agg(F.count(F.lit(1)).alias("_size")))
    chosen = sizes.where(F.col("_size") <= target).groupBy(*names).agg(F.min("_k").alias("_k"))
    renamed = chosen.withColumnsRenamed({n: f"_r_{n}" for n in names})
    on = [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names]
    return (counted.join(renamed, on)
            .groupBy(*names, (F.lit(scale) - F.col("_k")).alias("_scale"), _coarser(F.col("_i"), F.col("_k")).alias("_i"))
            .agg(F.sum("_n").alias("_n"), F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.sum("_sum").alias("_sum")))


def downscale_exp_histogram(df: DataFrame, histogram: str = "histogram", target_buckets: int = TARGET_BUCKETS) -> DataFrame:
    """Lowers the scale of each histogram until it has no more than ``target_buckets`` buckets.

    Works inside each row: a histogram is one bounded value, so no shuffle is needed.
    """
    buckets, scale = F.col(f"{histogram}.buckets"), F.col(f"{histogram}.scale")
    # A midpoint lies strictly inside its bucket, so its own index is that of the bucket.
    index = lambda b: F.ceil(F.log2(b["midpoint"]) * F.pow(F.lit(2.0), scale))

    def size_at(k):
        return F.size(F.array_distinct(F.transform(buckets, lambda b: F.ceil(index(b) / F.pow(F.lit(2.0), k)))))

    options = F.filter(F.sequence(F.lit(0), F.greatest(scale + 11, F.lit(0))), lambda k: size_at(k) <= max(target_buckets, 2))
    staged = df.withColumn("_k", F.array_min(options)).withColumn(
        "_entries", F.transform(buckets, lambda b: F.struct(
            F.ceil(index(b) / F.pow(F.lit(2.0), F.col("_k"))).alias("i"), b["count"].alias("n"))))
    merged = F.transform(
        F.array_sort(F.array_distinct(F.transform("_entries", lambda e: e["i"]))),
        lambda i: F.struct(
            _midpoint(i, scale - F.col("_k")).alias("midpoint"),
            F.aggregate(F.filter("_entries", lambda e: e["i"] == i), F.lit(0).cast("bigint"), lambda a, e: a + e["n"]).alias("count")))
    shaped = F.struct(merged.alias("buckets"), (scale - F.col("_k")).cast("int").alias("scale"),
                      F.col(f"{histogram}.min").alias("min"), F.col(f"{histogram}.max").alias("max"),
                      F.col(f"{histogram}.count").alias("count"))
    return staged.withColumn(histogram, shaped).drop("_k", "_entries")


def merge_exp_histograms(df: DataFrame, histogram: str = "histogram", total: Column | None = None, keys=None, every=None,
                         target_buckets: int = TARGET_BUCKETS, ts: str = "ts", start=None) -> DataFrame:
    """Exponential histograms of any scales to one per key and slice: keys, ``time``, ``histogram``, ``sum``.

    The lowest scale of a group wins, and falls further until no more than ``target_buckets`` remain. Buckets of a
    scale lie within those of every lower one, so the result is the histogram of the raw values themselves, whatever
    the order and the grouping of the merges. Counts add up per bucket of their own scale before anything is
    joined; the rows that meet a group's scale are its distinct buckets, not its histograms. ``total`` is the
    sum of a histogram's values. Histograms that are null or have no buckets add nothing; a group of only such has no row.
    """
    groups = {**_named(keys), **({"time": slice_start(F.col(ts), every, start)} if every is not None else {})}
    groups = groups or {"_all": F.lit(0)}
    names = list(groups)
    held = F.col(histogram)
    cells = df.select(*[c.alias(n) for n, c in groups.items()], held["scale"].alias("_s"), held["min"].alias("_low"), held["max"].alias("_high"),
                      (F.lit(None) if total is None else total).cast("double").alias("_sum"), F.posexplode(held["buckets"]).alias("_at", "_b"))
    # A midpoint lies strictly inside its bucket, so its own index is that of the bucket.
    index = F.ceil(F.log2(F.col("_b.midpoint")) * F.pow(F.lit(2.0), F.col("_s"))).cast("bigint")
    sums = {"_n": F.sum("_n"), "_low": F.min("_low"), "_high": F.max("_high"), "_sum": F.sum("_sum")}
    counted = (cells.select(*names, "_s", index.alias("_i"), F.col("_b.count").alias("_n"), "_low", "_high",
                            F.when(F.col("_at") == 0, F.col("_sum")).alias("_sum"))
               .groupBy(*names, "_s", "_i").agg(*[c.alias(n) for n, c in sums.items()]))
    lowest = counted.groupBy(*names).agg(F.min("_s").alias("_base")).withColumnsRenamed({n: f"_g_{n}" for n in names})
    aligned = (counted.join(lowest, [F.col(n).eqNullSafe(F.col(f"_g_{n}")) for n in names])
               .groupBy(*names, "_base", _coarser(F.col("_i"), F.col("_s") - F.col("_base")).alias("_i"))
               .agg(*[c.alias(n) for n, c in sums.items()]))
    return _collected(_coarsened(aligned, [*names, "_base"], F.col("_base"), target_buckets), names)


def sample_metrics(df: DataFrame, every="5 seconds", keys=None, counters: dict[str, Column] | None = None,
                   gauges: dict[str, Column] | None = None, histograms: dict[str, Column] | None = None,
                   ts: str = "ts", id: str = "id") -> DataFrame:
    """Raw events to delta samples per key and interval: counters add up, gauges keep the last value,
    histograms accumulate. ``time`` is the start of the interval."""
    groups = {**_named(keys), "time": slice_start(F.col(ts), every)}
    measures = {n: F.sum(c) for n, c in (counters or {}).items()}
    measures |= {n: F.max_by(F.when(c.isNotNull(), c), F.when(c.isNotNull(), F.struct(ts, id))) for n, c in (gauges or {}).items()}
    result = group_by(df, groups, measures)
    for name, value in (histograms or {}).items():
        built = build_exp_histogram(df, value, groups).select(*groups, F.col("histogram").alias(name))
        renamed = built.withColumnsRenamed({n: f"_r_{n}" for n in groups})
        result = result.join(renamed, [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in groups], "left").drop(
            *[f"_r_{n}" for n in groups])
    return result


@dataclass(frozen=True)
class MetricView:
    """A saved filter over samples and the keys its definitions are listed by."""

    title: str
    filters: tuple[Column, ...] = ()
    group_keys: dict[str, Column] = field(default_factory=dict)


def metric_view(series: DataFrame, view: MetricView, limit: int | None = None) -> DataFrame:
    """The metric definitions that a view shows."""
    return metric_definitions(where_all(series, *view.filters), groups=view.group_keys, limit=limit)
