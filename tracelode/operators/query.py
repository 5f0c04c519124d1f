"""Projection, grouping, time slicing, ordering and limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.times import duration_us, from_us, ticks_us
from .filters import time_range
from .percentiles import nearest_rank

#: Parts that a ranked group is dealt out to before its first rows meet.
RANK_PARTS = 32


def select_columns(df: DataFrame, *names: str, **computed: Column) -> DataFrame:
    """Named columns (``*`` allowed) followed by computed ones."""
    return df.select(*names, *[c.alias(n) for n, c in computed.items()])


def let(df: DataFrame, **values: Column) -> DataFrame:
    """Bind intermediate values, later ones may use earlier ones."""
    for name, value in values.items():
        df = df.withColumn(name, value)
    return df


def scalar(spark: SparkSession, **values: Column) -> DataFrame:
    """One row computed without a source."""
    return spark.range(1).select(*[c.alias(n) for n, c in values.items()])


def event_as_object(df: DataFrame) -> DataFrame:
    """Adds the whole event as one structured value, and its size as JSON text."""
    return df.withColumn("data", F.struct("*")).withColumn("json_chars", F.length(F.to_json("data")).cast("bigint"))


def latest_as_table(df: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` events as display columns."""
    from ..functions.text import to_hex_string
    from ..functions.times import to_iso_string

    return (df.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(n)
            .select(to_iso_string(F.col("ts")).alias("timestamp"), "level",
                    to_hex_string(F.col("event_type_id")).alias("event_type"), "message", "exception",
                    F.to_json("properties").alias("properties")))


def _named(keys) -> dict[str, Column]:
    if keys is None:
        return {}
    if isinstance(keys, dict):
        return keys
    return {k: F.col(k) for k in ([keys] if isinstance(keys, str) else keys)}


def group_by(df: DataFrame, keys=None, aggs: dict[str, Column] | None = None,
             percentiles: dict[str, tuple] | None = None,
             ci: tuple[str, ...] = (), having: Column | None = None) -> DataFrame:
    """Group on expressions; keys lead the result, a null key is a group.

    Keys named in ``ci`` group without regard to case and show their smallest spelling.
    Percentiles, as ``(value, p)`` or ``(value, p, count)`` for counted buckets, take the
    distributed path of :func:`nearest_rank` and are joined on the keys.
    """
    keys, aggs = _named(keys), dict(aggs or {})
    folded = [k for k in keys if k in ci]
    names = [f"_ci_{k}" if k in folded else k for k in keys]
    staged = df.withColumns({n: F.lower(keys[k]) if k in folded else keys[k] for n, k in zip(names, keys)}
                            | {f"_as_{k}": keys[k] for k in folded}) if keys else df
    spelling = [F.min(f"_as_{k}").alias(k) for k in folded]
    if aggs or folded or not percentiles:
        measures = [c.alias(n) for n, c in aggs.items()] + spelling
        if measures:
            result = staged.groupBy(*names).agg(*measures)
        else:
            result = staged.select(*names).distinct()
    else:
        result = None

    by_value: dict[str, tuple[Column, Column | None, dict[str, float]]] = {}
    for name, (value, p, *count) in (percentiles or {}).items():
        weight = count[0] if count else None
        by_value.setdefault(f"{value} {weight}", (value, weight, {}))[2][name] = p
    for value, weight, wanted in by_value.values():
        ranks = nearest_rank(staged, names, value, wanted, weight)
        result = ranks if result is None else _left_on(result, ranks, names)

    result = result.select(*keys, *aggs, *(percentiles or {}))
    return result if having is None else result.where(having)


def _left_on(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """Left join on keys that may be null."""
    if not names:
        # Both sides are single-row global aggregates.
        return left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
    renamed = right.withColumnsRenamed({n: f"_r_{n}" for n in names})
    on = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names])
    return left.join(renamed, on, "left").drop(*[f"_r_{n}" for n in names])


def slice_start(ts: Column, every, start=None) -> Column:
    """Start of the slice that holds ``ts``; slices are anchored at ``start``."""
    width = duration_us(every)
    anchor = F.lit(0) if start is None else ticks_us(F.lit(start) if not isinstance(start, Column) else start)
    return from_us(anchor + F.floor((ticks_us(ts) - anchor) / width) * width)


def time_slices(df: DataFrame, every, start=None, end=None, by=None, aggs: dict[str, Column] | None = None,
                percentiles: dict[str, tuple] | None = None, ci: tuple[str, ...] = (),
                having: Column | None = None, fill: bool | str = False, ts: str = "ts", carry: tuple[str, ...] = ()) -> DataFrame:
    """Group by time alone or with more keys: keys, then ``time``, then measures.

    ``fill=True`` adds a row with null measures for every empty slice of each key: keys times slices. ``fill="gaps"`` adds
    only those between a key's first and last slice, with the measures in ``carry`` repeated, see :func:`fill_gaps`.
    """
    if fill == "gaps":
        result = fill_gaps(time_slices(df, every, start, end, by, aggs, percentiles, ci, ts=ts), every, by, carry)
        return result if having is None else result.where(having)
    if fill and (start is None or end is None):
        raise ValueError("fill needs a start and an end")
    keys = _named(by)
    ranged = time_range(df, start, end, ts)
    result = group_by(ranged, {**keys, "time": slice_start(F.col(ts), every, start)}, aggs, percentiles, ci)
    if fill:
        grid = F.sequence(
            _instant(start), from_us(ticks_us(_instant(end)) - 1), F.make_dt_interval(secs=F.lit(duration_us(every) / 1e6)))
        if keys:
            frame = result.select(*keys).distinct().withColumn("time", F.explode(grid))
        else:
            frame = df.sparkSession.range(1).select(F.explode(grid).alias("time"))
        result = _left_on(frame, result, [*keys, "time"]).select(*result.columns)
    return result if having is None else result.where(having)


def fill_gaps(slices: DataFrame, every, by=(), carry: tuple[str, ...] = (), time: str = "time") -> DataFrame:
    """Adds the missing slices between a key's first and last one, in proportion to what is missing.

    Each observed slice makes the run up to the next one of its key. Added slices repeat the values of the columns in
    ``carry`` from the slice before them and are null in all others. Slices without a time stay as they are. Only one row per
    observed slice is ordered within a key, and no key is paired with a range; for slices outside a key's own
    range use ``fill`` of :func:`time_slices`.
    """
    keys = list(_named(by))
    width = duration_us(every)
    own = Window.partitionBy(*keys).orderBy(time) if keys else Window.orderBy(time)
    at, following = ticks_us(F.col(time)), F.lead(ticks_us(F.col(time))).over(own)
    staged = slices.withColumn("__at", at).withColumn("__next", F.when(at.isNotNull(), following))
    run = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.ceil((F.col("__next") - F.col("__at")) / width) - 1).cast("bigint"))
    rows = staged.withColumn("__step", F.explode(F.coalesce(run, F.array(F.lit(0).cast("bigint")))))
    kept = {*keys, *carry}
    return rows.select(*[from_us(F.col("__at") + F.col("__step") * width).alias(c) if c == time else F.col(c) if c in kept
                         else F.when(F.col("__step") == 0, F.col(c)).alias(c) for c in slices.columns])


def _instant(value) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("timestamp")


def having(df: DataFrame, predicate: Column) -> DataFrame:
    """Filter groups by their measures."""
    return df.where(predicate)


def distinct_values(df: DataFrame, **values: Column) -> DataFrame:
    return df.select(*[c.alias(n) for n, c in values.items()]).distinct()


def _ranked(df: DataFrame, value: Column, n: int, by, ts: str, id: str, newest: bool) -> DataFrame:
    keys = _named(by) or {"_all": F.lit(0)}
    order = [F.col(c).desc() if newest else F.col(c).asc() for c in (ts, id)]
    staged = df.select(*[c.alias(k) for k, c in keys.items()], value.alias("value"), ts, id)
    if by is None:
        staged = staged.orderBy(*order).limit(n)
    else:
        # Each group is split first, so that no task sorts a whole hot group.
        staged = staged.withColumn("_part", F.pmod(F.xxhash64(id), F.lit(RANK_PARTS)))
        local = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
        staged = staged.withColumn("_local", local).where(F.col("_local") <= n).drop("_part", "_local")
    ranked = staged.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    result = ranked.where(F.col("position") <= n)
    return result.select(*[k for k in keys if k != "_all"], F.col("position").cast("bigint").alias("position"), "value")


def top_n(df: DataFrame, value: Column, n: int, by=None, ts: str = "ts", id: str = "id") -> DataFrame:
    """First ``n`` values in time order, per group."""
    return _ranked(df, value, n, by, ts, id, newest=False)


def bottom_n(df: DataFrame, value: Column, n: int, by=None, ts: str = "ts", id: str = "id") -> DataFrame:
    """Last ``n`` values in time order, per group; position 1 is the newest."""
    return _ranked(df, value, n, by, ts, id, newest=True)


def order_by(df: DataFrame, *keys, desc: bool = False, ci: bool = False) -> DataFrame:
    """Order by aliases or expressions, optionally without regard to case."""
    columns = []
    for key in keys:
        column = F.col(key) if isinstance(key, str) else key
        columns += [F.lower(column), column] if ci else [column]
    return df.orderBy(*[c.desc() if desc else c.asc() for c in columns])


def top_k(df: DataFrame, *keys, n: int, desc: bool = False, ci: bool = False) -> DataFrame:
    """A limited sort: each task keeps its own best ``n`` rows."""
    return order_by(df, *keys, desc=desc, ci=ci).limit(n)


def limit(df: DataFrame, n: int) -> DataFrame:
    """Cap the rows of an ordered result."""
    return df.limit(n)
