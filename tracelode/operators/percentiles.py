"""Exact nearest-rank percentiles of plain or pre-counted values.

A built-in exact percentile keeps all values of a group in one task. Here values are first
counted per distinct value, then per magnitude band. The band that holds the wanted rank is cut
again, evenly between its own least and greatest value, and only the part that holds the rank is
sorted. So a group with a third of all rows is still spread over the cluster, also if its values
lie close together, like times of one day.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import magnitude_band


#: Even parts of a magnitude band.
PARTS = 1 << 16


def _same(left: str, right: str, names) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names])


def nearest_rank(df: DataFrame, keys: list[str], value: Column, percentiles: dict[str, float],
                 weight: Column | None = None) -> DataFrame:
    """One row per group: for each name, the smallest value whose cumulative share reaches its percentage.

    ``weight`` holds the number of times each value counts (histogram buckets). Groups without
    any value get no row.
    """
    groups = list(keys) or ["_all"]
    source = df if keys else df.withColumn("_all", F.lit(0))
    counted = (source
               .select(*groups, value.cast("double").alias("_v"),
                       (F.lit(1) if weight is None else weight).cast("bigint").alias("_n"))
               .where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.col("_n") > 0))
               .groupBy(*groups, "_v").agg(F.sum("_n").alias("_n"))
               .withColumn("_band", magnitude_band(F.col("_v"))))

    # Tens of thousands of bands per group at most in practice, whatever the number of values.
    bands = counted.groupBy(*groups, "_band").agg(F.sum("_n").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    total = F.sum("_n").over(Window.partitionBy(*groups))
    wanted = F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"),
                 F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("_total") / 100)).cast("bigint").alias("rank"))
        for name, p in percentiles.items()
    ]))
    ranked = _running(bands, groups, "_band").withColumn("_total", total).withColumn("_w", wanted).withColumns(
        {"_name": F.col("_w.name"), "_rank": F.col("_w.rank")})
    targets = _holding(ranked).select(*groups, "_band", "_name", "_rank", "_low", "_high")

    part = F.when(F.col("_high") > F.col("_low"), F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * PARTS)).otherwise(F.lit(0))
    inside = (counted.alias("c").join(targets.alias("t"), _same("c", "t", [*groups, "_band"]))
              .select(*[F.col(f"t.{g}").alias(g) for g in groups], "_name", "_rank", "_v", "c._n", part.cast("bigint").alias("_part")))
    named = [*groups, "_name"]
    parts = inside.groupBy(*named, "_part").agg(F.sum("_n").alias("_n"), F.first("_rank").alias("_rank"))
    targets = _holding(_running(parts, named, "_part")).select(*named, "_part", "_rank")
    last = (inside.drop("_rank").alias("c").join(targets.alias("t"), _same("c", "t", [*named, "_part"]))
            .select(*[F.col(f"t.{g}").alias(g) for g in named], "_rank", "_v", "c._n"))
    found = _running(last, named, "_v").where(F.col("_upto") >= F.col("_rank"))
    result = found.groupBy(*groups).agg(*[
        F.min(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in percentiles
    ])
    return result if keys else result.drop("_all")


def _running(rows: DataFrame, groups: list[str], order: str) -> DataFrame:
    """Adds ``_upto``, the counts of a group up to this row."""
    window = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_upto", F.sum("_n").over(window))


def _holding(rows: DataFrame) -> DataFrame:
    """Rows that hold their wanted rank, which is then counted from the first one inside."""
    before = F.col("_upto") - F.col("_n")
    return rows.where((F.col("_rank") > before) & (F.col("_rank") <= F.col("_upto"))).withColumn("_rank", F.col("_rank") - before)
