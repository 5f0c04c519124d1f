"""Writing events and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import as_object
from ..model import DATE_COLUMN


def write_events(df: DataFrame, path: str, mode: str = "append") -> None:
    """Appends to an event table partitioned by date.

    Rows are clustered by date first, in as many tasks as a date needs, so that a write does not
    leave one small file per task and date. A bloom filter on the trace id serves trace lookups.
    """
    dated = df.withColumn(DATE_COLUMN, F.col("ts").cast("date"))
    (dated.hint("rebalance", DATE_COLUMN).write.partitionBy(DATE_COLUMN).mode(mode)
     .option("parquet.bloom.filter.enabled#trace_id", "true").parquet(path))


def read_events(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def clef_line(df: DataFrame) -> Column:
    """Each event as one JSON object: short keys, no undefined members, no ``Information`` level.

    Metric samples carry ``@t``, ``@d`` and their values only.
    """
    have = set(df.columns)

    def text(name):
        return F.col(name).cast("string") if name in have else F.lit(None).cast("string")

    def instant(name):
        return F.date_format(F.col(name), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0Z'") if name in have else F.lit(None).cast("string")

    definitions = F.parse_json(F.to_json("definitions")) if "definitions" in have else F.lit(None).cast("variant")
    sample = definitions.isNotNull()
    level = F.when(text("level") != "Information", text("level"))
    template = F.coalesce(text("message_template"), text("message"))
    built_in = [("@t", instant("ts"), True), ("@mt", template, False), ("@l", level, False), ("@x", text("exception"), False),
                ("@sp", text("span_id"), False), ("@tr", text("trace_id"), False), ("@ps", text("parent_id"), False),
                ("@st", instant("start"), False), ("@sk", text("span_kind"), False)]
    entries = [F.struct(F.lit(k).alias("k"), (v if always else F.when(~sample, v)).cast("variant").alias("v"))
               for k, v, always in built_in]
    entries.append(F.struct(F.lit("@d").alias("k"), definitions.alias("v")))
    for key, name in (("@ra", "resource"), ("@sa", "scope")):
        if name in have:
            entries.append(F.struct(F.lit(key).alias("k"), F.col(name).alias("v")))
    known = F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"].isNotNull()))
    if "properties" not in have:
        return F.to_json(F.to_variant_object(known))
    own = F.coalesce(as_object(F.col("properties")), F.from_json(F.lit("{}"), "map<string,variant>"))
    escaped = F.transform_keys(own, lambda k, _: F.when(F.startswith(k, F.lit("@")), F.concat(F.lit("@"), k)).otherwise(k))
    return F.to_json(F.to_variant_object(F.map_concat(known, escaped)))


def write_clef(df: DataFrame, path: str, mode: str = "error") -> None:
    df.select(clef_line(df).alias("value")).write.mode(mode).text(path)


def csv_cells(df: DataFrame) -> DataFrame:
    """Every column as text: ISO dates, ``true``/``false``, ``null``, JSON for nested values."""
    def cell(name, kind):
        column = F.col(f"`{name}`")
        if kind.startswith("timestamp"):
            column = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0Z'")
        elif kind == "variant" or kind.startswith(("struct", "array", "map")):
            column = F.to_json(column)
        return F.coalesce(column.cast("string"), F.lit("null")).alias(name)

    return df.select(*[cell(n, k) for n, k in df.dtypes])


def csv_line(df: DataFrame) -> Column:
    """Quoted cells with doubled inner quotes, joined by commas."""
    cells = csv_cells(df).columns
    return F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(F.col(f"`{c}`"), F.lit('"'), F.lit('""')), F.lit('"')) for c in cells])


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Header line, every cell quoted, inner quotes doubled."""
    csv_cells(df).write.mode(mode).csv(path, header=True, quoteAll=True, escape='"', emptyValue="")


def write_ndjson(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object per row."""
    df.write.mode(mode).json(path)
