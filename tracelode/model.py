"""The two logical tables: ``stream`` (log events and spans) and ``series`` (metric samples)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

STREAM_SCHEMA = """
    id STRING, ts TIMESTAMP, start TIMESTAMP, elapsed_us BIGINT,
    level STRING, severity INT, message STRING, message_template STRING,
    event_type_id BIGINT, exception STRING,
    trace_id STRING, span_id STRING, parent_id STRING, span_kind STRING,
    properties VARIANT, resource VARIANT, scope VARIANT, arrived BIGINT
"""

DEFINITIONS_TYPE = "MAP<STRING, STRUCT<kind: STRING, unit: STRING, description: STRING>>"

SERIES_SCHEMA = f"""
    id STRING, ts TIMESTAMP, definitions {DEFINITIONS_TYPE},
    properties VARIANT, resource VARIANT, scope VARIANT
"""

EXP_HISTOGRAM_TYPE = (
    "STRUCT<buckets: ARRAY<STRUCT<midpoint: DOUBLE, count: BIGINT>>, "
    "scale: INT, min: DOUBLE, max: DOUBLE, count: BIGINT>"
)
FIXED_BUCKETS_TYPE = "ARRAY<STRUCT<`from`: DOUBLE, `to`: DOUBLE, count: BIGINT>>"

# The reserved keys of the newline-delimited event format.
RESERVED_KEYS = (
    "@t", "@st", "@l", "@m", "@mt", "@i", "@x", "@tr", "@sp", "@ps", "@sk", "@ra", "@sa", "@d",
)

# Column that event tables are partitioned by on disk.
BATCH_COLUMN = "batch"
DATE_COLUMN = "event_date"


def conform(df: DataFrame, schema: str = STREAM_SCHEMA, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns named in ``keep``, then those of ``schema`` in order, with typed nulls for missing ones."""
    have = set(df.columns)
    return df.select(*keep, *[
        (F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in StructType.fromDDL(schema).fields if f.name not in keep
    ])
