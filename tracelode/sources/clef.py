"""Newline-delimited JSON events: reading, validation and the log of rejected lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.levels import severity_of
from ..functions.values import template_id
from ..model import DEFINITIONS_TYPE, RESERVED_KEYS
from ..operators.ingest import render_template
from .lines import read_lines, strip_bom

EVENT_LIMIT_BYTES = 256 * 1024

# Why a line is rejected.
TOO_LARGE = "longer than an event may be"
BAD_JSON = "not JSON"
NOT_OBJECT = "JSON, but not an object"
NO_TIMESTAMP = "no time"
BAD_TIMESTAMP = "a time that cannot be read"


def _reserved(event: Column, key: str, kind: str = "string") -> Column:
    return F.try_variant_get(event, f'$["{key}"]', kind)


def _is_object(line: Column) -> Column:
    """For text that is known to be JSON, its first character tells."""
    return line.rlike(r"\A[ \t\r\n]*\{")


def rejection_reason(line: Column, limit: int = EVENT_LIMIT_BYTES, require_time: bool = True) -> Column:
    """``NULL`` for a valid line, else the reason."""
    event = F.try_parse_json(line)
    reason = (F.when(F.octet_length(line) > limit, TOO_LARGE)
              .when(event.isNull(), BAD_JSON)
              .when(~_is_object(line), NOT_OBJECT))
    if require_time:
        stamp = _reserved(event, "@t")
        reason = (reason.when(_reserved(event, "@t", "variant").isNull(), NO_TIMESTAMP)
                  .when(stamp.try_cast("timestamp").isNull(), BAD_TIMESTAMP))
    return reason


def validate_clef(df: DataFrame, line: str = "line", limit: int = EVENT_LIMIT_BYTES) -> DataFrame:
    """Adds ``reason``: rows without one are valid, the others are rejected."""
    return df.withColumn("reason", rejection_reason(F.col(line), limit))


def split_valid(df: DataFrame, line: str = "line", limit: int = EVENT_LIMIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Valid and rejected lines."""
    checked = validate_clef(df, line, limit)
    return checked.where(F.col("reason").isNull()).drop("reason"), checked.where(F.col("reason").isNotNull())


def rejection_log(rejected: DataFrame, source: str = "source", line: str = "line", at: str | None = None,
                  chars: int | None = None) -> DataFrame:
    """Rejected lines by reason and source, the most recent group first, with one payload (its first ``chars`` characters, if given)."""
    when = F.col(at) if at else F.monotonically_increasing_id()
    staged = rejected.select("reason", F.col(source).alias("source"), (F.col(line) if chars is None else F.left(F.col(line), F.lit(chars))).alias("start"),
                             when.alias("_at"))
    counted = staged.groupBy("reason", "source").agg(
        F.count(F.lit(1)).alias("n"), F.max("_at").alias("latest"),
        F.max_by("start", F.struct("_at", "start")).alias("document_start"))
    return counted.orderBy(F.col("latest").desc(), "reason", "source")


def parse_clef(df: DataFrame, line: str = "line", arrived: str | None = None, reference_time=None,
               id_key: str | None = None, origin: Column | None = None) -> DataFrame:
    """JSON lines to events. Reserved keys become columns, all others stay in ``properties``.

    Ids come from ``id_key`` when events carry one, else from the order of arrival within ``origin``.
    Lines must hold JSON objects; see :func:`read_clef` for what happens to others.
    """
    now = F.current_timestamp() if reference_time is None else F.lit(reference_time).cast("timestamp")
    event, own = F.col("_event"), F.col("_own")
    hidden = [*RESERVED_KEYS, *([id_key] if id_key else [])]
    # Parsed once per line, and its properties taken out once, whatever is read from them below.
    parsed = df.withColumn("_event", F.try_parse_json(strip_bom(F.col(line)))).withColumn(
        "_own", F.map_filter(event.try_cast("map<string,variant>"), lambda k, _: ~k.isin(*hidden))).withColumn(
        "_own", F.when(F.exists(F.map_keys(own), lambda k: F.startswith(k, F.lit("@@"))), F.transform_keys(
            own, lambda k, _: F.when(F.startswith(k, F.lit("@@")), F.substring(k, 2, 2_147_483_647)).otherwise(k))).otherwise(own))
    template, text = _reserved(event, "@mt"), _reserved(event, "@m")
    ts = F.coalesce(_reserved(event, "@t").try_cast("timestamp"), now)
    start = _reserved(event, "@st").try_cast("timestamp")
    level = F.coalesce(_reserved(event, "@l"), F.lit("Information"))
    given_type = F.conv(_reserved(event, "@i"), 16, 10).try_cast("bigint")
    known = F.col(arrived) if arrived else F.monotonically_increasing_id()
    arrival_id = F.lower(F.lpad(F.hex(known), 16, "0"))
    if origin is not None:
        arrival_id = F.concat(F.lower(F.lpad(F.hex(F.xxhash64(origin)), 16, "0")), F.lit("-"), arrival_id)
    return parsed.select(
        (_reserved(event, id_key) if id_key else arrival_id).alias("id"),
        ts.alias("ts"), start.alias("start"), (F.unix_micros(ts) - F.unix_micros(start)).alias("elapsed_us"),
        level.alias("level"), severity_of(level).alias("severity"),
        F.coalesce(text, render_template(template, own), F.lit("")).alias("message"),
        F.coalesce(template, text).alias("message_template"),
        F.coalesce(given_type, template_id(F.coalesce(template, text, F.lit("")))).alias("event_type_id"),
        _reserved(event, "@x").alias("exception"), _reserved(event, "@tr").alias("trace_id"),
        _reserved(event, "@sp").alias("span_id"), _reserved(event, "@ps").alias("parent_id"),
        _reserved(event, "@sk").alias("span_kind"), F.to_variant_object(own).alias("properties"),
        _reserved(event, "@ra", "variant").alias("resource"), _reserved(event, "@sa", "variant").alias("scope"),
        known.cast("bigint").alias("arrived"),
        F.try_variant_get(event, '$["@d"]', DEFINITIONS_TYPE).alias("definitions"))


def read_clef(spark: SparkSession, paths, invalid: str = "fail", reference_time=None, id_key: str | None = None) -> DataFrame:
    """Events of newline-delimited JSON files. A line that is not an object stops the job or is skipped.

    Needs no shuffle. ``arrived`` keeps the order of the lines within a file split.
    """
    if invalid not in ("fail", "ignore"):
        raise ValueError("invalid must be 'fail' or 'ignore'")
    lines = read_lines(spark, paths).where(~F.col("line").rlike(r"\A\s*\z"))
    event = F.try_parse_json(F.col("line"))
    good = event.isNotNull() & _is_object(F.col("line"))
    if invalid == "ignore":
        lines = lines.where(good)
    else:
        message = F.concat(F.lit("The line is not a JSON object: "), F.col("line"))
        lines = lines.withColumn("line", F.when(good, F.col("line")).otherwise(F.raise_error(message)))
    # The split a line comes from makes its id differ from those of other files and earlier runs.
    origin = F.concat_ws("#", "source", "block")
    return parse_clef(lines, arrived="line_no", reference_time=reference_time, id_key=id_key, origin=origin)


def read_series(spark: SparkSession, paths, invalid: str = "fail", reference_time=None) -> DataFrame:
    """Metric samples of newline-delimited JSON files: events that carry definitions."""
    return (read_clef(spark, paths, invalid, reference_time).where(F.col("definitions").isNotNull())
            .select("id", "ts", "definitions", "properties", "resource", "scope"))
