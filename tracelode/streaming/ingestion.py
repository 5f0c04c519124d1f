"""Continuous ingestion of newline-delimited JSON files with validation and quarantine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import BATCH_COLUMN, DATE_COLUMN
from ..operators.ingest import sanitise_trace_ids
from ..sources.clef import EVENT_LIMIT_BYTES, parse_clef, rejection_reason


def line_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None, bytes_per_trigger: str | None = None) -> DataFrame:
    """Lines of the files that arrive in a folder, with the file they came from."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    raw = reader.load(path)
    return raw.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("source"))


def ingest_lines(lines: DataFrame, out_path: str, checkpoint: str, quarantine: str | None = None,
                 enrich: Callable[[DataFrame], DataFrame] | None = None, limit: int = EVENT_LIMIT_BYTES,
                 available_now: bool = False) -> StreamingQuery:
    """Validates, parses, enriches and appends lines; rejected ones go to a quarantine table.

    Delivery is at least once: a batch that was cut short is repeated from the checkpoint. Within each date
    a batch owns a partition that it overwrites, so a repeat replaces its first attempt. Dates come first,
    as in tables of ``write_events``; ``compact_table`` joins the batches of a date.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        numbered = batch.withColumns({"reason": rejection_reason(F.col("line"), limit), "_n": F.monotonically_increasing_id()})
        # The lines are read from source once, however many tables they end up in.
        numbered = numbered.persist()
        try:
            events = parse_clef(numbered.where(F.col("reason").isNull()), arrived="_n")
            events = sanitise_trace_ids(events)
            if enrich is not None:
                events = enrich(events)
            (events.withColumn("id", F.format_string(f"{batch_id:08x}-%s", "id"))
             .withColumns({DATE_COLUMN: F.col("ts").cast("date"), BATCH_COLUMN: F.lit(batch_id).cast("bigint")})
             .hint("rebalance", DATE_COLUMN).write.partitionBy(DATE_COLUMN, BATCH_COLUMN)
             .option("partitionOverwriteMode", "dynamic").option("parquet.bloom.filter.enabled#trace_id", "true").mode("overwrite").parquet(out_path))
            if quarantine is not None:
                (numbered.where(F.col("reason").isNotNull()).select("reason", "source", "line", F.current_timestamp().alias("at"))
                 .write.mode("overwrite").parquet(f"{quarantine}/{BATCH_COLUMN}={batch_id}"))
        finally:
            numbered.unpersist()

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ingest_stream(spark: SparkSession, in_path: str, out_path: str, checkpoint: str, quarantine: str | None = None,
                  enrich: Callable[[DataFrame], DataFrame] | None = None, files_per_trigger: int | None = None,
                  bytes_per_trigger: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Continuous ingestion of a folder."""
    lines = line_stream(spark, in_path, files_per_trigger, bytes_per_trigger)
    return ingest_lines(lines, out_path, checkpoint, quarantine, enrich, available_now=available_now)
