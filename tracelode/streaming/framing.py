"""Joining the lines of multi-line records on a stream.

Each batch is framed with the distributed batch operator, so a source that sends a third of all
lines is not tied to one task. Only the record that may still grow, the last one of each source,
is carried over: one row per source, kept in a table next to the checkpoint.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.times import duration_us
from ..operators.framing import frame_lines, frame_parts
from ..session import delete_folder

HELD_SCHEMA = "source STRING, line_no BIGINT, line STRING, held_at TIMESTAMP"
HELD_PART_SCHEMA = "source STRING, line_no BIGINT, line STRING, part INT, held_at TIMESTAMP"


def _held_path(state: str, batch_id: int) -> str:
    return f"{state}/batch={batch_id}"


def frame_stream(lines: DataFrame, start_regex: str, out_path: str, state: str, checkpoint: str, source: str = "source",
                 order: str = "line_no", line: str = "line", deadline: str = "1 minute", available_now: bool = False) -> StreamingQuery:
    """Records of a line stream. ``order`` must grow within a source over all batches.

    An open record is released by the batch after its deadline has passed; lines that arrive later
    still are orphans. Repeated batches overwrite their own output and state.
    """
    patience = dt.timedelta(microseconds=duration_us(deadline))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = dt.datetime.now(dt.timezone.utc)
        fresh = batch.select(F.col(source).alias("source"), F.col(order).cast("bigint").alias("line_no"), F.col(line).alias("line"))
        done = None
        if batch_id > 0:
            held = spark.read.schema(HELD_SCHEMA).parquet(_held_path(state, batch_id - 1))
            waiting = F.col("held_at") > F.lit(now - patience)
            fresh = fresh.unionByName(held.where(waiting).select("source", "line_no", "line"))
            done = held.where(~waiting).select("source", F.col("line_no").alias("frame_start"),
                                               F.concat("line", F.lit("\n")).alias("text"), F.lit(False).alias("is_orphan"))
        frames = frame_lines(fresh, start_regex).persist()
        try:
            newest = (frames.where(~F.col("is_orphan")).groupBy("source").agg(F.max("frame_start").alias("frame_start")))
            last = frames.join(newest, ["source", "frame_start"], "left_semi")
            closed = frames.join(newest, ["source", "frame_start"], "left_anti").select("source", "frame_start", "text", "is_orphan")
            open_ = last.select("source", F.col("frame_start").alias("line_no"), F.expr("left(text, length(text) - 1)").alias("line"))
            since = F.lit(now).cast("timestamp")
            if batch_id > 0:  # a record that didn't grow has waited since it was first held
                before = held.select("source", "line_no", F.col("line").alias("_line"), F.col("held_at").alias("_since"))
                open_ = open_.join(before, ["source", "line_no"], "left")
                since = F.when(F.col("_line") == F.col("line"), F.col("_since")).otherwise(since)
            (open_.select("source", "line_no", "line", since.alias("held_at"))
             .write.mode("overwrite").parquet(_held_path(state, batch_id)))
            if done is not None:
                closed = closed.unionByName(done)
            closed.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
            if batch_id > 1:  # a repeated batch needs the state before it, and no older one
                delete_folder(spark, _held_path(state, batch_id - 2))
        finally:
            frames.unpersist()

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def release_frames(spark, state: str, out_path: str, batch_id: int) -> None:
    """Releases the records still open after the last batch of a stream that has ended."""
    held = spark.read.schema(HELD_SCHEMA).parquet(_held_path(state, batch_id))
    (held.select("source", F.col("line_no").alias("frame_start"), F.concat("line", F.lit("\n")).alias("text"), F.lit(False).alias("is_orphan"))
     .write.mode("overwrite").parquet(f"{out_path}/batch={batch_id + 1}"))


def frame_parts_stream(lines: DataFrame, start_regex: str, max_chars: int, out_path: str, state: str, checkpoint: str, source: str = "source",
                       order: str = "line_no", line: str = "line", deadline: str = "1 minute", available_now: bool = False) -> StreamingQuery:
    """Records of a line stream in parts of ``max_chars`` characters, see :func:`tracelode.operators.framing.frame_parts`.

    Full parts of a record that still grows are handed out with the batch that fills them; only its last part is carried over, so
    the state is ``max_chars`` characters per source, also for a record that never ends. Deadlines, late lines and
    repeated batches are as in :func:`frame_stream`.
    """
    patience = dt.timedelta(microseconds=duration_us(deadline))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = dt.datetime.now(dt.timezone.utc)
        fresh = batch.select(F.col(source).alias("source"), F.col(order).cast("bigint").alias("line_no"), F.col(line).alias("line"), F.lit(False).alias("_held"))
        held = (spark.read.schema(HELD_PART_SCHEMA).parquet(_held_path(state, batch_id - 1)) if batch_id > 0
                else spark.createDataFrame([], HELD_PART_SCHEMA))
        waiting = F.col("held_at") > F.lit(now - patience)
        going_on = held.where(waiting)
        fresh = fresh.unionByName(going_on.select("source", "line_no", "line", F.lit(True).alias("_held")))
        parts = frame_parts(fresh, F.col("line").rlike(start_regex) | F.col("_held"), max_chars)
        before = going_on.select(F.col("source").alias("_source"), F.col("line_no").alias("_at"), F.col("line").alias("_line"),
                                 F.col("part").alias("_done"), F.col("held_at").alias("_since"))
        same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("frame_start") == F.col("_at")) & ~F.col("is_orphan")
        parts = parts.join(before, same, "left").withColumn("part", F.col("part") + F.coalesce("_done", F.lit(0)))
        newest = parts.where("not is_orphan").groupBy("source").agg(F.max(F.struct("frame_start", "part")).alias("_last"))
        newest = newest.select(F.col("source").alias("_of"), F.col("_last.frame_start").alias("_open"), F.col("_last.part").alias("_tail"))
        parts = parts.join(newest, F.col("source").eqNullSafe(F.col("_of")), "left").persist()
        try:
            is_tail = F.coalesce(~F.col("is_orphan") & (F.col("frame_start") == F.col("_open")) & (F.col("part") == F.col("_tail")), F.lit(False))
            kept = F.expr("left(text, length(text) - 1)")
            since = F.when((F.col("_line") == kept) & (F.col("part") == F.col("_done")), F.col("_since")).otherwise(F.lit(now))
            (parts.where(is_tail).select("source", F.col("frame_start").alias("line_no"), kept.alias("line"), "part", since.cast("timestamp").alias("held_at"))
             .write.mode("overwrite").parquet(_held_path(state, batch_id)))
            closed = parts.where(~is_tail).select("source", "frame_start", "part", "text", "is_orphan")
            closed.unionByName(_released(held.where(~waiting))).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
            if batch_id > 1:  # a repeated batch needs the state before it, and no older one
                delete_folder(spark, _held_path(state, batch_id - 2))
        finally:
            parts.unpersist()

    writer = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _released(held: DataFrame) -> DataFrame:
    return held.select("source", F.col("line_no").alias("frame_start"), "part", F.concat("line", F.lit("\n")).alias("text"), F.lit(False).alias("is_orphan"))


def release_parts(spark, state: str, out_path: str, batch_id: int) -> None:
    """Releases the last parts of the records still open after the last batch of a stream that has ended."""
    held = spark.read.schema(HELD_PART_SCHEMA).parquet(_held_path(state, batch_id))
    _released(held).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id + 1}")
