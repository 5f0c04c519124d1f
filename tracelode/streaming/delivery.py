"""Delivery of events to a handler, with a ledger of what was handed out and a table of what failed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import VariantType

from ..model import BATCH_COLUMN
from ..operators.filters import apply_signal
from ..operators.signals import Signal
from ..session import folder_exists, folder_names

OUTCOMES = "id string, attempts int, error string, event string"
CHUNK_COLUMN = "chunk"
#: Rounds of :func:`redeliver` are numbered from here down, apart from batches of the stream.
FIRST_ROUND = -1


def plain(events: DataFrame) -> DataFrame:
    """Events as a handler gets them: what is dynamic is JSON text."""
    return events.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, VariantType) else F.col(f.name) for f in events.schema])


def handed_out(events: DataFrame, handler: Callable[[Row], None], id: str = "id", tries: int = 1, before: str | None = None) -> DataFrame:
    """(id, attempts, error, event) of every event after the handler has seen it.

    The handler is called in the tasks that hold the events, up to ``tries`` times for an event it fails on.
    ``error`` is null where it succeeded; where not, ``event`` holds the event as JSON, to be delivered again. A
    column named by ``before`` counts earlier attempts and isn't part of the event.
    """
    names = [c for c in events.columns if c != before]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            texts, earlier = (batch.column(len(names) + k).to_pylist() for k in (0, 1))
            for values, text, past in zip(zip(*(batch.column(k).to_pylist() for k in range(len(names)))), texts, earlier):
                row, error, n = Row(*names)(*values), None, 0
                while n < tries:
                    n += 1
                    try:
                        handler(row)
                        error = None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                key = row[id]
                out.append((None if key is None else str(key), past + n, error, None if error is None else text))
            columns = zip(*out) if out else ((), (), (), ())
            types = (pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "attempts", "error", "event"])

    with_text = plain(events)
    # Null fields are kept, so that an event that is delivered again has all of its columns.
    text = F.to_json(F.struct(*[F.col(n) for n in names]), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    past = F.lit(0) if before is None else F.col(before)
    return with_text.select(*names, text.alias("_text"), past.cast("int").alias("_past")).mapInArrow(run, OUTCOMES)


def deliver(stream: DataFrame, handler: Callable[[Row], None], path: str, checkpoint: str, signal: Signal | Column | None = None,
            tries: int = 1, chunks: int = 1, id: str = "id", available_now: bool = False) -> StreamingQuery:
    """Hands matching events to a handler and writes the outcome of each to a table.

    The table is the ledger: a chunk of a batch whose outcomes stand is never handed out again, whatever the
    stream repeats after a restart. A chunk that was cut off is repeated whole, so a handler may meet those of its
    events again; more ``chunks`` make that fewer. Chunks go by the hash of the id. An event that fails
    holds up nothing; :func:`dead_letters` lists it. Rows without an id are delivered like others.
    """
    def write(batch: DataFrame, n: int) -> None:
        rows = apply_signal(batch, signal)
        if chunks > 1:
            rows = rows.persist()
        try:
            for c in range(chunks):
                folder = f"{path}/{BATCH_COLUMN}={n}/{CHUNK_COLUMN}={c}"
                if not folder_exists(batch.sparkSession, f"{folder}/_SUCCESS"):
                    part = rows if chunks == 1 else rows.where(F.pmod(F.xxhash64(id), F.lit(chunks)) == c)
                    handed_out(part, handler, id, tries).write.mode("overwrite").parquet(folder)
        finally:
            if chunks > 1:
                rows.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """The ledger: one row for each event, or for each time it was delivered again. Unfinished chunks
    and rounds are not in it."""
    folders = [f"{path}/{b}/{c}" for b in folder_names(spark, path) if b.startswith(f"{BATCH_COLUMN}=")
               for c in folder_names(spark, f"{path}/{b}") if folder_exists(spark, f"{path}/{b}/{c}/_SUCCESS")]
    rounds = {f"{BATCH_COLUMN}={r}" for r in _rounds(spark, path)}
    folders = [f for f in folders if f"{BATCH_COLUMN}=-" not in f or f.split("/")[-2] in rounds]
    schema = f"{OUTCOMES}, {BATCH_COLUMN} bigint, {CHUNK_COLUMN} int"
    return spark.read.schema(schema).option("basePath", path).parquet(*folders) if folders else spark.createDataFrame([], schema)


def dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """Events that no delivery succeeded with, as the last one left them: those of the newest round that still fail,
    or of the stream's batches that came after it."""
    rounds = _rounds(spark, path)
    rows = outcomes(spark, path).where(F.col("error").isNotNull())
    if not rounds:
        return rows
    covered = spark.read.schema("through bigint").parquet(f"{path}/round={min(rounds)}").first()[0]
    return rows.where((F.col(BATCH_COLUMN) == min(rounds)) | (F.col(BATCH_COLUMN) > covered))


def redeliver(spark: SparkSession, path: str, handler: Callable[[Row], None], schema: str, id: str = "id", tries: int = 1) -> DataFrame:
    """Hands every dead letter to a handler once more and returns those that still fail.

    ``schema`` is the schema of the events. The outcomes are a round of their own in the ledger; a round that was cut
    off has no effect and is run again. Run it while the stream stands still.
    """
    rounds = _rounds(spark, path)
    now = min(rounds, default=FIRST_ROUND + 1) - 1
    letters, newest = dead_letters(spark, path), outcomes(spark, path).agg(F.max(BATCH_COLUMN)).first()[0]
    if newest is None:
        return letters
    if rounds:  # a round alone may be newest
        newest = max(newest, spark.read.schema("through bigint").parquet(f"{path}/round={min(rounds)}").first()[0])
    names = spark.createDataFrame([], schema).columns
    read = letters.select("attempts", F.from_json("event", schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("e"))
    events = read.select(*[F.col(f"e.`{n}`").alias(n) for n in names], F.col("attempts").alias("_attempts"))
    folder = f"{path}/{BATCH_COLUMN}={now}/{CHUNK_COLUMN}=0"
    handed_out(events, handler, id, tries, "_attempts").write.mode("overwrite").parquet(folder)
    spark.createDataFrame([(newest,)], "through bigint").write.mode("overwrite").parquet(f"{path}/round={now}")
    return dead_letters(spark, path)


def _rounds(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished rounds."""
    return [int(f.split("=")[1]) for f in folder_names(spark, path) if f.startswith("round=") and folder_exists(spark, f"{path}/{f}/_SUCCESS")]
