"""De-duplication without a horizon: no repeat is let through and no event is lost, however late it comes.

A repeat has the id and the date of its event. The newest dates are open: their ids are compared as they are.
Every earlier date is closed and has a Bloom filter, in words of 64 bits that are rows of a table. An event of
a closed date is looked up there; only the dates in which it may be a repeat are read, and only their ids.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import BATCH_COLUMN, DATE_COLUMN
from ..session import folder_exists, folder_names

#: Ids for each word of a filter, and bits set for each of them: about one lookup of fifty finds a word by chance.
IDS_PER_WORD, BITS = 4, 4
#: The date of events without a time.
NO_DATE = dt.date(1, 1, 1)


def word_of(id: Column, words: Column) -> Column:
    """The number of an id's word, below ``words``."""
    return F.pmod(F.xxhash64(id), words)


def mask_of(id: Column) -> Column:
    """The bits of an id in its word."""
    spread, mask = F.xxhash64(id, F.lit(1)), F.lit(0).cast("bigint")
    for k in range(BITS):
        place = F.shiftrightunsigned(spread, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
    return mask


def build_filters(ids: DataFrame, sizes: DataFrame, id: str = "id") -> DataFrame:
    """(date, word, bits) of the filters of some dates; filters of the same date merge by ``bit_or``."""
    return (ids.where(F.col(id).isNotNull()).join(sizes, DATE_COLUMN)
            .groupBy(DATE_COLUMN, word_of(F.col(id), F.col("words")).alias("word")).agg(F.bit_or(mask_of(F.col(id))).alias("bits")))


def sizes_of(ids: DataFrame) -> DataFrame:
    """(date, words): how long the filter of each date is."""
    return ids.groupBy(DATE_COLUMN).agg((F.floor(F.count(F.lit(1)) / IDS_PER_WORD) + 1).cast("bigint").alias("words"))


def possible_repeats(rows: DataFrame, sizes: DataFrame, filters: DataFrame, id: str = "id") -> DataFrame:
    """``rows`` with ``_seen``: false if the filter of its date rules out that the id was met."""
    merged = filters.groupBy(DATE_COLUMN, "word").agg(F.bit_or("bits").alias("_bits"))
    placed = rows.join(sizes.withColumnRenamed("words", "_words"), DATE_COLUMN, "left").withColumn("word", word_of(F.col(id), F.col("_words")))
    found = placed.join(merged, [DATE_COLUMN, "word"], "left")
    seen = F.coalesce(F.col("_bits").bitwiseAND(mask_of(F.col(id))) == mask_of(F.col(id)), F.lit(False))
    return found.select(*[F.col(c) for c in rows.columns], seen.alias("_seen"))


class _Store:
    """The folders of a de-duplicated table: events by date and batch, filters, their sizes and the first open date by batch."""

    def __init__(self, spark: SparkSession, path: str, state: str, id: str):
        self.spark, self.path, self.state, self.id = spark, path.rstrip("/"), state.rstrip("/"), id

    def ids(self, dates: list[dt.date], before: int, kind: str) -> DataFrame:
        """(date, id) of the kept events of some dates. Only the folders of these dates are listed and read."""
        folders = [f for f in (f"{self.path}/{DATE_COLUMN}={d}" for d in sorted(dates)) if folder_exists(self.spark, f)]
        schema = f"`{self.id}` {kind}, {DATE_COLUMN} date, {BATCH_COLUMN} bigint"
        if not folders:
            return self.spark.createDataFrame([], schema).select(DATE_COLUMN, self.id)
        table = self.spark.read.schema(schema).option("basePath", self.path).parquet(*folders)
        return table.where(F.col(BATCH_COLUMN) < before).select(DATE_COLUMN, self.id)

    def table(self, name: str, schema: str, before: int) -> DataFrame:
        folder = f"{self.state}/{name}"
        if not folder_exists(self.spark, folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, {BATCH_COLUMN} bigint").parquet(folder).where(F.col(BATCH_COLUMN) < before).drop(BATCH_COLUMN)

    def put(self, name: str, batch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.state}/{name}/{BATCH_COLUMN}={batch}")


def dedupe_to_table(stream: DataFrame, path: str, state: str, checkpoint: str, open_dates: int = 2, id: str = "id", ts: str = "ts",
                    available_now: bool = False) -> StreamingQuery:
    """Appends the first delivery of every event to a table by date and batch.

    Rows without an id are all kept. Rows without a time are compared among themselves, under :data:`NO_DATE`.
    Of equal ids in one batch an arbitrary row stays. A batch that is repeated after a failure overwrites its own
    folders and sees only what earlier batches left, so it ends as if it had run once. The driver sees the
    dates of a batch, never ids. The table must not be compacted while a batch can still be repeated.
    """
    if open_dates < 1:
        raise ValueError("at least one date is open")
    kind = dict(stream.dtypes)[id]

    def write(batch: DataFrame, n: int) -> None:
        store = _Store(batch.sparkSession, path, state, id)
        dated = batch.withColumn(DATE_COLUMN, F.coalesce(F.col(ts).cast("date"), F.lit(NO_DATE.isoformat()).cast("date"))).persist()
        try:
            _write(store, dated, n, kind, open_dates)
        finally:
            dated.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _on(dates: list[dt.date]) -> Column:
    return F.col(DATE_COLUMN).cast("string").isin([d.isoformat() for d in dates])


SIZES, FILTERS = f"{DATE_COLUMN} date, words bigint", f"{DATE_COLUMN} date, word bigint, bits bigint"


def _write(store: _Store, dated: DataFrame, n: int, kind: str, open_dates: int) -> None:
    id = store.id
    since = store.table("open", "since date", n).agg(F.max("since")).first()[0]
    dates = [r[0] for r in dated.select(DATE_COLUMN).distinct().collect()]
    late = [d for d in dates if since is not None and d < since]
    sizes, filters = store.table("sizes", SIZES, n), store.table("filters", FILTERS, n)

    # Dealt before they are compared: a batch of a few large files is a few tasks, which would sort all of its rows.
    named = dated.where(F.col(id).isNotNull()).repartition(DATE_COLUMN, id).dropDuplicates([DATE_COLUMN, id])
    fresh = named.where(~_on(late)) if late else named
    fresh = fresh.join(store.ids([d for d in dates if d not in late], n, kind), [DATE_COLUMN, id], "left_anti")
    kept = fresh.unionByName(dated.where(F.col(id).isNull()))
    if late:
        asked = possible_repeats(named.where(_on(late)), sizes.where(_on(late)),
                                 filters.where(_on(late)), id).persist()
        try:
            hit = [r[0] for r in asked.where("_seen").select(DATE_COLUMN).distinct().collect()]
            checked = asked.where("_seen").drop("_seen").join(store.ids(hit, n, kind), [DATE_COLUMN, id], "left_anti")
            _append(store, kept.unionByName(asked.where("not _seen").drop("_seen")).unionByName(checked), n)
        finally:
            asked.unpersist()
    else:
        _append(store, kept, n)

    newest = max((d for d in dates if d != NO_DATE), default=None)
    reached = since if newest is None else max(newest - dt.timedelta(days=open_dates - 1), since or NO_DATE)
    if reached is not None and reached != since:
        _close(store, n, kind, since, reached, dates, late, sizes)
    elif late:
        _close(store, n, kind, since, since, dates, late, sizes)
    store.put("open", n, store.spark.createDataFrame([(reached,)], "since date"))


def _append(store: _Store, rows: DataFrame, n: int) -> None:
    (rows.withColumn(BATCH_COLUMN, F.lit(n).cast("bigint")).hint("rebalance", DATE_COLUMN).write.partitionBy(DATE_COLUMN, BATCH_COLUMN)
     .option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(store.path))


def _close(store: _Store, n: int, kind: str, since: dt.date | None, reached: dt.date, dates: list[dt.date], late: list[dt.date], sizes: DataFrame) -> None:
    """Filters of the dates that close with this batch, and of what it added to those closed before."""
    closing = [d for d in _dates_between(store, since, reached) if d not in late]
    ids = store.ids(closing, n + 1, kind)
    if late:
        folders = [f for f in (f"{store.path}/{DATE_COLUMN}={d}/{BATCH_COLUMN}={n}" for d in late) if folder_exists(store.spark, f)]
        if folders:
            added = store.spark.read.schema(f"`{store.id}` {kind}, {DATE_COLUMN} date").option("basePath", store.path).parquet(*folders)
            ids = ids.unionByName(added.select(DATE_COLUMN, store.id))
    known = sizes.where(_on(late)) if late else sizes.limit(0)
    store.put("sizes", n, sizes_of(ids).join(known, DATE_COLUMN, "left_anti"))
    new = store.table("sizes", SIZES, n + 1)
    store.put("filters", n, build_filters(ids, new, store.id))


def _dates_between(store: _Store, since: dt.date | None, reached: dt.date) -> list[dt.date]:
    """Dates of the table from ``since`` up to, without, ``reached``; read off the names of its folders."""
    names = [f.split("=", 1)[1] for f in folder_names(store.spark, store.path) if f.startswith(f"{DATE_COLUMN}=")]
    found = [dt.date.fromisoformat(d) for d in names if d[:1].isdigit()]
    return [d for d in found if d < reached and (since is None or d >= since)]
