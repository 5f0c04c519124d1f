"""Joining the lines of multi-line records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import scratch_path

LINES_PER_BLOCK = 65_536
#: Characters of a record that a task holds before it hands them on.
FRAGMENT_CHARS = 1 << 20
FRAGMENT = "_owner bigint, _at bigint, _chars bigint, _n bigint, _orders array<bigint>, _sizes array<bigint>, _text string, _whole boolean"


def frame_lines(df: DataFrame, start: str | Column, source: str = "source", order: str = "line_no",
                line: str = "line", block: str | Column | None = None) -> DataFrame:
    """One row per record: a line matching ``start`` opens it, the lines that follow belong to it.

    Lines before the first start of a source are orphans, each a record of its own.
    Returns ``source``, ``frame_start`` (order of the first line), ``text`` (every line ends in a
    newline), ``n_lines`` and ``is_orphan``.

    A source may be one huge file, so nothing is windowed over a whole source. Lines are windowed
    within blocks of bounded length; the only thing a block needs from the ones before it, the
    order of the last start, comes from a table with one row per block.
    """
    opens = F.col(line).rlike(start) if isinstance(start, str) else start
    if block is None:
        at = F.floor(F.col(order) / LINES_PER_BLOCK)
    else:
        at = F.col(block) if isinstance(block, str) else block
    lines = df.select(F.col(source).alias("source"), at.cast("bigint").alias("_block"),
                      F.col(order).cast("bigint").alias("_order"), F.col(line).alias("_line"),
                      F.when(opens, F.col(order).cast("bigint")).alias("_opened"))

    last_open = lines.groupBy("source", "_block").agg(F.max("_opened").alias("_opened"))
    earlier = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last_open.select("source", "_block",
                               F.last("_opened", ignorenulls=True).over(earlier).alias("_carried"))

    in_block = (Window.partitionBy("source", "_block").orderBy("_order")
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    owned = (lines.withColumn("_opened", F.last("_opened", ignorenulls=True).over(in_block))
             .join(carried.withColumnsRenamed({"source": "_source", "_block": "_at"}),
                   F.col("source").eqNullSafe(F.col("_source")) & F.col("_block").eqNullSafe(F.col("_at")), "left")
             .withColumn("_owner", F.coalesce("_opened", "_carried")))

    # Pieces of a record within a block need no further shuffle; records that cross a block
    # boundary are put together from a few pieces.
    whole = F.array_sort(F.collect_list(F.struct("_order", "_line")))
    pieces = (owned.groupBy("source", "_block", F.coalesce("_owner", "_order").alias("frame_start"),
                            F.col("_owner").isNull().alias("is_orphan"))
              .agg(whole.alias("_lines"), F.count(F.lit(1)).alias("_n")))
    text = F.concat(F.array_join(F.transform("_lines", lambda x: x["_line"]), "\n"), F.lit("\n"))
    pieces = pieces.select("source", "_block", "frame_start", "is_orphan", text.alias("_text"), "_n")
    ordered = F.array_sort(F.collect_list(F.struct("_block", "_text")))
    return (pieces.groupBy("source", "frame_start", "is_orphan")
            .agg(ordered.alias("_pieces"), F.sum("_n").alias("n_lines"))
            .select("source", "frame_start",
                    F.array_join(F.transform("_pieces", lambda x: x["_text"]), "").alias("text"),
                    "n_lines", "is_orphan"))


def frame_parts(df: DataFrame, start: str | Column, max_chars: int = FRAGMENT_CHARS, source: str = "source", order: str = "line_no",
                line: str = "line", block: str | Column | None = None, fragment_chars: int = FRAGMENT_CHARS) -> DataFrame:
    """Records as :func:`frame_lines` joins them, for sources whose records may be of any length: in parts of ``max_chars`` characters.

    Adds ``part``, numbered from 0 within a record; all parts but the last are full, and a line is counted in the part
    where it ends. A null line is an empty one.

    A source may be one huge file, and a record may be all of it. Lines are read and matched once and stream,
    sorted, through tasks that see blocks of bounded length; a task holds a fragment of one record. Records that
    lie inside a block are finished then. What a block needs from those before it, the order of the last
    start and how much of that record there is already, comes from a table with one row per block. Of a record that crosses blocks,
    only the fragments of one part are put together. The lines are written once, as fragments, in the shared folder.
    """
    opens = F.col(line).rlike(start) if isinstance(start, str) else start
    if block is None:
        at = F.floor(F.col(order) / LINES_PER_BLOCK)
    else:
        at = F.col(block) if isinstance(block, str) else block
    lines = df.select(F.col(source).alias("source"), at.cast("bigint").alias("_block"), F.col(order).cast("bigint").alias("_order"),
                      F.coalesce(F.col(line), F.lit("")).alias("_line"), F.coalesce(opens, F.lit(False)).alias("_opens"))
    kind = lines.schema["source"].dataType
    limit = min(max_chars, fragment_chars)
    ordered = lines.repartition("source", "_block").sortWithinPartitions("source", "_block", "_order")
    fragments = ordered.mapInArrow(_fragments(limit), f"source {kind.simpleString()}, _block bigint, {FRAGMENT}")
    path = scratch_path(df.sparkSession, "fragments")
    fragments.write.partitionBy("_whole").parquet(path)
    written = df.sparkSession.read.schema(fragments.schema).parquet(path)

    rest = written.where(~F.col("_whole"))
    own, ahead = rest.where("_owner is not null"), rest.where("_owner is null")
    nothing = F.lit(None).cast("bigint").alias("_carried"), F.lit(0).cast("bigint").alias("_base")
    carried = _carried(rest).withColumnsRenamed({"source": "_source", "_block": "_of"})
    ahead = ahead.join(carried, F.col("source").eqNullSafe(F.col("_source")) & F.col("_block").eqNullSafe(F.col("_of")), "left")
    columns = "source", "_owner", "_at", "_orders", "_sizes", "_text"
    loose = own.select(*columns, *nothing).unionByName(ahead.select(*columns, "_carried", F.coalesce("_base", F.lit(0)).alias("_base")))
    pieces = loose.mapInArrow(_placed(max_chars), f"source {kind.simpleString()}, frame_start bigint, is_orphan boolean, part int, _at bigint, _text string, _n bigint")
    joined = (pieces.groupBy("source", "frame_start", "is_orphan", "part")
              .agg(F.array_sort(F.collect_list(F.struct("_at", "_text"))).alias("_pieces"), F.sum("_n").alias("n_lines"))
              .select("source", "frame_start", F.array_join(F.transform("_pieces", lambda x: x["_text"]), "").alias("text"), "n_lines", "is_orphan", "part"))
    whole = written.where("_whole").select("source", F.col("_owner").alias("frame_start"), F.col("_text").alias("text"), F.col("_n").alias("n_lines"),
                                           F.lit(False).alias("is_orphan"), F.lit(0).alias("part"))
    return whole.unionByName(joined)


def _carried(rest: DataFrame) -> DataFrame:
    """(source, _block, _carried, _base): the record that is open when a block begins, and its characters so far.

    The record that is open at the end of a block is its last; blocks without a start pass on the one before, with all
    their characters.
    """
    last = rest.groupBy("source", "_block", "_owner").agg(F.sum("_chars").alias("_chars"))
    blocks = last.groupBy("source", "_block").agg(F.max(F.struct("_owner", "_chars")).alias("_last"), F.sum(F.when(F.col("_owner").isNull(), F.col("_chars"))).alias("_ahead"))
    upto = Window.partitionBy("source").orderBy("_block")
    earlier = upto.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_passed", F.sum(F.coalesce("_ahead", F.lit(0))).over(upto))
    opened = F.when(F.col("_last._owner").isNotNull(), F.struct(F.col("_last._owner").alias("owner"), (F.col("_last._chars") - F.col("_passed")).alias("chars")))
    blocks = blocks.withColumn("_open", F.last(opened, ignorenulls=True).over(earlier))
    return blocks.select("source", "_block", F.col("_open.owner").alias("_carried"),
                         (F.col("_open.chars") + F.col("_passed") - F.coalesce("_ahead", F.lit(0))).alias("_base"))


class _Run:
    """Lines of one record, or those ahead of the first start, within a block; handed on whenever ``limit`` is reached."""

    def __init__(self, source, block, owner: int | None, limit: int):
        self.source, self.block, self.owner, self.limit = source, block, owner, limit
        self.at = self.chars = self.n = 0
        self.texts: list[str] = []
        self.orders: list[int] = []
        self.sizes: list[int] = []

    def add(self, text: str, n: int, orders: list[int], sizes: list[int]) -> Iterator[tuple]:
        """``sizes`` are those of the lines, with their ends."""
        if self.owner is None:  # lines stay told apart, as they may be records of their own
            at = 0
            for order, size in zip(orders, sizes):
                self.texts.append(text[at:at + size])
                self.orders.append(order)
                self.sizes.append(size)
                at, self.chars, self.n = at + size, self.chars + size, self.n + 1
                if self.chars >= self.limit:
                    yield self.fragment(False)
            return
        at = 0
        while len(text) - at + self.chars > self.limit:
            end = at + self.limit - self.chars
            piece = text[at:end]
            self.texts.append(piece)
            self.chars, at = self.limit, end
            ended = piece.count("\n")
            self.n, n = self.n + ended, n - ended
            yield self.fragment(False)
        self.texts.append(text[at:])
        self.chars, self.n = self.chars + len(text) - at, self.n + n

    def fragment(self, closed: bool) -> tuple:
        own = self.owner is not None
        row = (self.source, self.block, self.owner, self.at, self.chars, self.n, None if own else self.orders, None if own else self.sizes,
               "".join(self.texts), closed and own and self.at == 0)
        self.at, self.chars, self.n, self.texts, self.orders, self.sizes = self.at + self.chars, 0, 0, [], [], []
        return row


def _fragments(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, out, kept, schema = None, [], 0, None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for lines in batches:
            if not lines.num_rows:
                continue
            schema = schema or pa.schema([lines.schema.field("source").with_nullable(True), ("_block", pa.int64()), ("_owner", pa.int64()), ("_at", pa.int64()), ("_chars", pa.int64()),
                                          ("_n", pa.int64()), ("_orders", pa.list_(pa.int64())), ("_sizes", pa.list_(pa.int64())), ("_text", pa.string()), ("_whole", pa.bool_())])
            sources, blocks, orders, text = (lines.column(c) for c in ("source", "_block", "_order", "_line"))
            opens = lines.column("_opens").to_numpy(zero_copy_only=False)
            fresh = np.zeros(lines.num_rows, bool)
            if lines.num_rows > 1:
                for column in (sources, blocks):
                    fresh[1:] |= ~_same(column[1:], column[:-1])
            fresh[0] = run is None or (run.source, run.block) != (sources[0].as_py(), blocks[0].as_py())
            edges = np.flatnonzero(fresh | opens)
            edges = edges if len(edges) and edges[0] == 0 else np.concatenate([[0], edges])
            ends = np.append(edges[1:], lines.num_rows)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(edges, lines.num_rows), pa.int32()), text), "\n").to_pylist()
            sizes = pc.utf8_length(text).to_numpy(zero_copy_only=False) + 1
            numbers = orders.to_numpy(zero_copy_only=False)
            for a, b, own in zip(edges.tolist(), ends.tolist(), joined):
                if fresh[a] or opens[a]:
                    if run is not None and (run.chars or not run.at):
                        out.append(run.fragment(closed=not fresh[a]))
                        kept += len(out[-1][8])
                    run = _Run(sources[a].as_py(), blocks[a].as_py(), int(numbers[a]) if opens[a] else None, limit)
                ahead = run.owner is None
                for row in run.add(own + "\n", b - a, numbers[a:b].tolist() if ahead else [], sizes[a:b].tolist() if ahead else []):
                    out.append(row)
                    kept += len(row[8])
                    if kept > 4 * limit and kept > 1 << 22:
                        yield batch()
                        out, kept = [], 0
                if len(out) >= 10_000 or kept > max(4 * limit, 1 << 22):
                    yield batch()
                    out, kept = [], 0
        if run is not None and (run.chars or not run.at):
            out.append(run.fragment(closed=False))
        if out:
            yield batch()

    return cut


def _same(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Equal values, nulls equal to nulls."""
    both = pc.and_(pc.is_null(left), pc.is_null(right))
    return pc.or_(pc.fill_null(pc.equal(left, right), False), both).to_numpy(zero_copy_only=False)


def _placed(max_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Fragments with the record they belong to, cut at the ends of its parts."""

    def pieces(at: int, text: str) -> Iterator[tuple[int, int, str, int]]:
        done = 0
        while done < len(text):
            part, inside = divmod(at + done, max_chars)
            own = text[done:done + max_chars - inside]
            yield part, at + done, own, own.count("\n")
            done += len(own)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fragments in batches:
            rows: list[tuple] = []
            for i, (owner, at, orders, sizes, text, carried, base) in enumerate(zip(*(fragments.column(c).to_pylist() for c in (
                    "_owner", "_at", "_orders", "_sizes", "_text", "_carried", "_base")))):
                if owner is None and carried is None:
                    done = 0
                    for order, size in zip(orders, sizes):
                        rows += [(i, order, True, *x) for x in pieces(0, text[done:done + size])]
                        done += size
                else:
                    rows += [(i, carried if owner is None else owner, False, *x) for x in pieces(base + at, text)]
            index, *columns = zip(*rows) if rows else [()] * 7
            kinds = pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.string(), pa.int64()
            yield pa.RecordBatch.from_arrays([fragments.column("source").take(pa.array(index, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                                             names=["source", "frame_start", "is_orphan", "part", "_at", "_text", "_n"])

    return place
