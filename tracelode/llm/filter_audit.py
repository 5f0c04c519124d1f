"""How filters interact: what each removes, in any order, from sorted posting lists of failing documents.

1. Every document gets the filters that it fails, and its labels. Texts are read once and never shuffled.
2. The documents of a split, sorted by part and id, are cut into blocks of one part. A block keeps a posting list
   for each filter and label: the ranks, within the block's ids, of the documents that fail it or have it.
3. What a set of filters leaves to one more filter is a difference of lists, found by galloping merges. All
   orders need the sizes of these differences only, and sizes add up over blocks.

A block is bounded, so a part, an id or a group of copies of any size is many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

FILTERS = "ABCDE"
LABELS = ("good", "toxic")
#: Documents of one block.
BLOCK_ROWS = 1 << 16
#: Keys that gallop together: their window in the other list is found by doubling steps, they themselves inside it.
TOGETHER = 256
POSTINGS = "part string, first_id bigint, last_id bigint, n_rows bigint, lists array<binary>"
SUMS = "part string, filter int, before int, n_docs bigint, covered bigint, removed bigint, good_lost bigint, toxic_lost bigint"


def failures(documents: DataFrame) -> DataFrame:
    """(doc_id, part, fails, digest): bit i of ``fails`` is set if the text fails the i-th of the filters A to D."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n_words, distinct = F.size(words), F.size(F.array_distinct(words))
    conditions = (n_words < 200, distinct.cast("bigint") * 100 < n_words.cast("bigint") * 50,
                  F.regexp_count(text, F.lit("[A-Z]")).cast("bigint") * 100 > F.length(text).cast("bigint") * 3, text.rlike("[#$%&*|]"))
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions)]
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                            sum(bits[1:], bits[0]).alias("fails"), F.unhex(F.sha2(text, 256)).alias("digest"))


def marked_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, doc_id, fails, labels) of every row of ``documents``: bits of the failed filters and of the labels.

    The first id of a text is an aggregate, taken apart from the texts; digests that occur with one id only
    aren't joined. Both sides of the joins are tables, so Spark can split the rows of a hot text.
    """
    judged = cut_lineage(failures(documents), "judged")
    first = judged.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id")
    first = cut_lineage(first.select("digest", "first_id"), "first-ids")
    flags = [F.max(F.when(F.col(c) == 1, F.lit(1 << i)).otherwise(F.lit(0))) for i, c in enumerate(("quality", "toxic"))]
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((flags[0] + flags[1]).alias("labels"))
    known = cut_lineage(known.where("labels > 0"), "known")
    again = F.when(F.col("doc_id") > F.col("first_id"), F.lit(1 << 4)).otherwise(F.lit(0))
    return (judged.join(first, "digest", "left").withColumn("fails", F.col("fails") + again).join(known, "doc_id", "left")
            .select("part", "doc_id", F.col("fails").cast("int").alias("fails"), F.coalesce("labels", F.lit(0)).alias("labels")))


def posting_lists(marked: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks (part, first_id, last_id, n_rows, lists) of the rows of ``marked``, of at most ``block_rows`` documents.

    ``lists`` holds a sorted list for each filter and label: ranks, 32 bits each, among the ids of the block. Rows that
    repeat an id have ranks of their own; null ids come first and leave ``first_id`` null.
    """

    def posted(part: str, rows: pa.Table) -> pa.RecordBatch:
        fails, labels = (rows.column(c).to_numpy() for c in ("fails", "labels"))
        lists = [np.flatnonzero(fails >> i & 1) for i in range(len(FILTERS))] + [np.flatnonzero(labels >> i & 1) for i in range(len(LABELS))]
        ids = rows.column("doc_id")
        return pa.RecordBatch.from_arrays(
            [pa.array([part]), pa.array([ids[0].as_py()], pa.int64()), pa.array([ids[-1].as_py()], pa.int64()), pa.array([rows.num_rows]),
             pa.array([[x.astype("<u4").tobytes() for x in lists]], pa.list_(pa.binary()))],
            names=[x.split()[0] for x in POSTINGS.split(", ")])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        part, count = None, 0
        for batch in batches:
            parts = batch.column("part")
            edges = np.flatnonzero(pc.not_equal(parts[1:], parts[:-1]).to_numpy(zero_copy_only=False)) + 1 if batch.num_rows > 1 else []
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                if a == b:
                    continue
                if held and parts[int(a)].as_py() != part:
                    yield posted(part, pa.Table.from_batches(held))
                    held, count = [], 0
                part, at = parts[int(a)].as_py(), int(a)
                while at < b:
                    some = batch.slice(at, min(int(b) - at, block_rows - count))
                    held.append(some)
                    at, count = at + some.num_rows, count + some.num_rows
                    if count == block_rows:
                        yield posted(part, pa.Table.from_batches(held))
                        held, count = [], 0
        if held:
            yield posted(part, pa.Table.from_batches(held))

    return marked.sortWithinPartitions("part", "doc_id").mapInArrow(post, POSTINGS)


def members(keys: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which of the sorted ``keys`` are in the sorted list ``other``.

    A merge that gallops: a run of keys skips whatever of the other list lies before it in steps that double,
    and what lies between two runs is never looked at.
    """
    found, at = np.zeros(len(keys), bool), 0
    for begin in range(0, len(keys), TOGETHER):
        own = keys[begin:begin + TOGETHER]
        at = _gallop(other, own[0], at)
        if at == len(other):
            break
        end = min(_gallop(other, own[-1], at) + 1, len(other))
        places = np.searchsorted(other[at:end], own)
        inside = places < end - at
        found[begin:begin + len(own)][inside] = other[at:end][places[inside]] == own[inside]
    return found


def _gallop(values: np.ndarray, key, at: int) -> int:
    """The first place from ``at`` on whose value is not below ``key``."""
    step, low, high = 1, at, at
    while high < len(values) and values[high] < key:
        low, high, step = high + 1, high + step, step * 2
    return low + int(np.searchsorted(values[low:min(high, len(values))], key))


def union_size(lists: list[np.ndarray]) -> int:
    """Size of the union of sorted lists: each adds what none before it holds."""
    total = 0
    for i, own in enumerate(lists):
        for earlier in lists[:i]:
            own = own[~members(own, earlier)]
        total += len(own)
    return total


def _block_sums(lists: list[np.ndarray], n_filters: int) -> list[tuple[int, ...]]:
    """(filter, before, covered, removed, labelled removed ...) for every filter and every set of other filters before it."""
    out = []
    left = {(f, 0): lists[f] for f in range(n_filters)}
    covered = {s: union_size([lists[f] for f in range(n_filters) if s >> f & 1]) for s in range(1 << n_filters)}
    for before in range(1 << n_filters):
        for f in range(n_filters):
            if before >> f & 1:
                continue
            if before:
                last = before.bit_length() - 1
                rest = left[f, before ^ 1 << last]
                left[f, before] = rest[~members(rest, lists[last])]
            removed = left[f, before]
            out.append((f, before, covered[before], len(removed), *(int(members(label, removed).sum()) for label in lists[n_filters:])))
    return out


def interaction_sums(postings: DataFrame) -> DataFrame:
    """One row for each part, filter and set of filters before it: how many documents the filter removes then, good and
    toxic ones apart, and how many the set covers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, n_rows, lists in zip(*(batch.column(c).to_pylist() for c in ("part", "n_rows", "lists"))):
                rows = _block_sums([np.frombuffer(x, "<u4") for x in lists], len(FILTERS))
                figures = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(rows)), pa.array(figures[0], pa.int32()), pa.array(figures[1], pa.int32()), pa.array([n_rows] * len(rows), pa.int64()),
                     *(pa.array(x, pa.int64()) for x in figures[2:])], names=[x.split()[0] for x in SUMS.split(", ")])

    sums = [F.sum(c).alias(c) for c in ("n_docs", "covered", "removed", "good_lost", "toxic_lost")]
    return postings.mapInArrow(count, SUMS).groupBy("part", "filter", "before").agg(*sums)


def orders(filters: str = FILTERS) -> list[tuple[str, int, int, int]]:
    """(filter_order, step, filter, before) of every step of every order of the filters."""
    places = {name: i for i, name in enumerate(filters)}
    return [("".join(order), step + 1, places[name], sum(1 << places[x] for x in order[:step]))
            for order in permutations(filters) for step, name in enumerate(order)]


def interaction_report(documents: DataFrame, labels: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every step of every order.

    A document is a row: repeated rows and ids count one by one. A null text is empty, a null lang the part ''. A null doc_id
    has no smaller id and is none, and has no label. Of several labels of an id any counts. An empty table has no
    part and so no row. The orders (600 rows) are the only table that is made on the driver.
    """
    sums = interaction_sums(posting_lists(marked_documents(documents, labels), block_rows))
    n = len(FILTERS)
    weight = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), F.bit_count("before") + 1)
    own = Window.partitionBy("part", "filter")

    def when_before(condition: Column) -> Column:
        return F.max(F.when(condition, F.col("removed"))).over(own)

    sums = sums.withColumns({"unique_fails": when_before(F.bit_count("before") == n - 1), "fails": when_before(F.col("before") == 0),
                             "shapley": F.sum(F.col("removed") * weight).over(own)})
    steps = documents.sparkSession.createDataFrame(orders(), "filter_order string, step int, filter int, before int")
    return sums.join(F.broadcast(steps), ["filter", "before"]).select(
        "part", "filter_order", "step", (F.col("n_docs") - F.col("covered") - F.col("removed")).alias("kept"), "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


REPORT_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM texts),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
marked AS (SELECT part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > first_id, false)::INT AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM split LEFT JOIN known USING (doc_id)),
kinds AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM marked GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, s::INT AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS before FROM orders, range(1, 6) r(s)),
figures AS (SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (WHERE fails & (before | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE fails & bit <> 0 AND fails & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE fails & bit <> 0 AND fails & before <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE fails = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE fails & bit <> 0 AND fails & before = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE fails & bit <> 0 AND fails & before = 0), 0)::BIGINT AS toxic_lost
  FROM kinds, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM figures
"""
