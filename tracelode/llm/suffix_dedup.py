"""Exact repeats of long byte strings, found by a hash-compared suffix sort.

Every string of ``LENGTH`` bytes holds ``LENGTH - GRAM + 1`` strings of ``GRAM`` bytes. The one with the least
hash is its anchor: equal strings have equal anchors at equal places, so only anchors are compared.

1. Anchors whose gram occurs once are dropped. The others have a context: the bytes around them that a
   string with this anchor can reach. Contexts that are equal repeat in full.
2. Contexts that differ, one of each kind, are sorted by what follows the anchor: a mergesort whose
   comparisons find the common extension by binary search over polynomial prefix hashes. Running minima
   over the order give the common extension to the right of any two, binary search the one to the left.
   two contexts repeat what both cover if that is long enough; extents are verified byte by byte.
3. Extents go back to all anchors of their kind, are united by document, and the text is cut.

A gram with many kinds of context is handled by offset instead: strings of all kinds that start at the
same offset are compared by their hashes, in linear memory; with more than ``LOCAL_KINDS`` kinds that is a
grouped count over the cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .blocks import BASE, POWERS, U64, Block, column, group_bounds, mix, slices, text_array, whole_groups
from .blocks import _BYTE_CODES as CODES

LENGTH, GRAM = 400, 200
#: Kinds of context of one gram that are compared two by two, and that one task may hold.
PAIRED_KINDS, LOCAL_KINDS = 64, 50_000


def _sliding(values: np.ndarray, width: int, combine, fill) -> np.ndarray:
    """``combine`` over ``width`` values from each position on."""
    n = len(values)
    padded = np.full(-(-(n + width) // width) * width, fill, values.dtype)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    head, tail = combine.accumulate(rows, axis=1).ravel(), combine.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return combine(tail[:n], head[width - 1:width - 1 + n])


def _anchors(length: int, gram: int):
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                block = Block.of(text_array(part))
                size = np.diff(block.bounds)
                if not (size >= length).any():
                    continue
                start, end = np.repeat(block.bounds[:-1], size), np.repeat(block.bounds[1:], size)
                at = np.arange(len(block.data))
                prefix, (_, down) = block.prefix_hashes(0), POWERS(len(block.data) + 1)
                hashes = np.full(len(at), ~U64(0))
                inside = np.flatnonzero(at + gram <= end)
                hashes[inside] = mix((prefix[inside + gram] - prefix[inside]) * down[inside]) >> U64(1)
                least = _sliding(hashes, reach + 1, np.minimum, ~U64(0))
                least[at + length > end] = 0
                # An anchor is the least of some whole string that starts up to `reach` before it.
                most = _sliding(least[::-1], reach + 1, np.maximum, U64(0))[::-1]
                x = np.flatnonzero((most == hashes) & (at + gram <= end))
                lo, hi = np.maximum(start[x], x - reach), np.minimum(end[x], x + length)
                context = block.span_hashes(lo, hi, block.prefix_hashes(1)) ^ mix((x - lo).astype(U64) + U64(BASE))
                text = np.searchsorted(block.bounds, x, "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[x].view(np.int64)), pa.array(context.view(np.int64)), pa.array(column(part, "k")[text]), pa.array(column(part, "t")[text]),
                     pa.array(x - block.bounds[text])], names=["gram", "kind", "k", "t", "at"])
    return run


def _contexts(length: int, gram: int):
    reach = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for part in slices(batch, "text"):
                block = Block.of(text_array(part))
                for i, wanted in enumerate(part.column("__wanted").to_pylist()):
                    lo, hi = int(block.bounds[i]), int(block.bounds[i + 1])
                    for r in wanted:
                        x = lo + r["at"]
                        left = min(r["at"], reach)
                        for o, v in zip(out, (r["gram"], r["kind"], left, block.data[x - left:min(hi, x + length)].tobytes())):
                            o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                             names=["gram", "kind", "before", "bytes"])
    return run


class Suffixes:
    """Contexts as rows of bytes with the anchor in one column, and their polynomial prefix hashes."""

    def __init__(self, before: np.ndarray, contexts: list[bytes], length: int, gram: int):
        self.length, self.reach, n = length, length - gram, len(contexts)
        self.left, size = before, np.array([len(c) for c in contexts])
        self.right = size - before
        self.bytes = np.zeros((n, self.reach + length), np.uint8)
        to = np.repeat(np.arange(n) * self.bytes.shape[1] + self.reach - before - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        self.bytes.ravel()[to] = np.frombuffer(b"".join(contexts), np.uint8)
        up, _ = POWERS(self.bytes.shape[1] + 1)
        self.prefix = np.zeros((n, self.bytes.shape[1] + 1), U64)
        np.cumsum(CODES[0][self.bytes] * up[:self.bytes.shape[1]], axis=1, out=self.prefix[:, 1:])

    def common(self, i: np.ndarray, j: np.ndarray, leftward: bool = False) -> np.ndarray:
        """The longest common extension of contexts ``i`` and ``j`` from their anchors, by binary search."""
        side, sign = (self.left, -1) if leftward else (self.right, 1)
        low, high = np.zeros(len(i), np.int64), np.minimum(side[i], side[j])
        at_i, at_j = self.prefix[i, self.reach], self.prefix[j, self.reach]
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            same = self.prefix[i, self.reach + sign * middle] - at_i == self.prefix[j, self.reach + sign * middle] - at_j
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
        return low

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix ``i`` comes before suffix ``j``; equal ones go by number."""
        same = self.common(i, j)
        width = self.bytes.shape[1] - 1
        ended_i, ended_j = same >= self.right[i], same >= self.right[j]
        a, b = self.bytes[i, np.minimum(self.reach + same, width)], self.bytes[j, np.minimum(self.reach + same, width)]
        return np.where(ended_i | ended_j, np.where(ended_i & ended_j, i < j, ended_i), a < b)

    def order(self, group: np.ndarray) -> np.ndarray:
        """Suffixes sorted within their groups (which are runs of rows): a mergesort whose runs never leave
        their group. The place of a suffix is its own in its run plus how many of the other run come before."""
        n = len(group)
        start = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1]) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(start, n))
        of_start, of_end = np.repeat(start, size), np.repeat(start + size, size)
        order, width = np.arange(n), 1
        at = np.arange(n)
        while width < (size.max() if n else 0):
            run = (at - of_start) // width
            other_lo = np.minimum(of_start + (run ^ 1) * width, of_end)
            other_hi = np.minimum(other_lo + width, of_end)
            low, high = other_lo.copy(), other_hi.copy()
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) // 2
                before = self.less(order[middle], order[open_])
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            merged = np.empty(n, np.int64)
            merged[of_start + (run // 2) * 2 * width + (at - of_start) % width + (low - other_lo)] = order
            order, width = merged, 2 * width
        return order

    def verified(self, i: np.ndarray, j: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Pairs whose bytes agree over the whole extent."""
        place = np.arange(self.bytes.shape[1])[None, :]
        outside = (place < (self.reach - left)[:, None]) | (place >= (self.reach + right)[:, None])
        return ((self.bytes[i] == self.bytes[j]) | outside).all(axis=1)

    def repeats(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, lo, hi): bytes from ``lo`` to ``hi``, counted from the anchor, that another context of the group has."""
        order = self.order(group)
        right = self.common(order[:-1], order[1:])
        right[group[order[:-1]] != group[order[1:]]] = 0
        least, out = right.copy(), []
        for distance in range(1, PAIRED_KINDS):
            at = np.flatnonzero(least >= self.length - self.reach)
            if not len(at):
                break
            i, j, r = order[at], order[at + distance], least[at]
            left = self.common(i, j, leftward=True)
            good = left + r >= self.length
            i, j, r, left = i[good], j[good], r[good], left[good]
            sure = self.verified(i, j, left, r) if len(i) else np.zeros(0, bool)
            i, j, r, left = i[sure], j[sure], r[sure], left[sure]
            lo, hi = -np.minimum(left, self.reach), np.minimum(r, self.length)
            out += [(i, lo, hi), (j, lo, hi)]
            least = np.minimum(least[:-1], right[distance:])
        return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(3))

    def string_hashes(self, offset: int, rows: np.ndarray) -> np.ndarray:
        """Hashes of the whole strings that start ``offset`` bytes before the anchors of ``rows``."""
        at = self.reach - offset
        return mix(self.prefix[rows, at + self.length] - self.prefix[rows, at] + U64(offset))

    def whole(self, offset: int, rows: np.ndarray) -> np.ndarray:
        return rows[(self.left[rows] >= offset) & (self.right[rows] >= self.length - offset)]


def _united(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping extents of a row as one."""
    if not len(row):
        return row, lo, hi
    apart = row * (int(hi.max() - lo.min()) + 2)
    order = np.argsort(lo + apart, kind="stable")
    row, start, apart = row[order], (lo + apart)[order], apart[order]
    reach = np.maximum.accumulate(hi[order] + apart)
    first = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return row[first], (start - apart)[first], np.append(reach[first[1:] - 1], reach[-1]) - apart[first]


def _repeated(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["gram"]):
            bounds = group_bounds(table, ["gram"])
            grams, kinds, before = (column(table, c) for c in ("gram", "kind", "before"))
            texts = table.column("bytes")
            size, out, some = np.diff(bounds), [], []
            small = np.flatnonzero(size <= PAIRED_KINDS)
            for n, g in enumerate(small):  # whole groups, a few thousand contexts at a time
                some.append(np.arange(bounds[g], bounds[g + 1]))
                if n + 1 == len(small) or sum(map(len, some[-64:])) > 4000 or len(some) >= 1500:
                    own, some = np.concatenate(some), []
                    row, lo, hi = Suffixes(before[own], texts.take(pa.array(own)).to_pylist(), length, gram).repeats(grams[own])
                    out.append((own[row], lo, hi))
            for g in np.flatnonzero(size > PAIRED_KINDS):
                own = np.arange(bounds[g], bounds[g + 1])
                out += _by_offset(own, before, texts, length, gram)
            row, lo, hi = _united(*(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(3)))
            yield pa.RecordBatch.from_arrays([pa.array(grams[row]), pa.array(kinds[row]), pa.array(lo), pa.array(hi)], names=["gram", "kind", "lo", "hi"])
    return run


def _by_offset(own: np.ndarray, before: np.ndarray, texts, length: int, gram: int) -> Iterator[tuple]:
    """Repeats among many contexts of one gram: equal whole strings at the same offset, for each offset.

    Offsets are done in bands, so that the hashes of a band stay within some megabytes.
    """
    cuts = np.array_split(np.arange(len(own)), -(-len(own) // 4096))
    count = length - gram + 1
    band = min(count, max(1, (8192 * count) // len(own)))
    for first in range(0, count, band):
        some = range(first, min(count, first + band))
        table, valid = np.zeros((len(some), len(own)), U64), np.zeros((len(some), len(own)), bool)
        for cut in cuts:
            s = Suffixes(before[own[cut]], texts.take(pa.array(own[cut])).to_pylist(), length, gram)
            for c, d in enumerate(some):
                rows = s.whole(d, np.arange(len(cut)))
                table[c, cut[rows]] = s.string_hashes(d, rows)
                valid[c, cut[rows]] = True
        found = []
        for c, d in enumerate(some):
            rows = np.flatnonzero(valid[c])
            order = rows[np.argsort(table[c, rows], kind="stable")]
            same = table[c, order[1:]] == table[c, order[:-1]]
            twin = np.zeros(len(own), bool)
            twin[order[1:][same]] = True
            twin[order[:-1][same]] = True
            hit = np.flatnonzero(twin)
            found.append((own[hit], np.full(len(hit), -d), np.full(len(hit), length - d)))
        yield _united(*(np.concatenate([x[k] for x in found]) for k in range(3)))


def _strings(length: int, gram: int):
    """A row for each whole string of a context: for grams with very many kinds of context."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                s = Suffixes(column(part, "before"), part.column("bytes").to_pylist(), length, gram)
                grams, kinds = column(part, "gram"), column(part, "kind")
                for d in range(0, length - gram + 1):
                    rows = s.whole(d, np.arange(part.num_rows))
                    yield pa.RecordBatch.from_arrays([pa.array(grams[rows]), pa.array(kinds[rows]), pa.array(s.string_hashes(d, rows).view(np.int64)),
                                                      pa.array(np.full(len(rows), d))], names=["gram", "kind", "string", "offset"])
    return run


def _spans(lists: list | None, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by any of the extents."""
    if not lists:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    spans = np.array([(r["lo"], r["hi"]) for r in lists], np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    return spans[first, 0], np.append(reach[first[1:] - 1], reach[-1])


def repeated_strings(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, cut_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row (and ``kept``, the bytes that stay, if ``cut_text``).

    Removed is every byte of the UTF-8 text that lies in a string of ``length`` bytes that also starts at
    another place, in this or another row. A null text is empty; texts shorter than ``length`` keep all. Rows
    that repeat a doc_id are rows of their own, and repeat each other's text. Other columns are ignored.
    """
    known = documents.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("k"), F.xxhash64("text").alias("t"), "doc_id",
                             F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    anchors = known.select("k", "t", "text").mapInArrow(_anchors(length, gram), "gram bigint, kind bigint, k bigint, t bigint, at bigint")
    often = (anchors.groupBy("gram").agg(F.count("*").alias("n"), F.min("kind").alias("a"), F.max("kind").alias("b")).where("n > 1")
             .select("gram", (F.col("a") == F.col("b")).alias("alike")))
    often = cut_lineage(often, "often")  # a table, so that the anchors of a hot gram can be split in the join
    members = cut_lineage(anchors.join(often, "gram"), "anchors")
    kinds = members.groupBy("gram", "kind", "alike").agg(F.count("*").alias("n"), F.min(F.struct("k", "t", "at")).alias("place"))
    kinds = cut_lineage(kinds.select("gram", "kind", "alike", "n", "place.*"), "kinds")
    most = kinds.where("not alike").groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > LOCAL_KINDS).select("gram")
    many = most.limit(1).count() > 0
    wanted = kinds.where("not alike").groupBy("k", "t").agg(F.collect_list(F.struct("gram", "kind", "at")).alias("__wanted"))
    contexts = known.join(wanted, ["k", "t"]).mapInArrow(_contexts(length, gram), "gram bigint, kind bigint, before bigint, bytes binary")
    extent = "gram bigint, kind bigint, lo bigint, hi bigint"
    local = contexts.join(most, "gram", "left_anti") if many else contexts
    found = local.repartition("gram").sortWithinPartitions("gram", "kind").mapInArrow(_repeated(length, gram), extent)
    if many:
        strings = contexts.join(most, "gram", "left_semi").mapInArrow(_strings(length, gram), "gram bigint, kind bigint, string bigint, offset bigint")
        strings = cut_lineage(strings, "strings")
        twice = strings.groupBy("string").agg(F.min("kind").alias("a"), F.max("kind").alias("b")).where("a <> b").select("string")
        found = found.union(strings.join(twice, "string").select("gram", "kind", -F.col("offset"), F.lit(length) - F.col("offset")))
    whole = kinds.where("n > 1").select("gram", "kind", F.lit(gram - length).cast("bigint").alias("lo"), F.lit(length).cast("bigint").alias("hi"))
    extents = members.join(found.union(whole), ["gram", "kind"]).select("k", "t", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi"))
    extents = extents.groupBy("k", "t").agg(F.collect_list(F.struct("lo", "hi")).alias("__wanted"))
    id_type = dict(known.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                block, out = Block.of(text_array(part)), []
                for i, lists in enumerate(part.column("__wanted").to_pylist()):
                    own = block.data[block.bounds[i]:block.bounds[i + 1]]
                    lo, hi = _spans(lists, len(own))
                    lo, hi = np.maximum(lo, 0), np.minimum(hi, len(own))
                    left = b"".join(own[a:b].tobytes() for a, b in zip(np.append(0, hi), np.append(lo, len(own))))
                    out.append((len(own), len(own) - len(left), len(lo), hashlib.sha256(left).hexdigest(), left))
                columns = [part.column("doc_id"), *(pa.array([r[c] for r in out], pa.int64()) for c in range(3)), pa.array([r[3] for r in out], pa.string())]
                if cut_text:
                    columns.append(pa.array([r[4] for r in out], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][:len(columns)])

    schema = f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if cut_text else "")
    return known.join(extents, ["k", "t"], "left").mapInArrow(cut, schema)
