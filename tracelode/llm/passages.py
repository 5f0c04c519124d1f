"""Fuzzy passages that documents share: seeds, collinear chains, alignment.

1. Seeds: of every ``WINDOW`` windows of ``SEED_WORDS`` words the one with the least hash, so equal runs
   of ``SEED_WORDS + WINDOW - 1`` words share a seed.
2. A seed that several documents have links each of them to the first document that has it. That is one
   row for each occurrence, however many documents share the seed: the n-th one in a document is linked to the n-th
   one in the first (counted round if that has fewer), so that repeated lines stay on one diagonal. Where seeds in a row are shared, every window of
   ``KEY_WORDS`` words is linked in the same way: the seeds of a passage may have first documents that have nothing
   else of it, but each of its words is in a window whose first document has the whole window.
3. Linked seeds of two documents are chained: runs on one diagonal are scored by their words, a step from
   one run to the next costs what it leaves out on either side, and the best predecessor of a run is a
   prefix maximum of a Fenwick tree over the positions in the first document. Equal runs that overlay each other,
   as a line does that one of them repeats more often, are thinned until no word is in more than two.
4. Chains are aligned word by word along their runs, one shift between two runs, and extended at both
   ends, and cut where the words between agree too little. Pieces that agree well are passages of the later
   document; touching ones are merged, and what has at least ``MIN_WORDS`` words is a fuzzy passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage, drop_scratch
from .blocks import Block, column, group_bounds, slices, text_array, whole_groups, windows

SEED_WORDS, WINDOW = 5, 16
#: Words of equal runs that are sure to share a seed, and that are linked by a key of their own.
KEY_WORDS = SEED_WORDS + WINDOW - 1
#: Words of a passage, and of a chain that may become part of one.
MIN_WORDS, MIN_CHAIN = 50, 16
GAP_COST = 0.1
#: Words on one diagonal without a seed that still belong to one run.
RUN_GAP = 2 * (SEED_WORDS + WINDOW)
IDENTITY = 0.8
#: Words beyond a chain that its ends may be extended by, and the unit that requests for words are rounded to.
MARGIN, UNIT = 2 * (SEED_WORDS + WINDOW), 64
_CHAIN = "chain string, doc_id bigint, first_id bigint, lo bigint, hi bigint, first_lo bigint, first_hi bigint, runs array<bigint>"


def _minimizers(hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word number) of the seeds of all texts."""
    found, first, of = windows(hashes, of, SEED_WORDS, short=False)
    n = len(found) - WINDOW + 1
    chosen = np.zeros(len(found), bool)
    if n > 0:
        text = np.repeat(np.arange(len(of) - 1), np.diff(of))
        least = found[:n].copy()
        for j in range(1, WINDOW):
            np.minimum(least, found[j:j + n], out=least)
        whole = text[:n] == text[WINDOW - 1:]
        for j in range(WINDOW):
            chosen[j:j + n] |= whole & (found[j:j + n] == least)
        chosen[1:] &= (found[1:] != found[:-1]) | (text[1:] != text[:-1])  # one of a run of equal windows
    at = np.flatnonzero(chosen)
    return found[at].view(np.int64), first[at]


def _nth(values: np.ndarray, text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many equal values of the same text come before each."""
    order = np.lexsort((at, values, text))
    new = np.ones(len(at), bool)
    new[1:] = (values[order[1:]] != values[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
    nth = np.empty(len(at), np.int32)
    nth[order] = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    return nth


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = Block.of(text_array(part)).words()
            found, at = _minimizers(words.hashes(), words.of)
            text = np.searchsorted(words.of, at, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), pa.array(column(part, "doc_id")[text]), pa.array((at - words.of[text]).astype(np.int32)), pa.array(_nth(found, text, at))],
                names=["seed", "doc_id", "at", "nth"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of ``KEY_WORDS`` words of the stretches that may hold a run of ``MIN_WORDS`` words of another document.

    A run shares all its seeds but those within ``WINDOW - 1`` words of its start, or within ``KEY_WORDS`` of its end,
    which may be due to words beyond it. Two seeds at least are in it, unless it repeats one word.
    """
    for batch in batches:
        for part in slices(batch, "__text"):
            words = Block.of(text_array(part, "__text")).words()
            hashes, ids = words.hashes(), column(part, "__id")
            _, seeds = _minimizers(hashes, words.of)
            found, first, of = windows(hashes, words.of, KEY_WORDS, short=False)
            new = np.concatenate([[0], np.cumsum(hashes[1:] != hashes[:-1])])
            wanted = np.zeros(len(found), bool)
            bounds = np.searchsorted(seeds, words.of)
            for i, shared in enumerate(part.column("__shared").to_pylist()):
                own, size = seeds[bounds[i]:bounds[i + 1]] - words.of[i], int(words.of[i + 1] - words.of[i])
                alone = np.concatenate([[-WINDOW], own[~np.isin(own, shared)], [size + WINDOW]])
                inside = np.diff(np.searchsorted(own, alone)) - (np.arange(len(alone) - 1) > 0)
                lo, hi = np.maximum(alone[:-1] - WINDOW + 2, 0), np.minimum(alone[1:] + KEY_WORDS - 1, size)
                likely = (inside > 1) | (inside > 0) & (np.diff(alone) > 2 * WINDOW)
                for x, y in zip(lo[likely & (hi - lo >= MIN_WORDS)], hi[likely & (hi - lo >= MIN_WORDS)]):
                    wanted[of[i] + x:of[i] + y - KEY_WORDS + 1] = True
            wanted &= new[first + KEY_WORDS - 1] > new[first] if len(first) else wanted
            at = np.flatnonzero(wanted)
            text = np.searchsorted(of, at, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[at].view(np.int64)), pa.array(ids[text]), pa.array((first[at] - words.of[text]).astype(np.int32)),
                 pa.array(_nth(found[at], text, at))], names=["key", "doc_id", "at", "nth"])


class _Fenwick:
    """Prefix maxima of (score, index) over positions."""

    def __init__(self, size: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (size + 1)

    def put(self, at: int, value: tuple[float, int]) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at]:
                self.best[at] = value
            at += at & -at

    def upto(self, at: int) -> tuple[float, int]:
        at, found = at + 1, (float("-inf"), -1)
        while at > 0:
            if self.best[at] > found:
                found = self.best[at]
            at -= at & -at
        return found


def chains(at: np.ndarray, first_at: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Chains of linked seeds of two documents, as runs (start, end, shift) in words of the later one.

    ``shift`` is the position in the later document less that in the first one.
    """
    shift = at - first_at
    order = np.lexsort((at, shift))
    at, shift = at[order], shift[order]
    cut = np.flatnonzero((shift[1:] != shift[:-1]) | (at[1:] - at[:-1] > RUN_GAP)) + 1
    lo, hi = at[np.concatenate([[0], cut])], at[np.concatenate([cut, [len(at)]]) - 1] + SEED_WORDS
    shift = shift[np.concatenate([[0], cut])]
    if len(lo) == 1:
        return [[(int(lo[0]), int(hi[0]), int(shift[0]))]]
    order = np.lexsort((hi, lo))
    runs = [(int(lo[i]), int(hi[i]), int(shift[i])) for i in order]
    # A run may follow another if it starts after its start and ends after its end on both sides; it pays
    # for the words left out, and counts only words beyond the other's end.
    places = sorted({e - d for _, e, d in runs} | {s - d + SEED_WORDS - 1 for s, _, d in runs})
    rank = {p: i for i, p in enumerate(places)}
    tree, score, before = _Fenwick(len(places)), [0.0] * len(runs), [-1] * len(runs)
    ends, done = sorted(range(len(runs)), key=lambda i: runs[i][1]), 0
    for i, (s, e, d) in enumerate(runs):
        while done < len(ends) and runs[ends[done]][1] <= s + SEED_WORDS - 1:
            j = ends[done]
            if j != i:
                _, end, other = runs[j]
                tree.put(rank[end - other], (score[j] + GAP_COST * (end + end - other), j))
            done += 1
        best, j = tree.upto(rank[s - d + SEED_WORDS - 1])
        best -= GAP_COST * (s + s - d)
        score[i] = e - s
        if j >= 0 and best > 0:
            score[i], before[i] = e - s + best, j
    out, used = [], [False] * len(runs)
    for i in sorted(range(len(runs)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(runs[i])
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def _without_overlaid(found: list[list[tuple[int, int, int]]], keys: np.ndarray, key_shifts: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Chains of a pair without those whose words are all in equal runs of others, so that any word is in two such runs at most.

    A line repeated many times in one document and a few times in the other links every repeat: as many runs, one period
    apart. A run is known to be equal if it is tiled by windows of ``KEY_WORDS`` words; aligned, it stays whole.
    """
    order = np.lexsort((keys, key_shifts))
    keys, shifts = keys[order], key_shifts[order]
    cut = np.flatnonzero((shifts[1:] != shifts[:-1]) | (keys[1:] - keys[:-1] > KEY_WORDS)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]]) - 1
    equal = set(zip(keys[first].tolist(), (keys[last] + KEY_WORDS).tolist(), shifts[first].tolist())) if len(keys) else set()
    alike = sorted((runs[0] for runs in found if len(runs) == 1 and runs[0] in equal), key=lambda run: (run[0], -run[1]))
    stay, best, end = set(), None, -1  # every run that reaches furthest of those that start in what is covered
    for run in alike:
        if best and run[0] > end:
            stay.add(best)
            best, end = None, best[1]
        if run[0] > end:
            stay.add(run)
            end = run[1]
        elif run[1] > (best[1] if best else end):
            best = run
    if best:
        stay.add(best)
    dropped = set(alike) - stay
    return [runs for runs in found if len(runs) > 1 or runs[0] not in dropped]


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = ["doc_id", "first_id"]
    for table in whole_groups(batches, keys):
        bounds, out = group_bounds(table, keys), []
        doc, first, at, first_at = (column(table, c).astype(np.int64) for c in ("doc_id", "first_id", "at", "first_at"))
        both, key = at << 32 | first_at, column(table, "key")
        for s, e in zip(bounds[:-1], bounds[1:]):
            # Repeated rows of a document repeat its seeds. A key counts as the seeds at its two ends.
            ends = both[s:e][key[s:e]] + (KEY_WORDS - SEED_WORDS) * (1 << 32 | 1)
            own = np.unique(np.concatenate([both[s:e], ends]))
            found = chains(own >> 32, own & 0xFFFFFFFF)
            if len(found) > 2:
                windows_at = np.unique(both[s:e][key[s:e]])
                found = _without_overlaid(found, windows_at >> 32, (windows_at >> 32) - (windows_at & 0xFFFFFFFF))
            for runs in found:
                lo, hi = runs[0][0], runs[-1][1]
                if hi - lo < MIN_CHAIN:
                    continue
                a, b = max(0, min(x - d for x, _, d in runs) - MARGIN), max(y - d for _, y, d in runs) + MARGIN
                out.append((f"{doc[s]}:{first[s]}:{lo}:{runs[0][2]}", int(doc[s]), int(first[s]), max(0, lo - MARGIN) // UNIT, -(-(hi + MARGIN) // UNIT),
                            a // UNIT, -(-b // UNIT), [x for run in runs for x in run]))
        names = [x.split()[0] for x in _CHAIN.split(", ")]
        types = [pa.string(), *[pa.int64()] * 6, pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in out], t) for i, t in enumerate(types)], names=names)


def _requested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of the words of every requested range of every document."""
    for batch in batches:
        for part in slices(batch, "__text"):
            words = Block.of(text_array(part, "__text")).words()
            hashes, ids = words.hashes().astype(np.uint32), column(part, "__id")
            out = [[], [], [], []]
            for i, wanted in enumerate(part.column("__wanted").to_pylist()):
                own = hashes[words.of[i]:words.of[i + 1]]
                for r in wanted:
                    for x, v in zip(out, (int(ids[i]), r["lo"], r["hi"], own[r["lo"] * UNIT:r["hi"] * UNIT].tobytes())):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                             names=["id", "lo", "hi", "words"])


def _segments(equal: np.ndarray, cost: int) -> list[tuple[int, int]]:
    """All maximal scoring segments (Ruzzo and Tompa) of columns that agree (+1) or not (-cost).

    Every agreeing column is in one; two are one segment if the columns between cost less than either side scores.
    """
    bounds = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).astype(np.int8)))
    total, at, held = 0, 0, []  # held: (start, end, score before, score after)
    for s, e in zip(bounds[::2].tolist(), bounds[1::2].tolist()):
        total -= cost * (s - at)
        now, at = (s, e, total, total + e - s), e
        total = now[3]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= now[2]:
                j -= 1
            if j < 0 or held[j][3] >= now[3]:
                break
            now = (held[j][0], now[1], held[j][2], now[3])
            del held[j:]
        held.append(now)
    return [(s, e) for s, e, _, _ in held]


def align(runs: list[tuple[int, int, int]], own: np.ndarray, own_at: int, first: np.ndarray, first_at: int) -> list[tuple[int, int, float]]:
    """(start, end, identity) of the pieces of a chain that agree well, in the later document.

    A difference costs as much as two agreeing words, so a chain ends or is cut where words that differ cost more
    than the words on either side score; a piece of less than ``IDENTITY`` is cut with a higher cost. Of what was cut so,
    two neighbours that repeat ``KEY_WORDS`` words of each other (a line that differs alike each time) are judged together as well.
    ``own`` and ``first`` are word hashes from positions ``own_at`` and ``first_at`` on.
    """
    def agree(lo: int, hi: int, shift: int) -> np.ndarray:
        at = np.arange(lo, hi)
        a, b = at - own_at, at - shift - first_at
        good = (a >= 0) & (a < len(own)) & (b >= 0) & (b < len(first))
        out = np.zeros(len(at), bool)
        out[good] = own[a[good]] == first[b[good]]
        return out

    start, end, shift = runs[0]
    places, equal = [np.arange(start - MARGIN, end)], [agree(start - MARGIN, end, shift)]
    for lo, hi, other in runs[1:]:
        if hi <= end:
            continue
        # One shift at the best place between the two runs; words that only one side has count as differing.
        begin = min(lo, end)
        kept = places[-1] < begin
        places[-1], equal[-1] = places[-1][kept], equal[-1][kept]
        gap_before, gap_after = agree(begin, hi, shift), agree(begin, hi, other)
        score = np.concatenate([[0], np.cumsum(gap_before)]) + np.concatenate([[0], np.cumsum(gap_after[::-1])])[::-1]
        turn, extra = int(np.argmax(score)), max(0, shift - other)
        places.append(np.concatenate([np.arange(begin, begin + turn), np.full(extra, begin + turn), np.arange(begin + turn, hi)]))
        equal.append(np.concatenate([gap_before[:turn], np.zeros(extra, bool), gap_after[turn:]]))
        end, shift = hi, other
    places = np.concatenate([*places, np.arange(end, end + MARGIN)])
    equal = np.concatenate([*equal, agree(end, end + MARGIN, shift)])
    out, cut, open_ = [], [], [(0, len(equal), 2)]
    while open_:
        s, e, cost = open_.pop()
        for lo, hi in _segments(equal[s:e], cost):
            lo, hi = lo + s, hi + s
            identity = float(equal[lo:hi].mean())
            if identity < IDENTITY:
                open_.append((lo, hi, cost + 1))
            elif places[hi - 1] + 1 - places[lo] >= MIN_CHAIN:
                out.append((int(places[lo]), int(places[hi - 1]) + 1, identity))
                cut += [(lo, hi)] if cost > 2 else []

    def repeats(lo: int, hi: int) -> set[bytes]:
        words = own[places[lo] - own_at:places[hi - 1] + 1 - own_at]
        return {words[i:i + KEY_WORDS].tobytes() for i in range(len(words) - KEY_WORDS + 1)}

    cut.sort()
    for (lo, end), (start, hi) in zip(cut, cut[1:]):
        identity = float(equal[lo:hi].mean())
        if identity >= IDENTITY and repeats(lo, end) & repeats(start, hi):
            out.append((int(places[lo]), int(places[hi - 1]) + 1, identity))
    return sorted(out)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [[], [], [], [], []]
        for r in batch.to_pylist():
            flat = r["runs"]
            runs = list(zip(flat[::3], flat[1::3], flat[2::3]))
            for start, end, identity in align(runs, np.frombuffer(r["words"], np.uint32), r["lo"] * UNIT,
                                              np.frombuffer(r["first_words"], np.uint32), r["first_lo"] * UNIT):
                for x, v in zip(out, (r["doc_id"], start, end, r["first_id"], identity)):
                    x.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (*[pa.int64()] * 4, pa.float64()))],
                                         names=["doc_id", "start", "end", "first_id", "identity"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Touching aligned chains of a document as one passage, if long enough."""
    for table in whole_groups(batches, ["doc_id"]):
        out = [[], [], [], [], []]
        now = None
        rows = zip(*(column(table, c).tolist() for c in ("doc_id", "start", "end", "first_id", "identity")))
        for doc, start, end, first, identity in [*rows, (None, 0, 0, 0, 0.0)]:
            if now and now[0] == doc and start <= now[2] + 2:
                now = [doc, now[1], max(end, now[2]), min(first, now[3]), min(identity, now[4])]
                continue
            if now and now[2] - now[1] >= MIN_WORDS:
                for x, v in zip(out, now):
                    x.append(v)
            now = [doc, start, end, first, identity]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (*[pa.int64()] * 4, pa.float64()))],
                                         names=["doc_id", "start", "end", "first_id", "identity"])


def _by_id(documents: DataFrame) -> DataFrame:
    """All columns with the id and text under names of their own, without rows that have no id."""
    return documents.withColumns({"__id": F.col("doc_id").cast("bigint"), "__text": F.coalesce(F.col("text").cast("string"), F.lit(""))}).where("__id is not null")


def shared_passages(documents: DataFrame, seed_partitions: int | None = None) -> DataFrame:
    """(doc_id, start, end, first_id, identity): passages that an earlier document has as well, words from
    ``start`` up to ``end``.

    ``first_id`` is the least doc_id a part of it was found in, always less than ``doc_id``; ``identity`` the
    least share of equal words of its parts. The first document that has a passage is not listed for it.
    Of equal windows in a row only the first is a seed, so a run of one repeated word is no passage.
    Rows without an id, and null, empty or short texts, have no passages. Rows that repeat a doc_id with
    the same text are the same document. Other columns are ignored.
    """
    known = _by_id(documents)
    texts = known.select(F.col("__id").alias("doc_id"), F.col("__text").alias("text"))
    seeds = texts.mapInArrow(_seeds, "seed bigint, doc_id bigint, at int, nth int")
    shared = seeds.groupBy("seed").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").drop("last_id")
    # Aggregates are tables before they are joined: both sides of the join are then plain exchanges, and
    # adaptive execution can split the rows of a seed that very many documents have.
    shared = cut_lineage(shared, "shared-seeds")
    hits = cut_lineage(seeds.join(shared, "seed"), "seeds")
    drop_scratch(shared)
    firsts = cut_lineage(hits.where("doc_id = first_id").groupBy("seed").agg(F.array_sort(F.collect_set("at")).alias("places")), "first-seeds")
    links = (hits.where("doc_id > first_id").join(firsts, "seed")
             .select("doc_id", "first_id", "at", F.expr("element_at(places, nth % size(places) + 1)").alias("first_at"), F.lit(False).alias("key")))
    likely = hits.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_list("at").alias("__shared"))
    keys = (known.select("__id", "__text").join(likely, known["__id"] == likely["__doc"])
            .mapInArrow(_keys, "key bigint, doc_id bigint, at int, nth int"))
    keys = cut_lineage(keys, "keys")
    owners = (keys.where("nth = 0").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.min_by("at", "doc_id").alias("first_at"), F.max("doc_id").alias("last_id"))
              .where("first_id < last_id").drop("last_id"))
    owners = cut_lineage(owners, "key-owners")
    # Few keys occur again in their first document, so only those have a list of places.
    again = (keys.where("nth > 0").join(owners.withColumnRenamed("first_id", "doc_id"), ["key", "doc_id"]).groupBy("key")
             .agg(F.array_sort(F.collect_set("at")).alias("places")))
    places = cut_lineage(owners.join(again, "key", "left"), "key-places")
    drop_scratch(owners)
    links = links.union(keys.join(places, "key").where("doc_id > first_id")
                        .select("doc_id", "first_id", "at", F.expr("if(nth % (size(places) + 1) > 0, element_at(places, nth % (size(places) + 1)), first_at)"), F.lit(True)))
    found = cut_lineage(links.repartition("doc_id", "first_id").sortWithinPartitions("doc_id", "first_id", "at").mapInArrow(_chained, _CHAIN), "chains")
    drop_scratch(hits, firsts, keys, places)
    wanted = (found.select(F.col("doc_id").alias("__doc"), "lo", "hi")
              .union(found.select("first_id", "first_lo", "first_hi")).distinct()
              .groupBy("__doc").agg(F.collect_list(F.struct("lo", "hi")).alias("__wanted")))
    words = known.join(wanted, known["__id"] == wanted["__doc"]).mapInArrow(_requested, "id bigint, lo bigint, hi bigint, words binary")
    words = cut_lineage(words.dropDuplicates(["id", "lo", "hi"]), "words")
    first_words = words.select(F.col("id").alias("first_id"), F.col("lo").alias("first_lo"), F.col("hi").alias("first_hi"), F.col("words").alias("first_words"))
    pairs = (found.join(words.withColumnRenamed("id", "doc_id"), ["doc_id", "lo", "hi"])
             .join(first_words, ["first_id", "first_lo", "first_hi"])
             .select("doc_id", "first_id", "lo", "first_lo", "runs", "words", "first_words"))
    spans = "doc_id bigint, start bigint, end bigint, first_id bigint, identity double"
    return pairs.mapInArrow(_aligned, spans).repartition("doc_id").sortWithinPartitions("doc_id", "start", "end").mapInArrow(_merged, spans)


def without_shared_passages(documents: DataFrame) -> DataFrame:
    """``documents`` with every passage cut out that an earlier document has; its first owner keeps it.

    All rows and columns stay. An integer column n_chars is set to the code points of the new text.
    """
    spans = shared_passages(documents).groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_list(F.struct("start", "end")).alias("__spans"))
    known = _by_id(documents)
    names = documents.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                block = Block.of(text_array(part, "__text"))
                words, texts = block.words(), part.column("text").to_pylist()
                for i, spans in enumerate(part.column("__spans").to_pylist()):
                    if spans:
                        base, starts = block.bounds[i], words.starts[words.of[i]:words.of[i + 1]]
                        places = np.append(starts, block.bounds[i + 1])
                        keep, at = [], base
                        for s in sorted(spans, key=lambda s: s["start"]):
                            keep.append(block.data[at:places[s["start"]]].tobytes())
                            at = places[min(s["end"], len(starts))]
                        keep.append(block.data[at:block.bounds[i + 1]].tobytes())
                        texts[i] = b"".join(keep).decode()
                columns = [pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    out = known.join(spans, known["__id"] == spans["__doc"], "left").mapInArrow(cut, documents.schema).union(documents.where("doc_id is null"))
    kind = dict(out.dtypes).get("n_chars")
    return out.withColumn("n_chars", F.length("text").cast(kind)) if kind in ("bigint", "int") else out
