"""Packing tokenized documents into sequences by patterns of few lengths, fitted to the length histogram.

1. Documents become pieces of at most ``CAPACITY`` tokens. Only one small row for each piece is kept.
2. The histogram of lengths (at most ``CAPACITY`` rows) goes to the driver. Patterns of one to four
   lengths that fill a sequence exactly get repeat counts by non-negative least squares against the
   histogram; counts are rounded and what they leave is packed best-fit, in both cases by counts and not by
   document, so the plan is as small for any input.
3. A piece finds its place in the plan by its number among the pieces of its length. Numbers come from
   counts by (length, bucket), so a length that most pieces have is counted in many tasks.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .blocks import column, slices, text_array

CAPACITY = 4096
END_ID = 1
#: Marks at the end of a word that the tokenizer parts from letters before them.
MARKS = ".,;:!?"
#: Characters that ``str.split`` takes for white space and the tokenizer doesn't, and the words of texts that hold any.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_WORD = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: If the model alone gives these the ids that the whole tokenizer does, it is asked alone for all runs of small ASCII letters.
_PROBES = ("a", "z", "word", "internationalization", "qxzjvkw", "thestorymentedie", "abcdefghijklmnopqrstuvwxyz" * 3)
#: Words, and parts of words, whose ids a worker remembers at once; as many older ones are kept beside them.
REMEMBERED = 400_000
#: Lengths that patterns of three and four are built from.
GRID = 24
STEPS = 200


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Remembered:
    """A mapping of bounded size that forgets what wasn't asked for lately."""

    def __init__(self):
        self.young, self.old = {}, {}

    def missing(self, keys: set[str]) -> set[str]:
        """Keys that aren't known; after it, all others are in ``young``."""
        new = keys - self.young.keys()
        if len(self.young) + len(new) > REMEMBERED:
            self.old, self.young, new = self.young, {}, keys
        found = new & self.old.keys()
        self.young.update((k, self.old[k]) for k in found)
        return new - found


class _Ids:
    """Token ids of texts as little-endian 32-bit bytes, remembered by word.

    The tokenizer drops white space and never looks across it, so a text's ids are those of its words. It also
    parts letters from marks and ignores case, so a word of letters and marks is looked up in two parts.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.words, self.parts = Tokenizer.from_str(definition), _Remembered(), _Remembered()
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.direct = all(self._plain(p) == self.tokenizer.encode(p, add_special_tokens=False).ids for p in _PROBES)

    def _plain(self, word: str) -> list[int]:
        return [token.id for token in self.tokenizer.model.tokenize(word)]

    def _encoded(self, parts: set[str]) -> None:
        """Encodes what isn't known yet. A run of letters ends with the one of its tokens that is marked as the end
        of a word, so many of them are encoded as one text and told apart by that."""
        new = sorted(self.parts.missing(parts))
        words = [p for p in new if p.isalpha()]
        alone = [p for p in new if not p.isalpha()]
        if self.direct:
            flat, ends, model = [], [0], self.tokenizer.model
            plain = [p for p in words if p.isascii() and p.islower()]
            words = [p for p in words if not (p.isascii() and p.islower())]
            for p in plain:
                flat += [token.id for token in model.tokenize(p)]
                ends.append(4 * len(flat))
            data = np.array(flat, "<u4").tobytes()
            self.parts.young.update((p, data[a:b]) for p, a, b in zip(plain, ends, ends[1:]))
        for at in range(0, len(words), 512):
            some = words[at:at + 512]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some) or ends[-1] != len(ids):
                alone += some
                continue
            data, at_byte = ids.tobytes(), [0, *(4 * ends).tolist()]
            self.parts.young.update((p, data[a:b]) for p, a, b in zip(some, at_byte, at_byte[1:]))
        for at in range(0, len(alone), 4096):
            some = alone[at:at + 4096]
            for part, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.parts.young[part] = np.array(found.ids, "<u4").tobytes()

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of some words."""
        new = {}
        for word in self.words.missing(set(words)):
            letters = word.rstrip(MARKS)
            if letters.isalpha():
                new[word] = (letters.lower() if letters.isascii() else letters, word[len(letters):])
            else:
                new[word] = (word, "")
        self._encoded({p for pair in new.values() for p in pair if p})
        parts, known = self.parts.young, self.words.young
        for word, (letters, marks) in new.items():
            known[word] = parts[letters] + parts[marks] if marks else parts[letters]
        return [known[w] for w in words]

    def __call__(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text. Words are looked up once for all texts, and their ids gathered by number."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        odd = pc.match_substring_regex(texts, f"[{_SEPARATORS}]")
        some = pc.any(odd, min_count=0).as_py()
        words = pc.utf8_split_whitespace(pc.if_else(odd, "", texts) if some else texts)
        flat = words.flatten().dictionary_encode()
        ids = self._of_each(flat.dictionary.to_pylist())
        gathered = pa.array(ids, pa.large_binary()).take(flat.indices)
        if not len(gathered):
            data, at = b"", [0] * (len(texts) + 1)
        else:
            _, offsets, values = gathered.buffers()
            data = values.to_pybytes() if values is not None else b""
            at = np.frombuffer(offsets, np.int64, len(gathered) + 1)[words.offsets.to_numpy()].tolist()
        out = [data[i:j] for i, j in zip(at, at[1:])]
        for i in pc.indices_nonzero(odd).to_pylist() if some else ():
            out[i] = b"".join(self._known(_WORD.findall(texts[i].as_py())))
        return out

    def _of_each(self, words: list[str]) -> list[bytes]:
        """As :meth:`_known`, for lists in which white space at an end of a text left an empty word."""
        found = iter(self._known([w for w in words if w]))
        return [next(found) if w else b"" for w in words]


@lru_cache(2)
def _ids(definition: str) -> _Ids:
    return _Ids(definition)


def pieces(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row of ``documents``. A null text is empty, and
    an empty text is one piece of the end id alone. Rows that repeat a doc_id have pieces of their own."""
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as file:
        definition = file.read()
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(definition)
        for batch in batches:
            for part in slices(batch, "text"):
                rows: list[int] = []
                out: list[tuple[int, int, int, int]] = []
                for i, data in enumerate(ids(text_array(part))):
                    data += end
                    for n, at in enumerate(range(0, len(data), 4 * capacity)):
                        own = data[at:at + 4 * capacity]
                        rows.append(i)
                        out.append((n, at // 4, len(own) // 4, zlib.crc32(own)))
                figures = np.array(out, np.int64).reshape(-1, 4).T
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(figures[0].astype(np.int32)), *map(pa.array, figures[1:])],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    texts = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(cut, f"doc_id {dict(texts.dtypes)['doc_id']}, piece int, start bigint, length bigint, ids_crc32 bigint")


def patterns(histogram: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Patterns of at most four lengths, all present and filling ``capacity`` exactly; unused places are 0."""
    present = np.flatnonzero(histogram)
    if not len(present):
        return np.zeros((0, 4), np.int64)
    weight = np.cumsum(histogram[present])
    grid = np.unique(present[np.searchsorted(weight, np.linspace(1, weight[-1], GRID))])
    out = [np.array([[capacity]])]
    out.append(np.stack([present, capacity - present], 1))
    three = np.stack([x.ravel() for x in np.meshgrid(present, grid, indexing="ij")], 1)
    out.append(np.column_stack([three, capacity - three.sum(axis=1)]))
    four = np.stack([x.ravel() for x in np.meshgrid(grid, grid, grid, indexing="ij")], 1)
    out.append(np.column_stack([four, capacity - four.sum(axis=1)]))
    rows = np.concatenate([np.pad(x, ((0, 0), (0, 4 - x.shape[1]))) for x in out])
    rows = rows[(rows >= 0).all(axis=1)]
    rows = np.unique(-np.sort(-rows, axis=1), axis=0)
    held = np.concatenate([[True], histogram[1:] > 0])
    return rows[held[rows].all(axis=1) & (rows.sum(axis=1) == capacity)]


def repeats(rows: np.ndarray, histogram: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeat counts by least squares against the histogram (multiplicative updates: the
    matrix and the histogram are not negative, so every step keeps the sign and lowers the error)."""
    used = (rows > 0).astype(float)

    def wanted(x: np.ndarray) -> np.ndarray:
        return (x[rows] * used).sum(axis=1)

    target = wanted(histogram.astype(float))
    x = np.full(len(rows), max(histogram.sum(), 1) / max(len(rows), 1) / 3)
    for _ in range(steps):
        fitted = np.bincount(rows.ravel(), (x[:, None] * used).ravel(), len(histogram))
        x *= target / np.maximum(wanted(fitted), 1e-12)
    return x


def plan(histogram: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences) that hold every piece of the histogram once."""
    left, out = histogram.astype(np.int64).copy(), []
    rows = patterns(histogram, capacity)
    fitted = repeats(rows, histogram)
    for p in np.argsort(-fitted, kind="stable"):
        wanted = int(fitted[p] + 0.5)
        if not wanted:
            break
        lengths, count = np.unique(rows[p][rows[p] > 0], return_counts=True)
        n = min(wanted, int((left[lengths] // count).min()))
        if n > 0:
            left[lengths] -= n * count
            out.append((np.repeat(lengths, count)[::-1].tolist(), n))
    # Best fit of the rest, longest first: all pieces of a length at once, into kinds of sequences.
    spaces: list[int] = []
    kinds: dict[int, list[tuple[list[int], int]]] = {}

    def open_(space: int, content: list[int], n: int) -> None:
        if n:
            if space not in kinds:
                spaces.insert(bisect_left(spaces, space), space)
            kinds.setdefault(space, []).append((content, n))

    for length in np.flatnonzero(left)[::-1].tolist():
        count = int(left[length])
        while count:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                fit = capacity // length
                space, content, n = capacity, [], -(-count // fit)
            else:
                space = spaces[at]
                content, n = kinds[space].pop()
                if not kinds[space]:
                    del kinds[space]
                    spaces.pop(at)
                fit = space // length
            full = min(n, count // fit)
            rest = count - full * fit if full < n else 0
            open_(space - fit * length, content + [length] * fit, full)
            if rest:
                open_(space - rest * length, content + [length] * rest, 1)
            if content:
                open_(space, content, n - full - (rest > 0))
            count -= full * fit + rest
    return out + [kind for same in kinds.values() for kind in same]


def places(kinds: list[tuple[list[int], int]]) -> np.ndarray:
    """The plan by length: (length, first number, sequence of that number, offset) in order."""
    taken, rows, sequence = {}, [], 0
    for lengths, n in kinds:
        offset = 0
        for length in lengths:
            number = taken.get(length, 0)
            rows.append((length, number, sequence, offset))
            taken[length] = number + n
            offset += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def packed(documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Other columns of ``documents`` are ignored; an empty table gives no rows.
    """
    spark = documents.sparkSession
    rows = cut_lineage(pieces(documents, tokenizer, capacity), "pieces")
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = cut_lineage(rows.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row for each length, of which there are `capacity`
        histogram[r["length"]] = r["n"]
    table = places(plan(histogram, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    number = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    numbered = rows.withColumn("number", number).join(first, ["length", "bucket"]).withColumn("number", F.col("number") + F.col("base") - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length, number = column(batch, "length"), column(batch, "number")
            at = np.searchsorted(key, (length << 44) + number, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(table[at, 2] + number - table[at, 1]), pa.array(table[at, 3])],
                names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = dict(rows.dtypes)
    return numbered.select(*names, "number").mapInArrow(
        place, ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id bigint, offset bigint")
