"""Fill-in-the-middle: texts cut at two token boundaries and put in another order, reversibly.

A cut is drawn as the rank of a boundary, and has to be turned into an offset of the text. Each text gets a
learned index for that: line segments, fitted to the offsets of all its boundaries with a bounded error, predict
the offset of a rank, and one stored byte for each boundary corrects the prediction exactly. Boundaries are found and
fitted in stretches, so the index of a long text takes a byte for each boundary, and no array of offsets of
the whole text is held.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .blocks import Block, slices, text_array

SEED = "1"
#: Of a hundred documents, how many are cut, and of a hundred cut ones, how many have their suffix first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Greatest distance of a boundary from its segment, with what rounding adds still a signed byte.
ERROR = 126
#: Boundaries of one segment, and bytes of text looked at at once.
SEGMENT, STRETCH = 1 << 14, 1 << 20
SCHEMA = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def boundaries(data: np.ndarray, stretch: int = STRETCH) -> Iterator[np.ndarray]:
    """Byte offsets of all token starts of a UTF-8 text, then its length. A token is a run of ASCII letters or one other code point."""
    before = False
    for at in range(0, len(data), stretch):
        own = data[at:at + stretch]
        letter = _LETTER[own]
        follows = np.empty(len(own), bool)
        follows[0], follows[1:] = before, letter[:-1]
        before = bool(letter[-1])
        yield np.flatnonzero(~(letter & follows) & ((own & 0xC0) != 0x80)) + at
    yield np.array([len(data)])


class RankIndex:
    """Offsets by rank: segments that are off by at most :data:`ERROR`, and the residual of every rank."""

    def __init__(self, offsets: Iterator[np.ndarray], segment: int = SEGMENT):
        self.firsts: list[int] = []
        self.starts: list[int] = []
        self.slopes: list[float] = []
        residuals: list[np.ndarray] = []
        held, done, rank = np.zeros(0, np.int64), False, 0
        while not done or len(held):
            while not done and len(held) < segment:
                more = next(offsets, None)
                done = more is None
                held = held if done else np.concatenate([held, more]) if len(held) else more
            at = 0
            while at < len(held) and (done or len(held) - at >= segment):
                own = held[at:at + segment]
                length, slope = _segment(own)
                own = own[:length]
                self.firsts.append(rank)
                self.starts.append(int(own[0]))
                self.slopes.append(slope)
                residuals.append((own - own[0] - _rise(slope, np.arange(length))).astype(np.int8))
                at, rank = at + length, rank + length
            held = held[at:]
        self.residuals = np.concatenate(residuals) if residuals else np.zeros(0, np.int8)

    def __len__(self) -> int:
        return len(self.residuals)

    def __getitem__(self, rank: int) -> int:
        i = bisect_right(self.firsts, rank) - 1
        return self.starts[i] + int(_rise(self.slopes[i], rank - self.firsts[i])) + int(self.residuals[rank])


def _rise(slope: float, steps):
    return np.floor(slope * steps).astype(np.int64) if isinstance(steps, np.ndarray) else np.floor(slope * steps)


def _segment(offsets: np.ndarray) -> tuple[int, float]:
    """How many of the offsets one line through the first can serve, and its slope.

    Every offset allows a range of slopes; a segment lasts as long as these ranges have a slope in common.
    """
    if len(offsets) == 1:
        return 1, 0.0
    steps, rise = np.arange(1, len(offsets)), offsets[1:] - offsets[0]
    least, most = np.maximum.accumulate((rise - ERROR) / steps), np.minimum.accumulate((rise + ERROR) / steps)
    apart = least > most
    n = int(np.argmax(apart)) if apart[-1] else len(steps)
    return n + 1, float((least[n - 1] + most[n - 1]) / 2) if n else 0.0


def _characters(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _transformed(data: np.ndarray, draws: tuple[int, int, int, int], cut_percent: int, suffix_first_percent: int) -> tuple[int, str, int | None, int | None, bytes]:
    index, raw = RankIndex(boundaries(data)), data.tobytes()
    n = len(index) - 1
    if not raw or draws[2] % 100 >= cut_percent or any(mark.encode() in raw for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, raw
    first, second = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, b = index[first], index[second]
    figures = _characters(data[:a]), _characters(data[a:b])
    head, middle, tail = (mark.encode() + part for mark, part in ((PREFIX, raw[:a]), (MIDDLE, raw[a:b]), (SUFFIX, raw[b:])))
    if draws[3] % 100 < suffix_first_percent:
        return n, "spm", *figures, tail + head + middle
    return n, "psm", *figures, head + tail + middle


def fill_in_middle(documents: DataFrame, seed: str = SEED, cut_percent: int = CUT_PERCENT,
                   suffix_first_percent: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """All rows and columns of ``documents``, with the number of tokens, the form, the parts' lengths and the output.

    The form is ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) or ``plain`` (the text as it
    is: not drawn, empty, or with a mark of its own in it; no part lengths then). Draws come from a digest of
    the seed and doc_id, so reruns agree and rows that repeat a doc_id are drawn alike; a null id counts as
    an empty one. A null text is empty. Columns of ``documents`` that are named like a result are replaced.
    Rows are worked on where they lie; a task holds a few megabytes, or its longest text and a byte for each of its boundaries.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    carried = [c for c in documents.columns if c.lower() not in {*names, "text"}]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = F.array(*(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)))
    source = documents.select(*carried, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), draws.alias("__draws"))

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                block = Block.of(text_array(part))
                drawn = part.column("__draws").flatten().to_numpy().reshape(-1, 4).tolist()
                rows = [_transformed(block.data[a:b], d, cut_percent, suffix_first_percent)
                        for a, b, d in zip(block.bounds[:-1], block.bounds[1:], drawn)]
                kinds = pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()
                made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), part.column("text"), *made[:4], made[4].cast(pa.string())],
                                                 names=[*carried, "text", *names])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema if f.name != "__draws")
    return source.mapInArrow(transform, fields + SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The exact text of an output. A part can't hold a mark, and no part makes one together with a mark beside it."""

    def between(left: str, right: str) -> Column:
        return F.substring_index(F.substring(output, F.instr(output, left) + len(left), F.length(output)), right, 1)

    last = F.substring(output, F.instr(output, MIDDLE) + len(MIDDLE), F.length(output))
    return (F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), last, between(SUFFIX, MIDDLE)))
            .when(form == "spm", F.concat(between(PREFIX, MIDDLE), last, between(SUFFIX, PREFIX))).otherwise(output))


def fill_report(documents: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row, see :func:`fill_in_middle`."""
    made = fill_in_middle(documents.select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


REPORT_SQL = r"""
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS tokens, ('0x' || substr(h, 1, 8))::BIGINT AS h1,
    ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM drawn),
counted AS (SELECT *, len(tokens)::BIGINT AS n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
    OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM split),
cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM counted),
parts AS (SELECT *, array_to_string(list_slice(tokens, 1, a), '') AS prefix, array_to_string(list_slice(tokens, a + 1, b), '') AS middle,
    array_to_string(list_slice(tokens, b + 1, n), '') AS suffix FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
