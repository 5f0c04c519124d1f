"""Quality rules as a short-circuit cascade: cheap, often rejecting rules run first.

Every text gets the base figures. Only texts that pass the base test enter the cascade, and each rule
looks only at the texts that all rules before it let through. What a rule costs and how much it rejects
is measured on a sample; rules then run by rejections per second. The order changes the work and never
the verdict, which is "no rule rejects".
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import U64, Block, mix, slices, text_array, windows

#: Texts of the sample that the order of the rules is estimated on.
SAMPLE_ROWS = 2000
SCHEMA = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "base_failed boolean, kept boolean")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[list(range(65, 91))] = True
_LETTER = _CAPITAL.copy()
_LETTER[list(range(97, 123))] = True
_WORDLIKE = _LETTER.copy()
_WORDLIKE[128:] = True


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeats(values: np.ndarray, groups: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Of (group, value) pairs: which occur again, and the surplus of each group over its distinct values."""
    key = mix(values + mix(groups.astype(U64) + U64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again, twin = np.zeros(len(key), bool), np.zeros(len(key), bool)
    again[order[1:]] = same
    twin[order[1:]] = same
    twin[order[:-1]] |= same
    return twin, np.bincount(groups[again], minlength=n_groups)


class View:
    """A block of texts with its figures. Rules read them, and scan bytes or words themselves where they must."""

    def __init__(self, block: Block):
        self.block, n = block, len(block)
        words = self.words = block.words()
        points = block.code_points()
        self.n_words = words.counts()
        chars = np.zeros(len(words.starts) + 1, np.int64)
        np.cumsum(points[words.ends] - points[words.starts], out=chars[1:])
        self.word_chars = chars[words.of[1:]] - chars[words.of[:-1]]
        self.n_symbols = _per_text(_SYMBOL[block.data], block.bounds)
        self.hashes = words.hashes()
        found, first, of = windows(self.hashes, words.of, 5, short=False)
        twin, _ = _repeats(found, np.repeat(np.arange(n), np.diff(of)), n)
        cover = np.zeros(len(words.starts) + 6, np.int64)
        np.add.at(cover, first[twin], 1)
        np.add.at(cover, first[twin] + 5, -1)
        self.n_repeat_words = _per_text(np.cumsum(cover)[:len(words.starts)] > 0, words.of)
        # Lines: a text's bounds and what follows each line feed.
        feeds = np.flatnonzero(block.data == 10)
        owner = np.searchsorted(block.bounds, feeds, "right") - 1
        starts = np.concatenate([block.bounds[:-1], feeds + 1])
        text = np.concatenate([np.arange(n), owner])
        order = np.lexsort((starts, text))
        starts, text = starts[order], text[order]
        ends = np.append(starts[1:] - 1, 0)
        last = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, bool)
        ends[last] = block.bounds[1:][text[last]]
        full = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
        starts, ends, text = starts[full], ends[full], text[full]
        self.n_lines = np.bincount(text, minlength=n)
        _, self.n_dup_lines = _repeats(block.span_hashes(starts, ends), text, n)
        self.base_failed = (self.n_words < 10) | (100 * self.n_repeat_words > 20 * self.n_words)

    def bytes_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of some texts, and their bounds."""
        size = np.diff(self.block.bounds)[rows]
        bounds = np.concatenate([[0], np.cumsum(size)])
        return self.block.data[np.repeat(self.block.bounds[rows] - bounds[:-1], size) + np.arange(bounds[-1])], bounds


@dataclass(frozen=True)
class Rule:
    """``rejects(view, rows)`` says which of the texts ``rows`` go."""

    name: str
    rejects: Callable[[View, np.ndarray], np.ndarray]


def _symbols(view: View, rows: np.ndarray) -> np.ndarray:
    return 10 * view.n_symbols[rows] > 3 * view.n_words[rows]


def _word_length(view: View, rows: np.ndarray) -> np.ndarray:
    chars, words = view.word_chars[rows], view.n_words[rows]
    return (chars < 2 * words) | (chars > 20 * words)


def _lines(view: View, rows: np.ndarray) -> np.ndarray:
    return 10 * view.n_dup_lines[rows] > 5 * view.n_lines[rows]


def _capitals(view: View, rows: np.ndarray) -> np.ndarray:
    data, bounds = view.bytes_of(rows)
    return 2 * _per_text(_CAPITAL[data], bounds) > _per_text(_LETTER[data], bounds)


def _wordlike(view: View, rows: np.ndarray) -> np.ndarray:
    data, bounds = view.bytes_of(rows)
    return 2 * _per_text(_WORDLIKE[data], bounds) < view.word_chars[rows]


def _one_word(view: View, rows: np.ndarray) -> np.ndarray:
    """The most frequent word makes up more than 3 in 10."""
    of, out = view.words.of, np.zeros(len(rows), bool)
    for i, r in enumerate(rows):
        own = np.sort(view.hashes[of[r]:of[r + 1]])
        run = max(int(0.3 * len(own)), 1)  # a word that often stands at both ends of a run that long, sorted
        out[i] = bool(np.any(own[run:] == own[:len(own) - run]))
    return out


RULES = (Rule("symbols", _symbols), Rule("word length", _word_length), Rule("repeated lines", _lines),
         Rule("capitals", _capitals), Rule("wordlike characters", _wordlike), Rule("one word", _one_word))


def cascade(view: View, rules: tuple[Rule, ...]) -> np.ndarray:
    """Texts that pass the base test and every rule."""
    rows = np.flatnonzero(~view.base_failed)
    for rule in rules:
        if not len(rows):
            break
        rows = rows[~rule.rejects(view, rows)]
    kept = np.zeros(len(view.n_words), bool)
    kept[rows] = True
    return kept


def rule_order(documents: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """Rules by rejections per second, measured on at most ``sample_rows`` texts that pass the base test."""
    few = documents.select("text").limit(sample_rows).toArrow()
    seconds, rejected = {r.name: 1e-9 for r in rules}, {r.name: 0.0 for r in rules}
    for part in slices(few, "text"):
        view = View(Block.of(text_array(part)))
        rows = np.flatnonzero(~view.base_failed)
        for rule in rules:
            began = time.perf_counter()
            rejected[rule.name] += float(rule.rejects(view, rows).sum()) if len(rows) else 0.0
            seconds[rule.name] += time.perf_counter() - began
    return tuple(sorted(rules, key=lambda r: (-(rejected[r.name] + 1e-3) / seconds[r.name], r.name)))


def quality_figures(documents: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All columns of ``documents`` but its text, and the base figures and verdict of every text.

    Words are runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage
    return. A null or empty text has zeros and fails. Columns of ``documents`` that are named like a
    figure are replaced. Repeated rows are judged one by one.
    """
    names = {x.split()[0] for x in SCHEMA.split(", ")}
    carried = [c for c in documents.columns if c.lower() not in names | {"text"}]
    ordered = rule_order(documents, rules, sample_rows)
    source = documents.select(*carried, F.col("text").cast("string").alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                view = View(Block.of(text_array(part)))
                figures = [view.n_words, view.word_chars, view.n_symbols, view.n_dup_lines, view.n_repeat_words, view.base_failed,
                           cascade(view, ordered)]
                figures = [pa.array(x.astype(bool if x.dtype == bool else np.int64)) for x in figures]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), *figures],
                                                 names=[*carried, *(x.split()[0] for x in SCHEMA.split(", "))])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "text")
    return source.mapInArrow(judge, f"{fields}, {SCHEMA}" if fields else SCHEMA)


def passing(documents: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``documents`` whose text passes, with their columns as they were."""
    ordered = rule_order(documents, rules, sample_rows)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(cascade(View(Block.of(text_array(part))), ordered)))

    return documents.mapInArrow(keep, documents.schema)


REPORT_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts),
numbered AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM split),
runs AS (SELECT doc_id, i, word, lead(word, 1) OVER w AS b, lead(word, 2) OVER w AS c, lead(word, 3) OVER w AS d, lead(word, 4) OVER w AS e
  FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, word, b, c, d, e) AS n FROM runs WHERE e IS NOT NULL) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM twice CROSS JOIN (SELECT unnest(range(5)) AS j) GROUP BY doc_id),
tops AS (SELECT doc_id, max(n) AS top FROM (SELECT doc_id, word, count(*) AS n FROM numbered GROUP BY doc_id, word) GROUP BY doc_id),
figures AS (SELECT doc_id, text, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(lines) AS n_lines, coalesce(top, 0) AS top, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals,
    length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters, strlen(regexp_replace(text, '[\x00-@\[-`{-\x7F]', '', 'g')) AS wordlike
  FROM split LEFT JOIN covered USING (doc_id) LEFT JOIN tops USING (doc_id)),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM figures)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_dup_lines > 5 * n_lines
    OR 2 * capitals > letters OR 2 * wordlike < word_chars OR top > greatest(floor(0.3 * n_words), 1)) AS kept
FROM based
"""
