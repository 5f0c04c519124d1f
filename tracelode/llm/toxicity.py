"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insult, threat, target, negation, report, other. Four transducers are composed into
one: the first finds what is directed at a target, the second what is negated, the third what is
reported speech, the last weighs what comes out. The machine runs over every sentence that has an insult or
a threat. A comma or colon ends what is directed and denied, but not what is reported: it may introduce
speech, and a short part with a report after it reports what came before; a match counts by the weight of its word and what the grammar makes of it, so a word alone, a
denied or a quoted one, and one thrown at somebody count differently.

Words of insult are learned from labels: whole words and stems that toxic documents of the sample have
far more often than others. The document's matches are turned into a score by logistic regression on
held-apart halves of the same sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .blocks import Block, column, slices, text_array
from .labelled import remainder, sigmoid, training_sample

#: Labelled documents that words and weights are learned from, and learned words and stems, at most.
SAMPLE_ROWS, LEXICON_ROWS = 20_000, 5000
#: Bytes of a stem; shorter words are only taken whole.
STEMS = (4, 5, 6, 8)
#: A word is learned if its share of toxic documents is this surprising (in nats).
EVIDENCE = 11.0
NEAR = 4

# Words of the grammar that are not learned, in English, German, French and Spanish.
INSULTS = ("idiot", "stupid", "scum", "trash", "moron", "clown", "worthless", "pathetic", "disgusting", "loser", "dumb", "ugly", "fool", "filth",
           "dumm", "abschaum", "imbécile", "connard", "estúpido", "imbécil", "basura")
THREATS = ("kill", "hurt", "destroy", "beat", "burn", "shoot", "stab", "töten", "schlagen", "tuer", "frapper", "matar", "golpear")
TARGETS = ("you", "your", "he", "she", "they", "him", "her", "them", "these", "those", "du", "ihr", "sie", "dich", "tu", "vous", "toi", "ils", "tú", "usted", "ellos")
NEGATIONS = ("not", "no", "never", "isn't", "aren't", "don't", "nicht", "kein", "keine", "pas", "jamais", "nunca", "jamás")
REPORTS = ("said", "says", "called", "wrote", "claimed", "quoted", "sagte", "schrieb", "dit", "écrit", "dijo", "escribió")

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, MARK = "insult", "threat", "target", "negation", "report", "other", "mark"
_CLASSES = ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS))
_BREAK = np.zeros(256, bool)
_BREAK[[c for c in range(128) if not (chr(c).isalnum() or chr(c) == "'")]] = True
_CLAUSE = np.zeros(256, bool)
_CLAUSE[list(b".;!?\n")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b",:")] = True


@dataclass(frozen=True)
class Transducer:
    """Deterministic: ``arcs[state, symbol] = (output, weight, next state)``. State 0 begins. A symbol
    without an arc passes through with weight 1, to the state ``after`` names or the same."""

    arcs: dict = field(default_factory=dict)
    after: dict = field(default_factory=dict)

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (symbol, 1.0, self.after.get(state, state)))

    def then(self, other: "Transducer") -> "Transducer":
        """The composition: the output of this machine is the input of ``other``; weights multiply."""
        return _Composed(self, other)


@dataclass(frozen=True)
class _Composed(Transducer):
    first: Transducer = None
    second: Transducer = None

    def __init__(self, first, second):
        object.__setattr__(self, "first", first)
        object.__setattr__(self, "second", second)

    def step(self, state, symbol):
        a, b = state or (0, 0)
        out, weight, a = self.first.step(a, symbol)
        out, more, b = self.second.step(b, out)
        return out, weight * more, (a, b)


@cache
def grammar() -> Transducer:
    """What is directed, then what is denied, then what is reported, then weights."""
    near = range(NEAR + 1)
    aimed, after = {}, {}
    for k in near:  # k words are left in which a target counts as near; negative states wait for one
        aimed[k, TARGET] = (TARGET, 1.0, NEAR)
        for kind in (INSULT, THREAT):
            aimed[k, kind] = ((kind, "aimed") if k else (kind, "open"), 1.0, k if k else -NEAR)
        after[k] = max(0, k - 1)
    for k in range(1, NEAR + 1):
        aimed[-k, TARGET] = ("late target", 1.0, NEAR)
        for kind in (INSULT, THREAT):
            aimed[-k, kind] = ((kind, "open"), 1.0, -NEAR)
        after[-k] = -k + 1
    aimed |= {(k, MARK): (MARK, 1.0, 0) for k in range(-NEAR, NEAR + 1)}
    matches = [(kind, way) for kind in (INSULT, THREAT) for way in ("aimed", "open")]
    denied = {(k, NEGATION): (NEGATION, 1.0, NEAR) for k in near}
    denied |= {(k, MARK): (MARK, 1.0, 0) for k in near}
    denied |= {(k, m): ((*m, "denied"), 1.0, k - 1) for k in near if k for m in matches}
    reported = {(0, REPORT): (REPORT, 1.0, 1)} | {(1, m): ((*m, "reported"), 1.0, 1) for m in matches}
    weights = {(INSULT, "aimed"): 1.5, (INSULT, "open"): 1.0, (THREAT, "aimed"): 1.0, (THREAT, "open"): 0.0, "late target": 0.5}
    weighed = {(0, m): ("match", w, 0) for m, w in weights.items()} | {(0, (*m, "denied")): ("match", 0.3 * weights[m], 0) for m in matches}
    weighed |= {(0, (*m, "reported")): ("match", 0.5 * weights[m], 0) for m in matches}
    first = Transducer(aimed, after)
    return first.then(Transducer(denied, {k: max(0, k - 1) for k in near})).then(Transducer(reported)).then(Transducer(weighed))


def reports_first(symbols: list[str], weights: list[float]) -> tuple[list[str], list[float]]:
    """The symbols with a report before each part that a short part with a report follows, read from the right."""
    out, weighed, part, short = [], [], 0, False
    for k in range(len(symbols) - 1, -1, -1):
        if symbols[k] == MARK:
            if short:
                out.append(REPORT)
                weighed.append(0.0)
            short = part <= NEAR and REPORT in symbols[k + 1:k + 1 + part]
            part = -1
        out.append(symbols[k])
        weighed.append(weights[k])
        part += 1
    if short:
        out.append(REPORT)
        weighed.append(0.0)
    return out[::-1], weighed[::-1]


def clause_score(symbols: list[str], weights: list[float]) -> float:
    """The sum over matches of what the grammar gives times the word's weight; a target that comes after its
    insult adds to the last match."""
    machine, state, total, last = grammar(), 0, 0.0, 0.0
    if MARK in symbols and REPORT in symbols:
        symbols, weights = reports_first(symbols, weights)
    for symbol, weight in zip(symbols, weights):
        out, factor, state = machine.step(state, symbol)
        if out == "match":
            last = weight if symbol != TARGET else last
            total += factor * last
    return total


def _hash(words) -> np.ndarray:
    block = Block.of_list(list(words))
    return block.span_hashes(block.bounds[:-1], block.bounds[1:])


@dataclass
class Lexicon:
    """Sorted hashes of words and stems with their weights."""

    hashes: np.ndarray
    weights: np.ndarray

    def look_up(self, found: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(found))
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        return np.where(self.hashes[at] == found, self.weights[at], 0.0)


def _lexicon(hashes: np.ndarray, weights: np.ndarray) -> Lexicon:
    seeds = _hash(INSULTS)
    hashes, weights = np.concatenate([hashes, seeds]), np.concatenate([weights, np.full(len(seeds), 3.0)])
    order = np.lexsort((-weights, hashes))
    hashes, weights = hashes[order], weights[order]
    first = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    return Lexicon(hashes[first], weights[first])


def _words(texts: pa.Array):
    block = Block.of(pc.utf8_lower(texts))
    return block, block.words(_BREAK)


def _forms(words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, word numbers) of whole words and of each kind of stem."""
    size, prefix = words.ends - words.starts, words.block.prefix_hashes()
    out = [(words.block.span_hashes(words.starts, words.ends, prefix), np.arange(len(size)))]
    for n in STEMS:
        at = np.flatnonzero(size > n)
        out.append((words.block.span_hashes(words.starts[at], words.starts[at] + n, prefix) + np.uint64(n), at))
    return out


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """Per text: sum, greatest and number of matching sentences, and matches for each hundred words."""
    block, words = _words(texts)
    n = len(block)
    weight = np.zeros(len(words.starts))
    forms = _forms(words)
    for found, at in forms:
        found = lexicon.look_up(found)
        hit = np.flatnonzero(found)
        weight[at[hit]] = np.maximum(weight[at[hit]], found[hit])
    symbol = np.where(weight > 0, 0, 5)
    names = [INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER]
    soft = np.concatenate([[0], np.cumsum(_MARK[block.data])])
    for name, list_ in _CLASSES:
        known = Lexicon(np.sort(_hash(list_)), np.ones(len(list_)))
        symbol[(known.look_up(forms[0][0]) > 0) & (weight == 0)] = names.index(name)
    weight[symbol == 1] = 2.0
    marks = np.concatenate([[0], np.cumsum(_CLAUSE[block.data])])
    text = words.texts()
    new = np.ones(len(words.starts), bool)
    new[1:] = (marks[words.starts[1:]] != marks[words.starts[:-1]]) | (text[1:] != text[:-1])
    clause = np.cumsum(new) - 1
    starts = np.append(np.flatnonzero(new), len(clause))
    out = np.zeros((n, 4))
    for c in np.unique(clause[symbol <= 1]):
        lo, hi = starts[c], starts[c + 1]
        score = clause_score(*_with_marks([names[s] for s in symbol[lo:hi]], weight[lo:hi].tolist(), soft[words.starts[lo:hi]].tolist()))
        if score > 0:
            row = out[text[lo]]
            row += (score, 0, 1, 0)
            row[1] = max(row[1], score)
    out[:, 3] = 100 * out[:, 2] / np.maximum(words.counts(), 1)
    return np.column_stack([np.log1p(out[:, 0]), out[:, 1], np.log1p(out[:, 2]), np.minimum(out[:, 3], 10)])


def _with_marks(symbols: list[str], weights: list[float], marks: list[int]) -> tuple[list[str], list[float]]:
    """A mark between words that a comma or colon parts; ``marks`` counts them up to each word."""
    if marks[0] == marks[-1]:
        return symbols, weights
    out, weighed = [], []
    for k, symbol in enumerate(symbols):
        if k and marks[k] != marks[k - 1]:
            out.append(MARK)
            weighed.append(0.0)
        out.append(symbol)
        weighed.append(weights[k])
    return out, weighed


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(form, half, toxic, clean): documents of each half of the sample that have a word or stem."""
    for batch in batches:
        for part in slices(batch, "text"):
            block, words = _words(text_array(part))
            text, forms = words.texts(), _forms(words)
            form, doc = np.concatenate([h for h, _ in forms]), np.concatenate([text[at] for _, at in forms])
            order = np.lexsort((doc, form))
            form, doc = form[order], doc[order]
            new = np.concatenate([[True], (form[1:] != form[:-1]) | (doc[1:] != doc[:-1])]) if len(form) else np.zeros(0, bool)
            form, doc = form[new], doc[new]
            toxic, half = column(part, "label")[doc] == 1, column(part, "half")[doc]
            key = np.concatenate([[True], form[1:] != form[:-1]]) if len(form) else np.zeros(0, bool)
            at = np.flatnonzero(key)
            if len(at):
                counts = [np.add.reduceat(((half == h) & (toxic == t)).astype(np.int64), at) for h in (0, 1) for t in (True, False)]
                yield pa.RecordBatch.from_arrays([pa.array(form[at].view(np.int64)), *map(pa.array, counts)], names=["form", "t0", "c0", "t1", "c1"])


def _weights(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> tuple[np.ndarray, np.ndarray]:
    """(evidence, weight) of words by the documents that have them."""
    n, base = toxic + clean, max(n_toxic, 0.5) / max(n_toxic + n_clean, 1)
    share = np.clip(toxic / np.maximum(n, 1), 1e-9, 1 - 1e-9)
    base = min(base, 1 - 1e-6)
    surprise = n * (share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base)))
    weight = np.log((toxic + 0.5) / (n_toxic + 1) / ((clean + 0.5) / (n_clean + 1)))
    return np.where(share > base, surprise, 0.0), np.minimum(weight, 6.0)


def _regression(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-damped logistic regression by Newton's method; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    if len(y):
        damp = np.diag([0.1] * (x.shape[1] - 1) + [1e-3])
        for _ in range(30):
            p = sigmoid(x @ w)
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + damp, x.T @ (p - y) + damp @ w)
            w -= np.clip(step, -3, 3)
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        return sigmoid(features(texts, self.lexicon) @ self.weights[:-1] + self.weights[-1])


def train(documents: DataFrame, labels: DataFrame, label: str, usable, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Without labelled documents the score is one half for a text without matches, and more with them."""
    sample = training_sample(documents, labels, label, usable, sample_rows)
    # Of equal texts the least id counts: it decides the half, so reruns agree.
    sample = sample.groupBy("label", "text").agg(F.min("doc_id").alias("doc_id")).withColumn("half", (F.xxhash64("doc_id", F.lit(1)) % 2 == 0).cast("int"))
    sizes = {(r["half"], r["label"]): r["count"] for r in sample.groupBy("half", "label").count().collect()}
    counted = sample.repartition(sample.sparkSession.sparkContext.defaultParallelism).mapInArrow(_counted, "form bigint, t0 bigint, c0 bigint, t1 bigint, c1 bigint")
    sums = counted.groupBy("form").agg(*(F.sum(c).alias(c) for c in ("t0", "c0", "t1", "c1"))).where("t0 + t1 >= 2 and (t0 + t1) * 2 > c0 + c1")
    # The likeliest words; how many is bounded, whatever the input.
    rows = sums.orderBy(F.desc(F.expr("(t0 + t1) - 2 * (c0 + c1)")), "form").limit(4 * LEXICON_ROWS).toArrow()
    forms = rows.column("form").to_numpy().view(np.uint64)
    t0, c0, t1, c1 = (rows.column(c).to_numpy() for c in ("t0", "c0", "t1", "c1"))

    def learned(toxic, clean, halves) -> Lexicon:
        evidence, weight = _weights(toxic, clean, sum(sizes.get((h, 1), 0) for h in halves), sum(sizes.get((h, 0), 0) for h in halves))
        best = np.argsort(-evidence, kind="stable")[:LEXICON_ROWS]
        best = best[(evidence[best] >= EVIDENCE) & (weight[best] > 1)]
        return _lexicon(forms[best], weight[best])

    halves = {0: learned(t1, c1, (1,)), 1: learned(t0, c0, (0,))}  # of each half by what the other one taught

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                half = column(part, "half")
                x = np.where((half == 0)[:, None], features(text_array(part), halves[0]), features(text_array(part), halves[1]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), *(pa.array(x[:, k]) for k in range(4))],
                                                 names=["doc_id", "label", "a", "b", "c", "d"])

    kind = dict(sample.dtypes)["doc_id"]
    table = sample.mapInArrow(describe, f"doc_id {kind}, label int, a double, b double, c double, d double").toArrow().sort_by("doc_id")
    x = np.column_stack([table.column(c).to_numpy() for c in "abcd"])
    weights = _regression(x, table.column("label").to_numpy().astype(float)) if len(x) else np.array([0.5, 0.5, 0.5, 0.5, 0.0])
    return Model(learned(t0 + t1, c0 + c1, (0, 1)), weights)


def toxicity_scores(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. Only labels of rows that aren't held out (crc32 of the
    id modulo 5 is 0) are learned from; the text is the only input of a score. A null text is empty. Rows may repeat."""
    model = train(documents, labels, "toxic", remainder("doc_id", 5) != 0, sample_rows)
    texts = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                score = model.scores(text_array(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                                                 names=["doc_id", "score", "predicted"])

    rows = texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, score double, predicted int")
    return rows.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
