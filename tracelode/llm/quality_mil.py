"""Quality classifier: gated-attention multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Every passage is described by its surface
(word lengths, capitals, symbols, repetition) and by hashed words, and encoded by a learned layer. Gated
attention, learned from document labels only, weighs the encodings; the weighted sum is scored. The model
is fitted with Adam on a bounded sample of labelled documents; scoring covers every passage of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import U64, Block, mix, slices, text_array
from .labelled import remainder, sigmoid, training_sample

PASSAGE_WORDS = 64
HASHED = 32
#: Labelled documents that the model is fitted on, at most.
SAMPLE_ROWS = 4000
HIDDEN, GATES = 16, 8
EPOCHS, BATCH, RATE, DECAY = 30, 64, 0.01, 1e-4


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.float32)
    out[list(chars)] = 1
    return out


_KINDS = np.stack([_flags(bytes(range(65, 91))), _flags(bytes(range(97, 123))), _flags(b"0123456789"), _flags(b"#*$%&|<>"),
                   _flags(b"!?"), _flags(b".,;:"), _flags(bytes(range(128, 256))), _flags(b"/\\@=_{}[]()")])
N_FEATURES = len(_KINDS) + 9 + HASHED


def passages(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, bounds by text). A text without words is one passage of zeros."""
    words = block.words()
    counts = words.counts()
    per_text = np.maximum(-(-counts // PASSAGE_WORDS), 1)
    bounds = np.concatenate([[0], np.cumsum(per_text)])
    out = np.zeros((bounds[-1], N_FEATURES), np.float32)
    if not len(words.starts):
        return out, bounds
    text = words.texts()
    nth = np.arange(len(text)) - words.of[:-1][text]
    passage = bounds[:-1][text] + nth // PASSAGE_WORDS
    first = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    owner, n = passage[first], np.diff(np.append(first, len(passage))).astype(np.float32)
    length = (words.ends - words.starts).astype(np.float32)
    hashes = words.hashes()
    chars = np.add.reduceat(length, first)
    for k, flags in enumerate(_KINDS):
        total = np.zeros(len(block.data) + 1)
        np.cumsum(flags[block.data], out=total[1:])
        out[owner, k] = np.add.reduceat(total[words.ends] - total[words.starts], first) / chars
    at = len(_KINDS)
    same = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])])
    back = np.concatenate([[False, False], (hashes[2:] == hashes[:-2]) & (text[2:] == text[:-2])])[:len(hashes)]
    mean = chars / n

    def distinct(group: np.ndarray) -> np.ndarray:
        key = mix(hashes + mix(group.astype(U64) + U64(1)))
        order = np.argsort(key, kind="stable")
        new = np.ones(len(key), bool)
        new[order[1:]] = key[order][1:] != key[order][:-1]
        return new

    within, anew = distinct(passage), distinct(text)
    rest = (mean / 10, np.sqrt(np.maximum(np.add.reduceat(length ** 2, first) / n - mean ** 2, 0)) / 10, np.add.reduceat(same, first) / n,
            np.add.reduceat(back, first) / n, np.add.reduceat(within, first) / n, np.add.reduceat(anew, first) / n, n / PASSAGE_WORDS,
            np.maximum.reduceat(length, first) / 50, np.add.reduceat(length <= 2, first) / n)
    for k, values in enumerate(rest):
        out[owner, at + k] = values
    bins = (hashes % U64(HASHED)).astype(np.int64)
    out[:, at + len(rest):] = np.bincount(passage * HASHED + bins, minlength=len(out) * HASHED).reshape(len(out), HASHED) / np.maximum(np.bincount(passage, minlength=len(out)), 1)[:, None]
    return out, bounds


@dataclass
class Model:
    """Encoder, attention (tanh and sigmoid gates) and scorer."""

    mean: np.ndarray
    scale: np.ndarray
    parameters: dict[str, np.ndarray]

    def forward(self, features: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
        p, x = self.parameters, np.clip((features - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["encode"] + p["encode_0"])
        v, u = np.tanh(h @ p["tanh"] + p["tanh_0"]), sigmoid(h @ p["gate"] + p["gate_0"])
        e = (v * u) @ p["attend"]
        start, size = bounds[:-1], np.diff(bounds)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, start), size))
        a = e / np.repeat(np.add.reduceat(e, start), size)
        z = np.add.reduceat(a[:, None] * h, start)
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "logit": z @ p["score"] + p["score_0"][0]}

    def scores(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return sigmoid(self.forward(features, bounds)["logit"]) if len(bounds) > 1 else np.zeros(0)


def fit(features: np.ndarray, bounds: np.ndarray, labels: np.ndarray, seed: int = 11) -> Model:
    """Adam on the logistic loss of the document labels. Without documents every score is one half; with one
    kind of label only, the model learns little more than that label."""
    r = np.random.Generator(np.random.PCG64(seed))
    shape = {"encode": (N_FEATURES, HIDDEN), "encode_0": (HIDDEN,), "tanh": (HIDDEN, GATES), "tanh_0": (GATES,), "gate": (HIDDEN, GATES), "gate_0": (GATES,),
             "attend": (GATES,), "score": (HIDDEN,), "score_0": (1,)}
    p = {k: (np.zeros(s) if k.endswith("_0") else r.normal(0, 1 / np.sqrt(s[0]), s)).astype(np.float32) for k, s in shape.items()}
    if not len(labels):
        p["score"] = np.zeros_like(p["score"])
        return Model(np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32), p)
    model = Model(features.mean(axis=0), features.std(axis=0) + 1e-3, p)
    first, second, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for _ in range(EPOCHS):
        order = r.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            docs = np.sort(order[at:at + BATCH])
            size = np.diff(bounds)[docs]
            own = np.concatenate([[0], np.cumsum(size)])
            rows = np.repeat(bounds[:-1][docs] - own[:-1], size) + np.arange(own[-1])
            f = model.forward(features[rows], own)
            d = (sigmoid(f["logit"]) - labels[docs]) / len(docs)
            dz = np.repeat(d[:, None] * p["score"], size, axis=0)
            da = (dz * f["h"]).sum(axis=1)
            de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, own[:-1]), size))
            dv, du = de[:, None] * p["attend"] * f["u"] * (1 - f["v"] ** 2), de[:, None] * p["attend"] * f["v"] * f["u"] * (1 - f["u"])
            dh = f["a"][:, None] * dz + dv @ p["tanh"].T + du @ p["gate"].T
            dx = dh * (1 - f["h"] ** 2)
            g = {"encode": f["x"].T @ dx, "encode_0": dx.sum(axis=0), "tanh": f["h"].T @ dv, "tanh_0": dv.sum(axis=0), "gate": f["h"].T @ du, "gate_0": du.sum(axis=0),
                 "attend": de @ (f["v"] * f["u"]), "score": d @ f["z"], "score_0": np.array([d.sum()])}
            step += 1
            for k in p:
                grad = g[k] + DECAY * p[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad ** 2
                p[k] = (p[k] - RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return model


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            features, bounds = passages(Block.of(text_array(part)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("label"), pa.array([features[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())],
                names=["doc_id", "label", "features"])


def train(documents: DataFrame, labels: DataFrame, label: str, usable, sample_rows: int = SAMPLE_ROWS) -> Model:
    sample = training_sample(documents, labels, label, usable, sample_rows)
    rows = sample.mapInArrow(_described, f"doc_id {dict(sample.dtypes)['doc_id']}, label int, features binary").toArrow().sort_by("doc_id")
    each = [np.frombuffer(x, np.float32).reshape(-1, N_FEATURES) for x in rows.column("features").to_pylist()]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
    features = np.concatenate(each) if each else np.zeros((0, N_FEATURES), np.float32)
    return fit(features, bounds, rows.column("label").to_numpy().astype(np.float32))


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every row by the model; a null text is empty."""
    texts = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                score = model.scores(*passages(Block.of(text_array(part)))).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                                                 names=["doc_id", "score", "predicted"])

    return texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, score double, predicted int")


def quality_scores(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. Only labels of rows that aren't held out (crc32 of the
    id modulo 3 is not 1) are learned from; the text is the only input of a score. Rows may repeat."""
    model = train(documents, labels, "quality", remainder("doc_id", 3) != 1, sample_rows)
    return scored(documents, model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
