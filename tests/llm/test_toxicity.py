import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from helpers import docs, prose
from tracelode.llm import toxicity as tox


def score(text):
    words = text.lower().split()
    kinds = {w: k for k, list_ in tox._CLASSES for w in list_} | {w: tox.INSULT for w in tox.INSULTS}
    return tox.clause_score([kinds.get(w, tox.OTHER) for w in words], [1.0 if kinds.get(w) == tox.INSULT else 2.0 if kinds.get(w) == tox.THREAT else 0.0 for w in words])


def test_grammar_ranks_clauses():
    assert score("you are an idiot") > score("what an idiot thing") > score("you are not an idiot") > 0
    assert score("idiot that you are") > score("idiot that it is")
    assert score("they said you idiot") < score("you idiot")
    assert score("you i will kill") > score("i will kill you") > score("kill the light") == 0
    assert score("nothing to see here") == 0


def test_composition_is_one_machine_after_the_other():
    first = tox.Transducer({(0, "a"): ("b", 2.0, 1), (1, "a"): ("c", 1.0, 0)})
    second = tox.Transducer({(0, "b"): ("x", 3.0, 0), (0, "c"): ("y", 5.0, 0)})
    machine, state, out = first.then(second), 0, []
    for symbol in "aaza":
        symbol, weight, state = machine.step(state, symbol)
        out.append((symbol, weight))
    assert out == [("x", 6.0), ("y", 5.0), ("z", 1.0), ("x", 6.0)]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.1"])
def test_held_out_accuracy(spark, folder):
    rows = tox.toxicity_scores(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) > 0.98
    assert np.mean([p for p, y in held if y]) > 0.9 and np.mean([p for p, y in held if not y]) < 0.01


def test_learned_words_and_stems(spark):
    r, texts, labels = random.Random(2), [], []
    for i in range(240):
        words = prose(i, 60).split()
        if i % 4 == 0:
            words[r.randrange(60)] = "grumbl" + r.choice(["er", "ing", "eth", "ist"])
        texts.append(" ".join(words))
        labels.append((i, int(i % 4 == 0)))
    texts += ["a grumblezz " + prose(900, 30), prose(901, 30), "GRUMBLER! " + prose(902, 20)]
    rows = {x.doc_id: x for x in tox.toxicity_scores(docs(spark, texts), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()}
    assert [rows[i].predicted for i in (240, 241, 242)] == [1, 0, 1]


def test_odd_rows(spark):
    frame = docs(spark, [None, "", "you idiot", "you idiot", "fine words " * 5000], ids=[0, 1, 2, 2, None]).withColumnRenamed("lang", "half").withColumnRenamed("source", "label")
    labels = spark.createDataFrame([(0, 0), (2, 1), (2, None), (None, 1)], "doc_id bigint, toxic int")
    rows = tox.toxicity_scores(frame, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id == 2}) == 1
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    by = {r.doc_id: r.score for r in tox.toxicity_scores(frame, none).collect()}
    assert by[2] > by[0] == by[1] == 0.5
    assert tox.toxicity_scores(docs(spark, []), labels).count() == 0
    assert tox.features(pa.array(["É idiot, idiot."]), tox._lexicon(np.zeros(0, np.uint64), np.zeros(0))).shape == (1, 4)
