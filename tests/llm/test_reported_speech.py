"""Reported speech over commas, colons and quotation marks, through the features of whole texts."""

import numpy as np
import pyarrow as pa

from helpers import docs, prose
from tracelode.llm import toxicity as tox


def greatest(text):
    return tox.features(pa.array([text]), tox._lexicon(np.zeros(0, np.uint64), np.zeros(0)))[0, 1]


def test_plain_above_reported_above_denied():
    plain, denied = greatest("you are an idiot"), greatest("you are not an idiot")
    for reported in ("he said you are an idiot", "he said, you are an idiot", 'he said: "you are an idiot"', "you are an idiot, he said",
                     '"you are an idiot", wrote the old man'):
        assert plain > greatest(reported) > denied, reported


def test_marks_end_aim_and_denial():
    assert greatest("you, an idiot") == greatest("an idiot") < greatest("you idiot")
    assert greatest("not now, you idiot") == greatest("you idiot")
    assert greatest("he said so. you idiot") == greatest("you idiot")
    # A long part with a report reports nothing that came before it.
    assert greatest("you idiot, and after that came the letter in which she wrote of rain") == greatest("you idiot")


def test_equal_texts_decide_by_their_least_id(spark):
    texts = [prose(i % 20, 40) + (" you grumbler" if i % 4 == 0 else "") for i in range(80)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id bigint, toxic int")
    frame = docs(spark, texts)
    scores = [sorted((r.doc_id, r.score) for r in tox.toxicity_scores(frame.repartition(n), labels).collect()) for n in (1, 7)]
    assert scores[0] == scores[1]
