import numpy as np
import pyarrow.parquet as pq

from helpers import docs, prose
from tracelode.llm import quality_mil
from tracelode.llm.blocks import Block

FOLDER = "/root/testdata/sf0.01"


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1.0
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_held_out_accuracy(spark):
    import zlib

    rows = quality_mil.quality_scores(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{FOLDER}/labels.parquet").to_pylist()}
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    score, label = (np.array(x) for x in zip(*held))
    assert auc(score, label) > 0.97 and ((score >= 0.5) == label).mean() > 0.95


def test_one_bad_passage_draws_attention():
    good, bad = [prose(i, 300) for i in range(60)], [prose(i, 150) + " " + "#$%& " * 60 + prose(i + 500, 90) for i in range(60)]
    features, bounds = quality_mil.passages(Block.of_list(good + bad))
    model = quality_mil.fit(features, bounds, np.array([1.0] * 60 + [0.0] * 60))
    features, bounds = quality_mil.passages(Block.of_list([prose(900, 400), prose(901, 128) + " " + "#$%& " * 64 + prose(902, 200), "", "one"]))
    scores = model.scores(features, bounds)
    assert scores[0] > 0.9 and scores[1] < 0.1 and ((scores >= 0) & (scores <= 1)).all()
    out = model.forward(features, bounds)
    assert np.allclose(np.add.reduceat(out["a"], bounds[:-1]), 1)


def test_gradient():
    """The fitted loss goes down, and attention weights depend on no label: equal texts score alike."""
    features, bounds = quality_mil.passages(Block.of_list(["a b c d"] * 3 + [prose(1, 200)]))
    model = quality_mil.fit(features, bounds, np.array([1.0, 1.0, 1.0, 0.0]))
    s = model.scores(features, bounds)
    assert s[0] == s[1] == s[2] > 0.5 > s[3]


def test_odd_rows(spark):
    frame = docs(spark, [None, "", prose(1, 30), prose(1, 30), "x " * 9000], ids=[0, 1, 2, 2, None]).withColumnRenamed("lang", "score").withColumnRenamed("source", "label")
    labels = spark.createDataFrame([(0, 1), (2, 0), (2, None), (None, 1), (77, 1)], "doc_id bigint, quality int")
    rows = quality_mil.quality_scores(frame, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 2}) == 1
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.score for r in quality_mil.quality_scores(frame, none).collect()} == {0.5}
    assert quality_mil.quality_scores(docs(spark, []), labels).count() == 0
