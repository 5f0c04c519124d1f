import hashlib
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

import oracle
from helpers import docs, prose
from pyspark.sql import functions as F
from tracelode.llm import fill_in_middle as fim

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i:8 * i + 8], 16) for i in range(4)]
    tokens = TOKEN.findall(text)
    n, output, figures, form = len(tokens), text, (None, None), "plain"
    if text and not any(m in text for m in ("<P>", "<S>", "<M>")) and h[2] % 100 < 90:
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
        form = "spm" if h[3] % 100 < 20 else "psm"
        output, figures = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}", (len(p), len(m))
    return (doc_id, n, form, *figures, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def rows(frame):
    return sorted(map(tuple, fim.fill_report(frame).collect()), key=repr)


def test_sql_twin(spark):
    con = oracle.duck("/root/testdata/sf0.01")
    assert oracle.compare(con, fim.REPORT_SQL, fim.fill_report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))) is None


def test_whole_table_against_brute_force(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    want = [brute(r["doc_id"], r["text"]) for r in pq.read_table(path, columns=["doc_id", "text"]).to_pylist()]
    assert rows(spark.read.parquet(path)) == sorted(want, key=repr)


@pytest.mark.parametrize("stretch,segment", [(1, 3), (7, 2), (1 << 20, 1 << 14), (64, 1000)])
def test_index_gives_every_boundary(stretch, segment):
    r = random.Random(5)
    for text in ["", "a", "ß", "x" * 5000 + " y" * 3000, prose(1, 400), "🙂é. " * 500, "".join(r.choice("ab \n😀é9") * r.choice((1, 1, 400)) for _ in range(900))]:
        data = np.frombuffer(text.encode(), np.uint8)
        index = fim.RankIndex(fim.boundaries(data, stretch), segment)
        at, want = 0, [0] if text else [0]
        for token in TOKEN.findall(text):
            at += len(token.encode())
            want.append(at)
        assert [index[k] for k in range(len(index))] == want
        assert index.residuals.dtype == np.int8 and max(index.firsts[1:] or [1]) <= len(index)


def test_regular_text_needs_one_segment_a_stretch():
    index = fim.RankIndex(fim.boundaries(np.frombuffer(b"abc " * 100_000, np.uint8)))
    assert len(index) == 200_001 and len(index.firsts) <= 200_001 // fim.SEGMENT + 2


def test_odd_rows(spark):
    assert fim.fill_report(docs(spark, [])).count() == 0
    texts = [None, "", "a<P>b" * 9, "<M>", "<S>" + "x" * 40, "<" * 30, "P>S>M>" * 9, "<P" * 12, "🙂ß" * 50, "same text here", "same text here", "\n\r\t ", "a" * 300_000 + " b" * 9000]
    ids = [None, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9, -3, 11]
    frame = docs(spark, texts, ids=ids).withColumnRenamed("lang", "output").withColumnRenamed("n_chars", "form")
    assert rows(frame) == sorted((brute(i, t) for i, t in zip(ids, texts)), key=repr)
    made = fim.fill_in_middle(frame)
    assert sorted(made.columns) == sorted(["doc_id", "source", "text", *(x.split()[0] for x in fim.SCHEMA.split(", "))])
    assert made.count() == len(texts)


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_marks_beside_parts_of_marks(spark, form):
    parts = ["", "<", "<P", "<S", "P>", ">", "<<", "M>x", "ß<M"]
    made = [(p + m + s, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}") for p in parts for m in parts for s in parts
            if not any(x in p + m + s for x in ("<P>", "<S>", "<M>"))]
    frame = spark.createDataFrame(made, "text string, output string")
    assert frame.where(fim.restored(F.col("output"), F.lit(form)) != F.col("text")).count() == 0 and len(made) > 300
