import random

import pyarrow.parquet as pq
import pytest

from helpers import docs, prose, shingles
from tracelode.llm import jaccard_forest
from tracelode.llm.components import components


def brute(rows):
    """{doc_id: (class, links)} by comparing every two documents that share a shingle."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links, done = dict.fromkeys(sets, 0), set()
    for found in by.values():
        for n, i in enumerate(found):
            for j in found[n + 1:]:
                if (i, j) not in done:
                    done.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                        links[i] += 1
                        links[j] += 1
                        a, b = sorted((root(i), root(j)))
                        parent[b] = a
    return {i: (root(i), links[i]) for i in sets}


def got(frame):
    return {r.doc_id: (r.class_id, r.n_links) for r in frame.collect()}


def test_whole_table_against_brute_force(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = pq.read_table(path, columns=["doc_id", "text"]).to_pylist()
    assert got(jaccard_forest.near_duplicates(spark.read.parquet(path))) == brute([(r["doc_id"], r["text"]) for r in rows])


def edited(words, share, r):
    return " ".join(f"x{r.randrange(10 ** 9)}" if r.random() < share else w for w in words)


def test_hot_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard_forest, "TILE", 16)
    r, base = random.Random(3), prose(1, 150).split()
    texts = [edited(base, r.choice([0, 0.01, 0.02, 0.03]), r) for _ in range(150)] + [" ".join(base)] * 60 + [prose(i + 50, 80) for i in range(40)]
    r.shuffle(texts)
    want = brute(list(enumerate(texts)))
    have = got(jaccard_forest.near_duplicates(docs(spark, texts)))
    assert have == want


def test_odd_rows(spark):
    texts = [None, "", " \n\t", "one two", "one  two", "two one", "one two", prose(9, 30), prose(9, 30), None]
    frame = docs(spark, texts, ids=[0, 1, 2, 3, 4, 5, 6, 7, 8, None])
    have = got(jaccard_forest.near_duplicates(frame.withColumnRenamed("lang", "label").withColumnRenamed("source", "id")))
    assert have == {0: (0, 0), 1: (1, 0), 2: (2, 0), 3: (3, 2), 4: (3, 2), 5: (5, 0), 6: (3, 2), 7: (7, 1), 8: (7, 1), None: (None, 0)}
    kept = jaccard_forest.one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in (0, 1, 2, 3, 5, 7)] + [(True, 0)]
    assert jaccard_forest.near_duplicates(docs(spark, [])).count() == 0
    assert jaccard_forest.one_of_each(docs(spark, [])).count() == 0


def test_repeated_rows_stay_once(spark):
    frame = docs(spark, ["a b c d e f"] * 3, ids=[7, 7, 7])
    assert [r.doc_id for r in jaccard_forest.one_of_each(frame).collect()] == [7]


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(70)], [(0, i) for i in range(1, 90)], [(1, 2), (3, 4), (4, 9), (9, 3), (5, 5)], []])
def test_components(spark, edges):
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {(r.id, r.label) for r in components(frame).collect()} == {(i, root(i)) for i in linked}
