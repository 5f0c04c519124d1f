import itertools
import random
import re

import numpy as np
import pytest

import oracle
from helpers import WORD, docs, prose
from tracelode.llm import filter_audit as fa


def brute(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    parts = {}
    for i, text, lang in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = {x for x, bad in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                                             bool(re.search("[#$%&*|]", text)), i is not None and i > first[text])) if bad}
        good, toxic = (any(d == i and i is not None and x[k] == 1 for d, *x in labels) for k in (0, 1))
        parts.setdefault(lang or "", []).append((fails, good, toxic))
    out = []
    for part, own in parts.items():
        taken = {}
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                taken[f] = taken.get(f, 0) + len(gone)
                fails = [x for x in own if f in x[0]]
                out.append([part, "".join(order), step, len(left), len(gone), len(fails) - len(gone), sum(x[0] == {f} for x in own),
                            sum(x[1] for x in gone), sum(x[2] for x in gone), f])
        for row in out:
            if row[0] == part:
                row[-1] = taken[row[-1]]
    return sorted(map(tuple, out))


def got(frame, labels, **more):
    columns = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return sorted(tuple(r[c] for c in columns) for r in fa.interaction_report(frame, labels, **more).collect())


def test_sql_twin(spark):
    folder = "/root/testdata/sf0.01"
    frame = fa.interaction_report(*(spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels")))
    assert oracle.compare(oracle.duck(folder), fa.REPORT_SQL, frame) is None


@pytest.mark.parametrize("block_rows", [1, 7, fa.BLOCK_ROWS])
def test_against_brute_force(spark, block_rows):
    r = random.Random(block_rows)
    texts = [" ".join([prose(r.randrange(40), r.choice((5, 150, 230)), r.choice((30, 4000))), *r.choice(([], ["#"], ["AB" * 20]))]) for _ in range(160)]
    texts += [None, "", " ", None, texts[0], texts[0]]
    ids = [r.randrange(120) for _ in range(160)] + [None, 500, 501, 502, None, 7]
    frame = docs(spark, texts, ids=ids).drop("lang").join(docs(spark, texts, ids=ids).limit(0).select("lang"), how="left")
    rows = [(i, t, r.choice(("en", "de", "", None))) for i, t in zip(ids, texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    labels = [(i, r.choice((0, 1, None)), r.choice((0, 1, None))) for i in [*range(0, 120, 2), 4, 4, 900, None]]
    assert got(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), block_rows=block_rows) == brute(rows, labels)


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.interaction_report(docs(spark, []), none).count() == 0
    frame = docs(spark, ["w " * 300_000, "a"], ids=[1, 1]).withColumnRenamed("source", "digest").withColumnRenamed("n_chars", "first_id")
    rows = got(frame, none)
    assert len(rows) == 600 and [x[3:] for x in rows if x[1:3] == ("ABCDE", 2)] == [(0, 1, 0, 1, 0, 0, 120)]


def test_members_gallop():
    r = random.Random(1)
    for n, m, top in [(0, 5, 9), (5, 0, 9), (1, 1, 1), (300, 9000, 20_000), (9000, 300, 20_000), (5000, 5000, 5000), (700, 700, 10_000_000)]:
        a, b = (np.array(sorted(r.sample(range(top + 1), min(k, top + 1))), np.uint32) for k in (n, m))
        assert fa.members(a, b).tolist() == np.isin(a, b).tolist()
    lists = [np.array(sorted(r.sample(range(900), k)), np.uint32) for k in (0, 400, 20, 900, 300)]
    for k in range(6):
        assert fa.union_size(lists[:k]) == len(set().union(*(x.tolist() for x in lists[:k])))


def test_blocks_of_a_hot_part_are_bounded(spark):
    frame = docs(spark, ["x"] * 1000, ids=[3] * 1000, partitions=2)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    blocks = fa.posting_lists(fa.marked_documents(frame, none), 64).collect()
    assert sum(b.n_rows for b in blocks) == 1000 and max(b.n_rows for b in blocks) <= 64 and len(blocks) >= 16
    assert all(b.part == "en" and b.first_id == b.last_id == 3 and len(b.lists) == 7 and len(b.lists[0]) == 4 * b.n_rows for b in blocks)
