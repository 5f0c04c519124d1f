import hashlib
import random

import pyarrow.parquet as pq
import pytest

from helpers import docs, prose
from tracelode.llm import suffix_dedup


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for i, d in enumerate(data):
        for p in range(len(d) - length + 1):
            seen.setdefault(hashlib.blake2b(d[p:p + length], digest_size=16).digest(), []).append((i, p))
    cover = [bytearray(len(d)) for d in data]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                cover[i][p] = 1
    out = []
    for d, c in zip(data, cover):
        until, spans, kept, before = 0, 0, bytearray(), False
        for p in range(len(d)):
            if c[p]:
                until = p + length
            spans += p < until and not before
            before = p < until
            if not before:
                kept.append(d[p])
        out.append((len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def got(frame):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect())


def want(ids, texts, length):
    return sorted((i is None, i or 0, *x) for i, x in zip(ids, brute(texts, length)))


def test_whole_table_against_brute_force(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = pq.read_table(path, columns=["doc_id", "text"]).to_pylist()
    assert got(suffix_dedup.repeated_strings(spark.read.parquet(path))) == want([r["doc_id"] for r in rows], [r["text"] for r in rows], 400)


@pytest.mark.parametrize("seed,paired,local", [(0, 64, 50_000), (1, 3, 50_000), (2, 2, 5), (3, 64, 50_000)])
def test_edges_of_passages(spark, monkeypatch, seed, paired, local):
    monkeypatch.setattr(suffix_dedup, "PAIRED_KINDS", paired)
    monkeypatch.setattr(suffix_dedup, "LOCAL_KINDS", local)
    r = random.Random(seed)
    passages = ["".join(r.choice("abcdé ") for _ in range(n)) for n in (38, 39, 40, 41, 60, 130, 20)]
    texts = []
    for i in range(70):
        parts = ["".join(r.choice("xyzw🙂") for _ in range(r.randrange(30)))]
        for _ in range(r.randrange(4)):
            p = r.choice(passages)
            a = r.choice([0, 0, r.randrange(len(p))])
            parts += [p[a:] if r.random() < 0.7 else p[:len(p) - a], "".join(r.choice("xyzw") for _ in range(r.choice([0, 1, 5, 50])))]
        texts.append("".join(parts))
    texts += ["ab" * 90, "ab" * 21, "a" * 39, "b" * 40, "c" * 41, texts[3], "q" * 39 + "p" + "q" * 39]
    ids = list(range(len(texts)))
    assert got(suffix_dedup.repeated_strings(docs(spark, texts), length=40, gram=20)) == want(ids, texts, 40)


def test_odd_rows(spark):
    long = prose(1, 200)
    texts, ids = [None, "", "short", long, long, long, long[:399], "é" * 300, long], [0, 1, 2, 3, 3, None, 4, 5, 9]
    frame = docs(spark, texts, ids=ids).withColumnRenamed("lang", "k").withColumnRenamed("source", "gram").withColumnRenamed("n_chars", "t")
    assert got(suffix_dedup.repeated_strings(frame)) == want(ids, texts, 400)
    kept = {r.n_bytes: bytes(r.kept) for r in suffix_dedup.repeated_strings(frame, cut_text=True).collect()}
    assert kept[5] == b"short" and kept[len(long)] == b""
    assert suffix_dedup.repeated_strings(docs(spark, [])).count() == 0


def test_mergesort_orders_suffixes():
    import numpy as np

    r = random.Random(4)
    contexts = ["".join(r.choice("ab") for _ in range(r.randrange(20, 60))).encode() for _ in range(300)]
    before = np.array([r.randrange(0, 20) for _ in contexts])
    group = np.sort(np.array([r.randrange(40) for _ in contexts]))
    s = suffix_dedup.Suffixes(before, contexts, 40, 20)
    want = sorted(range(300), key=lambda i: (group[i], contexts[i][before[i]:], i))
    assert s.order(group).tolist() == want
