import oracle
from helpers import WORD, docs, prose
from tracelode.llm import mixing


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * sizes[s] <= level * weight[s]}
        for s in full or open_:
            out[s] = float(3 * sizes[s]) if s in full else level * weight[s]
        left -= sum(out[s] for s in full)
        open_ = open_ - full if full else set()
    return out


def test_sql_twin(spark):
    con = oracle.duck("/root/testdata/sf0.01")
    assert oracle.compare(con, mixing.REPORT_SQL, mixing.mix_report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))) is None


def test_targets_and_copies(spark):
    sources = ["b", None, "a", "é", "", "b", "a", None, "z"] * 40
    texts = [prose(i, 1 + (i * 7) % 90 * (30 if sources[i] == "a" else 1)) if i % 50 else None for i in range(len(sources))]
    frame = docs(spark, texts, sources=sources)
    rows = mixing.mix_report(frame).collect()
    sizes = {}
    for s, t in zip(sources, texts):
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = targets(sizes)
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    for r in rows:
        s = sources[r.doc_id]
        assert r.size == len(WORD.findall(texts[r.doc_id] or "")) and r.source_size == sizes[s]
        assert abs(r.target - want[s]) <= 1e-9 * max(1, want[s])
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
    for s in sizes:
        taken = sum(r.taken for r in rows if sources[r.doc_id] == s)
        assert abs(taken - want[s]) <= 0.25 * want[s]
    copies = {}
    for r in mixing.mixed(frame).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert {r.doc_id: r.taken for r in rows if r.taken} == {i: n * len(WORD.findall(texts[i] or "")) for i, n in copies.items() if texts[i]}
    assert mixing.mixed(frame).columns == frame.columns


def test_odd_rows(spark):
    assert mixing.mix_report(docs(spark, [])).count() == 0
    assert mixing.mixed(docs(spark, [])).count() == 0
    rows = mixing.mix_report(docs(spark, [None, "", " "], ids=[None, 1, 1])).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 3
    frame = docs(spark, ["a b"] * 4, ids=[5, 5, None, None]).withColumnRenamed("lang", "target").withColumnRenamed("n_chars", "copies")
    assert {r.taken for r in mixing.mix_report(frame).collect()} == {2}
    assert mixing.mixed(frame).columns == frame.columns
