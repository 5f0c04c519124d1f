from collections import Counter

import pyarrow.parquet as pq

from helpers import WORD, docs, prose
from tracelode.llm import quality_rules


def figures(text):
    text = text or ""
    words = WORD.findall(text)
    runs = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(runs)
    cover = {j for i, x in enumerate(runs) if often[x] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, chars, symbols, repeated = len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines))
    failed = n < 10 or 100 * len(cover) > 20 * n
    capitals = sum("A" <= c <= "Z" for c in text)
    letters = capitals + sum("a" <= c <= "z" for c in text)
    wordlike = letters + sum(len(c.encode()) for c in text if ord(c) > 127)
    top = max(Counter(words).values(), default=0)
    rejected = (10 * symbols > 3 * n or not 2 * n <= chars <= 20 * n or 10 * repeated > 5 * len(lines) or 2 * capitals > letters
                or 2 * wordlike < chars or top > max(int(0.3 * n), 1))
    return n, chars, symbols, repeated, len(cover), failed, not failed and not rejected


def test_whole_table_against_plain_python(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    want = {r["doc_id"]: figures(r["text"]) for r in pq.read_table(path).to_pylist()}
    rows = quality_rules.quality_figures(spark.read.parquet(path)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert {r.doc_id: tuple(r[c] for c in names) for r in rows} == want
    assert {r.doc_id for r in quality_rules.passing(spark.read.parquet(path)).collect()} == {i for i, x in want.items() if x[-1]}


def test_odd_rows(spark):
    texts = [None, "", "\n\n", "a\x0bb\x0cc d", "x " * 50, "SHOUT " + prose(1, 20).upper(), prose(2, 40), "line one two\nline one two\n", "� ä ö " * 5]
    frame = docs(spark, texts).withColumnRenamed("n_chars", "kept").withColumnRenamed("lang", "N_Words")
    rows = quality_rules.quality_figures(frame)
    assert rows.columns[:2] == ["doc_id", "source"]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert {r.doc_id: tuple(r[c] for c in names) for r in rows.collect()} == {i: figures(t) for i, t in enumerate(texts)}
    assert quality_rules.quality_figures(docs(spark, [])).count() == 0
    assert quality_rules.passing(frame).columns == frame.columns


def test_order_does_not_change_the_verdict(spark):
    texts = ["A1# " * 3 + prose(i, 30) if i % 3 else prose(i, 30).upper() for i in range(40)]
    frame = docs(spark, texts)
    ordered = quality_rules.rule_order(frame)
    assert sorted(r.name for r in ordered) == sorted(r.name for r in quality_rules.RULES)
    view = quality_rules.View(quality_rules.Block.of_list(texts))
    assert (quality_rules.cascade(view, ordered) == quality_rules.cascade(view, ordered[::-1])).all()


def test_sql_twin(spark):
    import oracle

    frame = quality_rules.quality_figures(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    assert oracle.compare(oracle.duck("/root/testdata/sf0.01"), quality_rules.REPORT_SQL, frame) is None
