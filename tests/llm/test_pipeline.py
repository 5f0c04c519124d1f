from collections import Counter

import corpus_pipeline
from helpers import WORD, docs
from test_jaccard_forest import brute as classes
from test_packing import brute_pieces, check
from test_passages import passages
from test_quality_rules import figures
from tracelode.llm import mixing, packing

FOLDER = "/root/testdata/sf0.001"


def texts(frame):
    return sorted((r.doc_id, r.text) for r in frame.collect())


def test_every_stage_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    now = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = now.columns, texts(now)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, FOLDER)
        if i < 4:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        after = texts(out) if i < 4 else None
        if i == 0:
            assert after == [(d, t) for d, t in before if figures(t)[-1]]
        elif i == 1:
            found = classes(before)
            assert after == [(d, t) for d, t in before if d not in found or found[d][0] == d]
        elif i == 2:
            spans = {}
            for r in passages.shared_passages(now).collect():
                spans.setdefault(r.doc_id, []).append((r.start, r.end))
            assert [d for d, _ in after] == [d for d, _ in before]
            for (d, old), (_, new) in zip(before, after):
                words = WORD.findall(old)
                for s, e in sorted(spans.get(d, []), reverse=True):
                    del words[s:e]
                assert WORD.findall(new) == words and (d in spans or old == new)
        elif i == 3:
            taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix_report(now).collect()}
            copies = Counter(d for d, _ in after)
            assert all(copies[d] * taken[d][0] == taken[d][1] for d, _ in before) and set(after) <= set(before)
        else:
            tokenizer = Tokenizer.from_file(packing.default_tokenizer())
            rows = out.collect()
            want = sorted((d, *p) for d, t in before for p in brute_pieces(t, tokenizer, 4096))
            assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
            check(rows, 4096)
        now, before = out, after


def test_run_and_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
