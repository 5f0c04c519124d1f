import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from helpers import docs, prose
from tracelode.llm import packing


def brute_pieces(text, tokenizer, capacity):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
    for n, at in enumerate(range(0, len(ids), capacity)):
        part = ids[at:at + capacity]
        yield n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_whole_table_against_plain_tokenizing(spark, tokenizer):
    path = "/root/testdata/sf0.01/documents.parquet"
    want = sorted((r["doc_id"], *p) for r in pq.read_table(path).to_pylist() for p in brute_pieces(r["text"], tokenizer, 4096))
    rows = packing.packed(spark.read.parquet(path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    least = -(-sum(w[3] for w in want) // 4096)
    assert check(rows, 4096) <= least * 1.005 + 1


def test_odd_rows(spark, tokenizer):
    texts = [None, "", "ΑΣ Σ x y é e ́", "<|endoftext|> a<|startoftext|>b", "it's we'll 12345 !?#", prose(1, 400), prose(1, 400), "🙂" * 30, "x" * 5000]
    rows = packing.packed(docs(spark, texts, ids=[0, 1, 2, 3, 4, 5, 5, 6, None]), capacity=64).collect()
    want = sorted((-1 if i is None else i, *p) for i, t in zip([0, 1, 2, 3, 4, 5, 5, 6, None], texts) for p in brute_pieces(t, tokenizer, 64))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    check(rows, 64)
    assert packing.packed(docs(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_piece(seed):
    r = np.random.Generator(np.random.PCG64(seed))
    histogram = np.zeros(4097, np.int64)
    np.add.at(histogram, np.clip(r.lognormal(6.5, 1.1, 20000).astype(int), 1, 4096), 1)
    kinds = packing.plan(histogram)
    held = np.zeros(4097, np.int64)
    for lengths, n in kinds:
        assert sum(lengths) <= 4096 and n > 0
        np.add.at(held, lengths, n)
    assert (held == histogram).all()
    least = -(-int((histogram * np.arange(4097)).sum()) // 4096)
    assert sum(n for _, n in kinds) <= least * 1.002 + 1


def test_every_white_space_and_control_character(spark, tokenizer):
    """Ids are those of the whole text, whatever stands between, in and around words."""
    import sys
    import unicodedata

    odd = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() or unicodedata.category(c) in ("Cc", "Cf", "Zl", "Zp", "Zs")]
    texts = [f"one{c}two {c} three{c}{c}four, {c}five" for c in odd] + ["".join(f"w{c}" for c in odd), "plain words OF ASCII letters", "Straße İstanbul ǅ ſtop K"]
    ids = packing._ids(open(packing.default_tokenizer(), encoding="utf-8").read())
    assert ids.direct
    got = ids(texts)
    assert [t for t, g in zip(texts, got) if g != np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()] == []
