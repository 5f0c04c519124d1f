import hashlib

import pyarrow.parquet as pq
import xxhash
from pyspark.sql import functions as F

from helpers import WORD, docs, prose, shingles
from tracelode.llm import fingerprints as fp

MASK = (1 << 64) - 1


def chained(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest((v & MASK).to_bytes(8, "little"), seed)
    return seed


def sketch(text, k=fp.K):
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text or "")]
    runs = [words] if 0 < len(words) < 5 else [words[i:i + 5] for i in range(len(words) - 4)]
    return sorted({chained(r) >> 1 for r in runs})[:k]


def near(a, b, k=fp.K):
    union = sorted({*a, *b})
    union = union if len(a) < k and len(b) < k else union[:k]
    return len(set(union) & set(a) & set(b)) / len(union) if union else 1.0


def brute(rows):
    rows = sorted(((-(1 << 63) if i is None else i), t or "") for i, t in rows)
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        a, b = sketch(t), sketch(edited)
        text = lambda s: "".join(f"{h:016X}" for h in s)
        yield i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), near(a, b), near(a, sketch(after))


def got(frame):
    return sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next)
                  for r in frame.collect())


def test_whole_table_against_brute_force(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    rows = pq.read_table(path, columns=["doc_id", "text"]).to_pylist()
    assert got(fp.fingerprint_report(spark.read.parquet(path))) == sorted(brute((r["doc_id"], r["text"]) for r in rows))


def test_odd_rows(spark, monkeypatch):
    texts = [None, "", "\t\n", "a", "a b c d", "ä🙂é " * 9, prose(1, 400), prose(1, 400), "x y", None, "last one"]
    ids = [3, 4, 10 ** 15, -7, 8, 9, 10, 11, 8, None, 2 ** 62]
    for rows in (512, 2):
        monkeypatch.setattr(fp, "BUCKET_ROWS", rows)
        frame = docs(spark, texts, ids=ids).withColumnRenamed("lang", "sketch").withColumnRenamed("source", "edited")
        assert got(fp.fingerprint_report(frame)) == sorted(brute(zip(ids, texts)))
    assert fp.fingerprint_report(docs(spark, [])).count() == 0
    assert got(fp.fingerprint_report(docs(spark, ["only one here"]))) == sorted(brute([(0, "only one here")]))


def test_merge_and_estimates(spark):
    parts = [prose(i, 300) for i in range(12)]
    frame = fp.with_sketch(docs(spark, parts).withColumn("half", F.col("doc_id") % 2), "text", "sketch")
    whole = {r.half: r.sketch for r in fp.merged_parts(frame, "half", "sketch").collect()}
    sets = [set().union(*(shingles(p) for p in parts[h::2])) for h in (0, 1)]
    for h in (0, 1):
        assert whole[h] == sorted({x for p in parts[h::2] for x in sketch(p, 10 ** 6)})[:fp.K]
    first, long = parts[0], parts[0] + " " + prose(77, 900)
    rows = spark.createDataFrame([(first, long)], "a string, b string")
    rows = fp.with_sketch(fp.with_sketch(rows, "a", "sa"), "b", "sb").select(
        fp.distinct_shingles(F.col("sb")).alias("n"), fp.resemblance(F.col("sa"), F.col("sb")).alias("j"), fp.containment(F.col("sa"), F.col("sb")).alias("c"),
        fp.merge(F.col("sa"), F.col("sb")).alias("m"), "sb").first()
    n, both = len(shingles(long)), len(shingles(first) & shingles(long))
    assert abs(rows.n - n) < 0.3 * n and abs(rows.j - both / n) < 0.15 and rows.c > 0.6 and rows.m == rows.sb
    assert len(sets) == 2
