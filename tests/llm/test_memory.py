"""What a Python worker is handed at once is bounded by bytes."""

import tracemalloc

import pyarrow as pa

from tracelode.llm import jaccard_forest, registry


def test_arrow_batches_of_long_texts_are_small(spark, tmp_path):
    spark.range(1500).selectExpr("id as doc_id", "repeat('some words ', 1000) as text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get(registry.ARROW_BATCH[0])
    try:
        documents = registry._table(spark, str(tmp_path), "documents")
        sizes = documents.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]}) for b in batches), "n bigint, bytes bigint").collect()
    finally:
        spark.conf.set(registry.ARROW_BATCH[0], before)
    assert sum(r["n"] for r in sizes) == 1500 and max(r["bytes"] for r in sizes) < 8 << 20


def test_a_tile_of_long_near_copies_is_verified_in_little_memory():
    words = [f"w{i}" for i in range(6000)]
    texts = [" ".join([*words[:i * 15], "other", *words[i * 15 + 1:]]) for i in range(300)]
    n = len(texts)
    batch = pa.RecordBatch.from_pydict({"key": [1] * n, "a": [0] * n, "b": [0] * n, "id": list(range(n)), "own": [0] * n, "n": [1] * n, "text": texts})
    list(jaccard_forest._verified(iter([batch.slice(0, 2)])))
    tracemalloc.start()
    try:
        out = list(jaccard_forest._verified(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    rows = pa.Table.from_batches(out).to_pydict()
    assert rows["id"] == list(range(n)) and set(rows["links"]) == {n - 1} and set(rows["label"]) == {0}
    assert peak < 75 * n * 6000, peak / n / 6000
