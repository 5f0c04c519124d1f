"""Small document tables and brute-force twins."""

import re

from pyspark.sql.types import LongType, StringType, StructField, StructType

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                     StructField("source", StringType()), StructField("n_chars", LongType())])


def docs(spark, texts, ids=None, sources=None, partitions=3):
    rows = [(i, t, "en", sources[n] if sources else "s", len(t or "")) for n, (i, t) in enumerate(zip(ids or range(len(texts)), texts))]
    return spark.createDataFrame(rows, SCHEMA).repartition(partitions) if rows else spark.createDataFrame([], SCHEMA)


def shingles(text, k=5):
    words = WORD.findall(text or "")
    return {tuple(words)} if 0 < len(words) < k else {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}


def prose(seed, n, vocabulary=4000):
    import random

    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))
