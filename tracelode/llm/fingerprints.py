"""Bottom-k fingerprints of word shingles. Column expressions only.

A sketch is the ``k`` least distinct hashes of a text's 5-word shingles, ascending. Sketches of parts
merge into the sketch of the whole; two sketches estimate resemblance and containment, one the number of
distinct shingles. Estimates are exact while the sets they speak of have fewer than ``k`` shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WORDS = 5
K = 128
_SPACE = float(1 << 63)
#: Rows that share a bucket of neighbouring ids, and the most buckets there are.
BUCKET_ROWS, BUCKETS = 512, 1 << 14


def _kept(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(hashes), 1, k)


def with_sketch(rows: DataFrame, text: str, name: str, k: int = K) -> DataFrame:
    """``rows`` with the sketch of ``text`` as column ``name``: empty without words; a text of fewer than
    five words has one shingle. Steps are columns of their own so that none is worked out twice."""
    words, hashes = f"{name}__words", f"{name}__hashes"
    split = F.array_remove(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), "")
    shingle = lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(hashes, i + F.lit(j)) for j in range(WORDS))), 1)
    return (rows.withColumn(words, split).withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w))).drop(words)
            .withColumn(name, _kept(F.when(F.size(hashes) >= WORDS, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(hashes) - WORDS), shingle)))
                                    .when(F.size(hashes) > 0, F.array(F.shiftrightunsigned(F.xxhash64(hashes), 1)))
                                    .otherwise(F.array().cast("array<bigint>")), k)).drop(hashes))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts taken together."""
    return _kept(F.array_union(a, b), k)


def merged_parts(parts: DataFrame, key: str, sketch: str, k: int = K) -> DataFrame:
    """(key, sketch) over any number of parts. Only the ``k`` least hashes of a key leave a task, so a key
    with very many parts costs no more than ``k`` rows for each of them."""
    each = parts.select(key, F.explode(sketch).alias("__h")).distinct()
    first = each.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("__h"))).where(F.col("__n") <= k)
    return first.groupBy(key).agg(F.sort_array(F.collect_list("__h")).alias(sketch))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) * F.lit(_SPACE) / (F.element_at(sketch, k) + F.lit(1.0)))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Jaccard similarity of the shingle sets; 1 for two sets without shingles."""
    union = F.array_union(a, b)
    union = F.when((F.size(a) < k) & (F.size(b) < k), union).otherwise(_kept(union, k))
    both = F.size(F.array_intersect(union, F.array_intersect(a, b))).cast("double")
    return F.when(F.size(union) > 0, both / F.size(union)).otherwise(F.lit(1.0))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The share of the shingles of ``a`` that ``b`` has, 1 if ``a`` has none."""
    small = (F.size(a) < k) & (F.size(b) < k)
    exact = F.size(F.array_intersect(a, b)) / F.size(a)
    estimate = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).when(small, exact).otherwise(F.least(F.lit(1.0), estimate))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def _place(edges: list[int], key: Column) -> Column:
    """How many of the sorted ``edges`` are at most ``key``, by binary search."""
    table = F.lit(edges)
    steps = F.lit([1 << i for i in reversed(range(len(edges).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= key, at + step).otherwise(at))


def with_next(rows: DataFrame, key: str, columns: list[str], prepare=lambda df: df) -> DataFrame:
    """``rows`` with columns ``next_*``: those of the row that follows by (``key``, text), the first one's after the last.

    Rows are dealt to buckets of neighbouring keys (a null key comes first), whose edges are quantiles; the
    row at the start of a bucket also goes to the end of the one before. ``prepare`` adds columns after the
    one shuffle, so they needn't travel.
    """
    rows = rows.withColumn("__key", F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63))))
    n, low = rows.agg(F.count("*"), F.min("__key")).first()
    buckets = max(1, min(BUCKETS, -(-n // BUCKET_ROWS)))
    shares = [i / buckets for i in range(1, buckets)] or [0.5]
    edges = sorted({low or 0, *(rows.agg(F.percentile_approx("__key", shares, 4 * BUCKETS)).first()[0] or [])})
    last = len(edges)
    dealt = rows.withColumn("__bucket", _place(edges, F.col("__key")))
    before = F.when(F.col("__bucket") == 1, F.lit(last)).otherwise(F.col("__bucket") - 1)
    first = F.get(F.lit(edges), F.col("__bucket") - 1) == F.col("__key")
    own, copy = F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("c")), F.struct(before.alias("b"), F.lit(True).alias("c"))
    dealt = dealt.withColumn("__to", F.explode(F.when(first, F.array(own, copy)).otherwise(F.array(own))))
    dealt = prepare(dealt.withColumn("__bucket", F.col("__to.b")).withColumn("__copy", F.col("__to.c")).drop("__to").repartition("__bucket"))
    order = Window.partitionBy("__bucket").orderBy("__copy", "__key", "text")
    return dealt.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in columns)).where("not __copy").drop("__bucket", "__copy", "__key")


def fingerprint_report(documents: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has the last half of the code points (rounded down) replaced by as many, or all, from
    the start of the document that follows by doc_id (then text; a null id comes first; the first follows
    the last). A null text is empty. Other columns are ignored; rows may repeat.
    """
    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(rows, "doc_id", ["text", "sketch"], lambda df: with_sketch(df, "text", "sketch", k))
    half = F.floor(F.col("n_chars") / 2)
    edited = F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substr("next_text", F.lit(1), half.cast("int")))
    rows = rows.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("edited", edited)
    rows = with_sketch(rows, "edited", "edited_sketch", k)
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"),
                       as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
                       resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
                       resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
                       distinct_shingles(F.col("sketch"), k).alias("n_shingles"))
