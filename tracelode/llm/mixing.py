"""Mixing sources to target weights: whole copies plus one hash-seeded Bernoulli copy. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

SEED = "mix-1"
#: No source, and so no document, is taken more often than this.
MOST = 3
#: Plans of up to so many sources are broadcast; larger ones are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: str = "text") -> Column:
    words = F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+")
    return F.size(F.array_remove(words, "")).cast("bigint")


def source_plan(sized: DataFrame) -> DataFrame:
    """(source, source_size, target) for the sources of ``sized`` (source, size).

    Sources in code-point order, null last, weigh 1, 2, 3, repeating. Targets share all sizes by weight and
    stop at three times their source's size; what is above is shared again among the others. That is
    ``least(3 * size, level * weight)``: with the sources in the order in which a rising level fills them,
    the level is what is left for the first source that it doesn't fill.
    Windows run over one row for each source.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = cut_lineage(sources, "sources")
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = (sources.withColumn("weight", ((number - 1) % 3 + 1).cast("double"))
               .withColumn("cap", (F.col("source_size") * MOST).cast("double")).withColumn("fills", F.col("cap") / F.col("weight")))
    everything = Window.partitionBy()
    below = Window.orderBy("fills", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0))
    levels = weighed.withColumn("level", left / weight)
    first = F.min(F.when(F.col("level") < F.col("fills"), F.struct("fills", "level"))).over(everything)
    return levels.withColumn("level", F.coalesce(first["level"], F.lit(0.0))).select(
        "source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _with_copies(rows: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """``rows`` (with doc_id and source) with source_size, target and the number of copies."""
    plan = cut_lineage(plan.withColumnRenamed("source", "__source"), "plan")
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # 52 bits of a digest: the same on every run and engine.
    chance = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))
    return joined.withColumn("copies", (F.floor(rate) + (chance < rate - F.floor(rate)).cast("int")).cast("int"))


def sized_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size) of every row: ``size`` is the number of words, 0 for a null text."""
    return documents.select("doc_id", F.col("source").cast("string").alias("source"), word_count().alias("size"))


def mix_report(documents: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row: what the mix takes of it, repeats counted.

    A null source is a source of its own; an empty text has size 0 and takes nothing. Rows that repeat a
    doc_id share its draw. Only one table row for each document is written, never a text.
    """
    sized = cut_lineage(sized_documents(documents), "sized")
    return _with_copies(sized, source_plan(sized), seed).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(documents: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows of ``documents``, each as often as the mix takes it, with their columns as they were.

    Texts are read twice and never shuffled.
    """
    plan = source_plan(sized_documents(documents)).select("source", F.col("source_size").alias("__size"), F.col("target").alias("__target"))
    keyed = documents.select(F.struct("*").alias("__row"), "doc_id", F.col("source").cast("string").alias("source"))
    plan = plan.withColumnsRenamed({"__size": "source_size", "__target": "target"})
    return (_with_copies(keyed, plan, seed).where("copies > 0")
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies"))).select("__row.*"))


REPORT_SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, (3 * source_size)::DOUBLE AS cap FROM sources),
levels AS (SELECT *, cap / weight AS fills,
    (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER below, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER below, 0)) AS level
  FROM weighed WINDOW below AS (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
plan AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, fills) FROM levels WHERE level < fills), 0) * weight) AS target FROM levels),
rated AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS chance
  FROM sized JOIN plan ON sized.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, size, source_size, target, size * (floor(rate) + (chance < rate - floor(rate))::INT)::BIGINT AS taken FROM rated
"""
