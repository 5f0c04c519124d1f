"""The queries of this package over the given tables, each with its SQL twin where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (chat, fill_in_middle, filter_audit, fingerprints, jaccard_forest, mixing, packing, passages, quality_mil, quality_rules, secret_scan,
               suffix_dedup, toxicity)


#: An Arrow batch is held on both sides of a Python worker, in several copies: the setting and its bound in bytes.
ARROW_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set(*ARROW_BATCH)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_report(_table(spark, folder, "documents"))


def op2_jaccard_forest(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_forest.near_duplicates(_table(spark, folder, "documents"))


def op3_quality_mil(spark: SparkSession, folder: str) -> DataFrame:
    return quality_mil.quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op4_fuzzy_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.shared_passages(_table(spark, folder, "documents"))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_figures(_table(spark, folder, "documents").select("doc_id", "text"))


def op6_pattern_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(_table(spark, folder, "documents"))


def op7_chat_layouts(spark: SparkSession, folder: str) -> DataFrame:
    turns = chat.turns_of_table(_table(spark, folder, "conversations"))
    sample = spark.createDataFrame([(-7, i, role, chat.SAMPLE_TEXT) for i, role in enumerate(("user", "assistant"))], chat.TURNS)
    return chat.read_back(chat.formatted(turns.union(sample)))


def op8_toxicity_grammar(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op9_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(_table(spark, folder, "documents"))


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = suffix_dedup.repeated_strings(_table(spark, folder, "documents"), cut_text=True)
    return rows.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op11_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secret_report(_table(spark, folder, "documents"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.interaction_report(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_in_middle.fill_report(_table(spark, folder, "documents"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    spark.conf.set(*ARROW_BATCH)
    return corpus_pipeline.run(spark, folder)


_QUERIES = (op1_fingerprints, op2_jaccard_forest, op3_quality_mil, op4_fuzzy_passages, op5_quality_rules, op6_pattern_packing, op7_chat_layouts,
            op8_toxicity_grammar, op9_source_mix, op10_suffix_dedup, op11_secret_scan, op12_filter_audit, op13_fill_in_middle, pipeline)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": quality_rules.REPORT_SQL, "op7_chat_layouts": chat.REPORT_SQL, "op9_source_mix": mixing.REPORT_SQL,
            "op12_filter_audit": filter_audit.REPORT_SQL, "op13_fill_in_middle": fill_in_middle.REPORT_SQL}
