"""Bounded samples of labelled documents, for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def remainder(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def training_sample(documents: DataFrame, labels: DataFrame, label: str, usable, limit: int) -> DataFrame:
    """(doc_id, label, text) of at most ``limit`` labelled documents for which ``usable`` holds, ids in hash order.

    The ids of the sample are bounded by ``limit`` and broadcast, so no text but those of the sample moves.
    Of several labels of a document the greatest counts; a null label is none.
    """
    ids = (labels.where(usable).groupBy("doc_id").agg(F.max(label).alias("label")).where("label is not null and doc_id is not null")
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    ids = cut_lineage(ids.select(F.col("doc_id").alias("__id"), F.col("label").cast("int").alias("label")), "sample")
    texts = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(ids), texts.doc_id == ids["__id"]).select("doc_id", "label", "text")
    return cut_lineage(found, "sample-texts")


def sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
