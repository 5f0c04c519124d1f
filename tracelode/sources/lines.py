"""Text files as ordered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

BOM = "\ufeff"


def read_lines(spark: SparkSession, paths) -> DataFrame:
    """Lines of one or more files, wildcards allowed.

    ``block`` is where the file split that holds a line starts and ``line_no`` grows within it,
    so (source, block, line_no) is the order of the file and a block never exceeds one split.
    """
    raw = spark.read.text(paths if isinstance(paths, (list, tuple)) else [paths])
    return raw.select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
        strip_bom(F.col("value")).alias("line"))


def strip_bom(text):
    return F.when(F.startswith(text, F.lit(BOM)), F.substring(text, 2, 2_147_483_647)).otherwise(text)
