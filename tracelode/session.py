"""Session settings and the lineage-cutting folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators are planned for. Partition counts are left to adaptive execution, which
# coalesces them. On a cluster start high, with INITIAL_PARTITIONS or more; a local session keeps its own number.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # An object that repeats a key is valid; its last value counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


INITIAL_PARTITIONS = 4096


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings that results or plans depend on."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if not spark.sparkContext.master.startswith("local") and spark.conf.get(initial, None) is None:
        spark.conf.set(initial, str(INITIAL_PARTITIONS))
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a machine-local
    folder is lost together with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tracelode-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{scratch_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: With it, the shuffle files of a step go when the step is written, and not when the driver happens to collect garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Iterative plans stay short and survive lost executors, and unlike a row-wise checkpoint the
    table is compressed and later steps read only the columns they need. Its shuffle files are removed at once.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop_scratch(*tables: DataFrame) -> None:
    """Removes tables that :func:`cut_lineage` wrote and that no later step reads."""
    for table in tables:
        delete_folder(table.sparkSession, table.scratch)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder of a shared file system, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder of a shared file system holds; none if it is absent."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []


def move_folder(spark: SparkSession, old: str, new: str) -> bool:
    """Puts a folder in the place of another one. False, and nothing there any more, if the old one is absent."""
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (old, new))
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(target, True)
    files.mkdirs(target.getParent())
    return files.exists(source) and files.rename(source, target)
