"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Files are read in small pieces; laps shuffle into many partitions, which adaptive execution merges up to this size. A lap takes some twenty times its shuffled
#: bytes in the sorts and windows of a stage, so the size bounds the memory of one task whatever the size of the table.
#: Stages of very many expressions are not fused: the JVM never compiles a method of more than 8,000 bytes of code.
TASK_SETTINGS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "400",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
    "spark.sql.files.maxPartitionBytes": "32MB",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession, settings: dict[str, str] = TASK_SETTINGS) -> SparkSession:
    """Runtime settings every job of this library relies on. A sort-merge join becomes a shuffled
    hash join only where every partition of the smaller side turns out to be small.
    """
    for name, value in settings.items():
        spark.conf.set(name, value)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, set as the context's checkpoint folder.

    Without that setting a local master gets a scratch folder; a cluster is refused, because
    a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder; the result no longer depends on what it was computed from."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The table as Parquet files in the shared folder: for tables that are read many times, each time some columns of them."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
