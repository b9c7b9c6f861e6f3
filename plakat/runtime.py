"""Session helpers shared by operators: table access, shared checkpoints, ordinals."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table of a data directory; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared ``spark.checkpoint.dir``; only on a local master (tests) may a temporary folder stand in for it."""
    if spark.conf.get("spark.checkpoint.dir", None) or not spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        return
    if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plakat-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder: used twice or more, it is computed once and survives lost executors.

    Spark removes the files with the last reference to them if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set; ``drop_checkpoints`` removes them at once.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_checkpoints(spark: SparkSession) -> None:
    """Remove what this application has checkpointed so far. For the end of a run: frames cut before can't be read any more."""
    where = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not where.isEmpty():
        path = spark._jvm.org.apache.hadoop.fs.Path(where.get())
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for f in fs.listStatus(path):
            fs.delete(f.getPath(), True)


def task_slots(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Round-robin over the task slots if the scan has fewer partitions; small files otherwise leave cores idle in Python stages."""
    n = least or task_slots(df.sparkSession)
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def with_ordinal(df: DataFrame, *order: str) -> DataFrame:
    """Give rows an explicit ordinal column ``ord`` taken from key columns, for first/last rules that Spark leaves undefined."""
    return df.withColumn("ord", F.struct(*order) if len(order) > 1 else F.col(order[0]))
