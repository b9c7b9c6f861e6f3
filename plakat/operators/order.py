"""Stable positions within blocks, numbered over range partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plakat.runtime import cut


def positions(rows: DataFrame, block: str, *order: str | Column, name: str = "position") -> DataFrame:
    """Stable order within a block, as a position from 1: ties are broken by the later columns, the last of which must be unique.

    Blocks are sorted by range over all tasks and numbered by the rows before each range, so a block with a third of all rows is no task's burden.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    keyed = rows.withColumns({f"_k{i}": c for i, c in enumerate(by)})
    keys = [block, *[f"_k{i}" for i in range(len(by))]]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(keyed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id()))
    # Ranges follow the order, so a block's rows in earlier partitions come first: one count a block and partition.
    counts = parts.groupBy(block, "_p").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(W.partitionBy(block).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    local = parts.withColumn("_r", F.row_number().over(W.partitionBy(block, "_p").orderBy(*keys[1:])))
    before = before.select(F.col(block).alias("_b"), F.col("_p").alias("_q"), "_before")
    out = local.join(before, F.col(block).eqNullSafe(F.col("_b")) & (F.col("_p") == F.col("_q")))
    return out.withColumn(name, (F.col("_before") + F.col("_r")).cast("int")).drop("_p", "_r", "_b", "_q", "_before", *keys[1:])
