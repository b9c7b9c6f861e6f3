"""Bounded, repeatable samples of rows on which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashed_sample(df: DataFrame, key: list[str], rows: int) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hash of the key columns (column ``_h``); the same rows however the table is split.

    The count comes from the files' footers; by it only about four times the wanted rows take part in the sort, whatever the size of the table.
    """
    share = 4 * rows / max(1, df.count())
    out = df.withColumn("_h", F.xxhash64(*key))
    if share < 1:
        out = out.where(F.col("_h") < int((share - 0.5) * 2**64))
    return out.orderBy("_h").limit(rows)
