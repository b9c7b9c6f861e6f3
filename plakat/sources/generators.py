"""Generated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_series(df: DataFrame, start: str, first: int = 2, times: int = 4) -> DataFrame:
    """Rows of a weekly series: ``times`` dates a week apart, the first some days after the start; null starts give none."""
    days = F.sequence(F.date_add(start, first), F.date_add(start, first + 7 * (times - 1)), F.expr("interval 7 days"))
    return df.withColumn("day", F.explode(days))
