"""Data-quality reports. All aggregate before they shuffle; none collects a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plakat.operators.agenda import iso_date


def unresolved(events: DataFrame, town: str, venue: Column, place: Column, order: str) -> DataFrame:
    """Venue texts of rows without a place: (town, venue, n, first_id); blank texts are left out."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    r = events.where(empty(place) & ~empty(venue))
    return r.groupBy(town, venue.alias("venue")).agg(F.count("*").alias("n"), F.min(order).alias("first_id"))


def top(df: DataFrame, value: Column, name: str, k: int) -> DataFrame:
    """The ``k`` most frequent non-null values; ties in value order."""
    return df.select(value.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), name).limit(k)


def feed_quality(events: DataFrame, as_of: Column) -> DataFrame:
    """Counts of valid, future, pictured, free and linked rows of each source."""
    told = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return events.groupBy("source").agg(
        F.count("*").alias("total"), F.count_if(iso_date(F.col("date_start"))).alias("valid_dates"), F.count_if(F.col("date_start") >= as_of).alias("future"),
        F.count_if(told("image_url")).alias("with_image"), F.count_if("is_free").alias("free"), F.count_if(told("source_url")).alias("with_url"),
    )


def histograms(columns: dict[str, DataFrame]) -> DataFrame:
    """Value counts of several one-column frames (value): (what, value, n)."""
    parts = [df.groupBy("value").agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "value", "n") for k, df in columns.items()]
    return reduce(DataFrame.unionByName, parts)


def with_samples(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, active_events, samples): the count and the two smallest distinct texts."""
    base = rows.groupBy(key).agg(F.count("*").alias("active_events"), F.min(text).alias("_a"))
    second = rows.join(base.select(key, "_a"), key).where(F.col(text) != F.col("_a")).groupBy(key).agg(F.min(text).alias("_b"))
    return base.join(second, key, "left").select(key, "active_events", F.concat_ws(" | ", "_a", "_b").alias("samples"))


def anomalies(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Rows that fail each test, counted in one pass: (anomaly, n)."""
    counts = rows.agg(*[F.count_if(F.coalesce(t, F.lit(False))).alias(k) for k, t in tests.items()])
    return counts.select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in tests]), F.array(*[F.col(k) for k in tests]))).alias("anomaly", "n"))


def places_by_use(events: DataFrame, town: str, place: Column, venue: Column, k: int) -> DataFrame:
    """Mapped places and unmapped venue texts (in brackets) of each town in one list, the ``k`` most used: (town, place, n, kind)."""
    mapped = F.coalesce(place, F.lit("")) != ""
    name = F.when(mapped, place).otherwise(F.concat(F.lit("("), F.coalesce(venue, F.lit("")), F.lit(")")))
    n = events.groupBy(town, name.alias("place"), F.when(mapped, "mapped").otherwise("unmapped").alias("kind")).agg(F.count("*").alias("n"))
    w = W.partitionBy(town).orderBy(F.col("n").desc(), "kind", "place")
    return n.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).select(town, "place", "n", "kind")
