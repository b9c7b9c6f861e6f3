"""Offers of an event: one per seller, ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plakat.functions.url import clean_url, netloc

GENERIC_SELLERS = ["Organizator", "Strona źródłowa", "Inne"]


def seller_key(name: Column, url: Column) -> Column:
    """The seller, with the host for generic names."""
    return F.when(name.isin(GENERIC_SELLERS), F.concat(name, F.lit(":"), netloc(url))).otherwise(name)


def offers_of(df: DataFrame, event: str, array: str, fallback_url: Column | None = None) -> DataFrame:
    """Explode an offer array to (event, ord, provider, url, price); events without any offer get one from the fallback link, if there is one."""
    slim = F.transform(array, lambda o: F.struct(o["provider"].alias("provider"), F.trim(o["url"]).alias("url"), o["price"].alias("price")))
    linked = lambda o: F.coalesce(o["url"], F.lit("")) != ""
    out = df.select(event, F.posexplode(slim).alias("ord", "o")).where(linked(F.col("o"))).select(event, "ord", "o.provider", "o.url", "o.price")
    if fallback_url is not None:
        some = F.coalesce(F.exists(slim, linked), F.lit(False))
        lone = df.where(~some & (F.coalesce(fallback_url, F.lit("")) != "")).select(event, F.lit(0).alias("ord"), F.lit(None).cast("string").alias("provider"), fallback_url.alias("url"), F.lit(None).cast("string").alias("price"))
        out = out.unionByName(lone)
    return out


def dedup_offers(offers: DataFrame, event: str, seller: Column, told: Column) -> DataFrame:
    """One offer a seller: the first; its link and price come from the first offer whose price tells something, if any does.

    Aggregation only: an event or seller with a third of all rows is combined before the shuffle.
    """
    o = offers.withColumn("seller", seller_key(seller, F.col("url"))).withColumn("_told", told)
    pick = F.struct(F.when(F.col("_told"), 0).otherwise(1).alias("t"), F.col("ord").alias("ord"), F.col("url").alias("url"), F.col("price").alias("price"))
    out = o.groupBy(event, "seller").agg(F.min("ord").alias("ord"), F.min(pick).alias("_p"), F.count("*").alias("n_offers"))
    return out.select(event, "seller", "ord", clean_url(F.col("_p.url")).alias("url"), F.col("_p.price").alias("price"), "n_offers")


def rank_offers(offers: DataFrame, event: str, *order: Column) -> DataFrame:
    """Rank in a stated order (ties by position); the first is primary."""
    w = W.partitionBy(event).orderBy(*order, "ord")
    return offers.withColumn("rank", F.row_number().over(w)).withColumn("is_primary", F.col("rank") == 1)


def price_number(price: Column) -> Column:
    """First number of a price text, 0 for free admission; null for texts that name no amount."""
    n = F.replace(F.regexp_extract(price, r"(\d+(?:[.,]\d+)?)", 1), F.lit(","), F.lit("."))
    return F.when(F.lower(price).rlike("bezpłat|woln"), 0.0).otherwise(F.nullif(n, F.lit("")).try_cast("double"))


def ranked_by_price(offers: DataFrame, event: str, seller: Column) -> DataFrame:
    """Offers of an event by amount (unknown ones last), then authority, then position; ``seller`` is struct(authority, name, official). Adds rank, is_primary, is_official."""
    o = offers.withColumns({"_n": price_number(F.col("price")), "_s": seller})
    out = rank_offers(o, event, F.col("_n").asc_nulls_last(), F.col("_s.authority").desc())
    return out.withColumn("is_official", F.col("_s.official")).drop("_n", "_s")
