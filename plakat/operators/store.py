"""The stored table: upsert by link, replacement per town, purge, write-back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plakat.functions.text import title_key
from plakat.functions.url import local_url, url_identity
from plakat.operators.dedup import first_by, fuzzy_upsert
from plakat.runtime import cut


def upsert(stored: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """Incoming rows replace stored rows of the same key; of several incoming rows the last wins. Rows with a null key are all kept."""
    named = batch.where(F.col(key).isNotNull())
    last = first_by(named.withColumn("_neg", -F.col(order)), [key], "_neg").drop("_neg")
    kept = stored.join(last.select(key), key, "left_anti")
    return kept.unionByName(last, allowMissingColumns=True).unionByName(batch.where(F.col(key).isNull()), allowMissingColumns=True)


def insert_ignore(stored: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """Only rows whose key is new are added, the first of each."""
    new = first_by(batch.where(F.col(key).isNotNull()), [key], order).join(stored.select(key), key, "left_anti")
    return stored.unionByName(new, allowMissingColumns=True)


def longer(a: Column, b: Column) -> Column:
    """The longer text, the first on a tie."""
    n = lambda c: F.length(F.coalesce(c, F.lit("")))
    return F.when(n(b) > n(a), b).otherwise(a)


def replace_partitions(spark: SparkSession, df: DataFrame, path: str, by: str) -> None:
    """Overwrite only the partitions that the rows belong to."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def sync_town(stored: DataFrame, rows: DataFrame, town: str, value: str, key: str, order: str) -> DataFrame:
    """All rows of a town are replaced by new ones; of rows with one key the last wins, even over another town's row."""
    last = first_by(rows.withColumn("_neg", -F.col(order)), [key], "_neg").drop("_neg")
    kept = stored.where(~F.coalesce(F.col(town) == value, F.lit(False))).join(last.select(key), key, "left_anti")
    return kept.unionByName(last, allowMissingColumns=True)


def merge_offers(stored: DataFrame, incoming: DataFrame, event: str, told: Column, generic: str = "Inne") -> DataFrame:
    """Offers (event, ord, provider, url, price) of both sides as one list.

    An incoming offer meets a stored one of the same event with the same named provider or the same link without query; the stored one keeps
    its place and link and takes the incoming price if its own tells nothing. The others are appended in order.
    """
    who = lambda p, u: F.when(p.isNotNull() & (p != generic), p).otherwise(url_identity(u))
    both = stored.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    both = both.withColumn("_k", who(F.col("provider"), F.col("url"))).withColumn("_told", told)
    whole = F.struct(F.col("_side"), F.col("ord"), F.col("provider"), F.col("url"), F.col("price"))
    out = both.groupBy(event, "_k").agg(F.min(whole).alias("o"), F.min(F.when(F.col("_told"), F.struct("_side", "ord", "price"))).alias("p"))
    return out.select(event, F.col("o._side").alias("side"), F.col("o.ord").alias("ord"), "o.provider", "o.url", F.coalesce("p.price", "o.price").alias("price"))


def ensure_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Open the table; create it empty if there is none or its columns are others."""
    want = spark.createDataFrame([], schema)
    try:
        have = spark.read.parquet(path)
        if {(f.name, f.dataType.simpleString()) for f in have.schema} == {(f.name, f.dataType.simpleString()) for f in want.schema}:
            return have
    except Exception as e:  # noqa: BLE001 - no table there
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    want.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_back(events: DataFrame, resolved: DataFrame, key: str) -> DataFrame:
    """Put resolved place ids into the nested ticket info; rows without one stay."""
    r = resolved.select(F.col(key).alias("_k"), F.col("place_id").alias("_place"))
    out = events.join(r, F.col(key) == F.col("_k"), "left")
    info = F.col("analysis.ticket_info").withField("place_id", F.coalesce(F.col("_place"), F.col("analysis.ticket_info.place_id")))
    return out.withColumn("analysis", F.col("analysis").withField("ticket_info", info)).drop("_k", "_place")


def reset_place(events: DataFrame, bad: Column) -> DataFrame:
    """Null the place of rows that match a condition."""
    info = F.col("analysis.ticket_info").withField("place_id", F.when(~F.coalesce(bad, F.lit(False)), F.col("analysis.ticket_info.place_id")))
    return events.withColumn("analysis", F.col("analysis").withField("ticket_info", info))


#: Part of a link that marks pictures stored by the portal itself, and prices that say nothing.
THUMBNAILS, NO_PRICE = "/assets/thumbnails/", ["Sprawdź dostępność", "Bilety płatne", ""]
_OFFER = "struct<provider:string,url:string,price:string,discounts:array<string>>"


def _folded_offers(base: Column, incoming: Column, generic: str) -> Column:
    """Offers after those that come in: an offer of the same named seller, or the same link without query, takes new discounts and fills a price that says nothing; others are appended."""
    clean = lambda o: url_identity(F.trim(o["url"]))
    same = lambda o, x: F.coalesce((x["provider"] != generic) & (o["provider"] == x["provider"]), F.lit(False)) | F.coalesce((clean(x) != "") & (clean(o) == clean(x)), F.lit(False))

    def meet(acc: Column, x: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda o: same(o, x)), True) - 1
        price = lambda o: F.when(F.coalesce(o["price"], F.lit("")).isin(NO_PRICE) & (F.coalesce(x["price"], F.lit("")) != ""), x["price"]).otherwise(o["price"])
        renewed = F.transform(acc, lambda o, i: F.when(i == at, F.struct(o["provider"].alias("provider"), o["url"].alias("url"), price(o).alias("price"), F.coalesce(x["discounts"], F.array().cast("array<string>")).alias("discounts"))).otherwise(o))
        return F.when(at >= 0, renewed).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(incoming, base, meet)


def upsert_events(stored: DataFrame, batch: DataFrame, seller: Callable[[Column], Column], authority: Callable[[Column], Column], generic: str = "Inne") -> DataFrame:
    """Store after a batch: (target, ord of the base row, town, date_start, title, url, description, image_url, discounts, offers, n_merged).

    Both sides: (ord, town, date_start, title, url, description, image_url, discounts array<string>, price, offers array<provider, url, price, discounts>), one order. A row
    without offers sells by its own link. An incoming row whose link is known replaces its row; others go into the first similar title of the town and day
    (``fuzzy_upsert``), which keeps its date and takes: the longest description, the last stored picture (else the first picture), the longest list of
    discounts, the last title longer than its own (of more than three letters), and the offers, sorted by authority; the first offer's link becomes the row's. Only
    what comes after the last replacement counts. The rest is inserted. Null lists count as empty; rows without a link get one made of town, title and date.

    Offers are reduced to one a seller and link before they are gathered, so that an event with a third of all rows gathers no more than its sellers.
    """
    none = F.array().cast("array<string>")

    def ready(df: DataFrame) -> DataFrame:
        link = F.coalesce(F.nullif(F.trim("url"), F.lit("")), local_url(F.col("town"), F.col("title"), F.col("date_start")))
        df = df.select("ord", "town", F.substring("date_start", 1, 10).alias("date_start"), "title", link.alias("url"), "description", "image_url", F.coalesce("discounts", none).alias("discounts"), "price", F.coalesce("offers", F.array().cast(f"array<{_OFFER}>")).cast(f"array<{_OFFER}>").alias("offers"))
        own = F.array(F.struct(seller(F.col("url")).alias("provider"), F.col("url").alias("url"), F.coalesce("price", F.lit("")).alias("price"), none.alias("discounts")))
        return df.withColumn("offers", F.when(F.size("offers") == 0, own).otherwise(F.col("offers")))

    s, b = cut(ready(stored)), cut(ready(batch))
    keyed = lambda df: df.select("town", "date_start", "ord", title_key(F.col("title")).alias("_k"), "url")
    acts = cut(fuzzy_upsert(keyed(s), keyed(b), ["town", "date_start"], "ord", "_k", "url"))
    replaced = acts.where("action = 'update'").groupBy("target").agg(F.max("ord").alias("_u"))
    targets = s.select(F.col("ord").alias("target")).union(acts.where("action = 'insert'").select("ord")).join(replaced, "target", "left")
    base = targets.withColumn("ord", F.coalesce("_u", "target")).join(s.unionByName(b), "ord")
    came = acts.where("action = 'merge'").join(replaced, "target", "left").where("_u is null or ord > _u").select("ord", "target").join(b, "ord")

    told = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    own = base.select("target", F.col("title").alias("_t"))
    fields = came.join(own, "target").groupBy("target").agg(
        F.count("*").alias("n_merged"),
        F.min(F.when(told("description"), F.struct((-F.length("description")).alias("n"), "ord", "description")))["description"].alias("_d"),
        F.max(F.when(F.col("image_url").contains(THUMBNAILS), F.struct("ord", "image_url")))["image_url"].alias("_thumb"), F.min(F.when(told("image_url"), F.struct("ord", "image_url")))["image_url"].alias("_img"),
        F.min(F.struct((-F.size("discounts")).alias("n"), "ord", "discounts"))["discounts"].alias("_disc"),
        F.max(F.when((F.length("title") > F.length(F.coalesce("_t", F.lit("")))) & (F.length("title") > 3), F.struct("ord", "title")))["title"].alias("_title"),
    )
    offer = came.select("target", "ord", F.posexplode("offers").alias("i", "o"))
    at = F.struct("ord", "i")
    offer = offer.groupBy("target", F.col("o.provider").alias("p"), url_identity(F.col("o.url")).alias("u")).agg(
        F.min(F.struct(at.alias("at"), F.col("o.url").alias("url"))).alias("f"), F.max(F.struct(at.alias("at"), F.col("o.discounts").alias("d")))["d"].alias("d"),
        F.min(F.when(~F.coalesce("o.price", F.lit("")).isin(NO_PRICE), F.struct(at.alias("at"), F.col("o.price").alias("price"))))["price"].alias("price"),
    )
    made = F.struct(F.col("p").alias("provider"), F.col("f.url").alias("url"), F.coalesce("price", F.lit("")).alias("price"), F.coalesce("d", none).alias("discounts"))
    offer = offer.groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("f.at").alias("at"), made.alias("o")))), lambda x: x["o"]).alias("_offers"))
    out = base.join(fields, "target", "left").join(offer, "target", "left")
    merged = _folded_offers(F.col("offers"), F.col("_offers"), generic)
    ranked = F.transform(F.array_sort(F.transform(merged, lambda o, i: F.struct((-authority(o["url"])).alias("a"), i.alias("i"), o.alias("o")))), lambda x: x["o"])
    longer_text = lambda a, b: F.when(F.length(F.coalesce(b, F.lit(""))) > F.length(F.coalesce(a, F.lit(""))), b).otherwise(a)
    offers = F.when(F.col("_offers").isNotNull(), ranked).otherwise(F.col("offers"))
    return out.select(
        "target", "ord", "town", "date_start", F.coalesce("_title", "title").alias("title"), "url", longer_text(F.col("description"), F.col("_d")).alias("description"),
        F.coalesce("_thumb", F.nullif("image_url", F.lit("")), "_img").alias("image_url"), F.when(F.size("_disc") > F.size("discounts"), F.col("_disc")).otherwise(F.col("discounts")).alias("discounts"),
        offers.alias("offers"), F.coalesce("n_merged", F.lit(0)).alias("n_merged"),
    )
