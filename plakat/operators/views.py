"""View tables: what pages show, without markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plakat.functions.dates import long_date
from plakat.functions.nested import address_line
from plakat.functions.text import NO_TITLE, clean_title, slugify, venue_display
from plakat.operators.agenda import active, badge
from plakat.operators.dedup import unique_slugs
from plakat.operators.rules import access
from plakat.runtime import cut


def pages(events: DataFrame, venues: DataFrame, day: Column) -> DataFrame:
    """One row an event with its venue looked up: (record_id, title, day, venue, address)."""
    v = venues.select(F.col("place_id").alias("_p"), "name", F.concat_ws(" ", "street", "housenumber").alias("_a"))
    out = events.join(v, F.col("analysis.ticket_info.place_id") == F.col("_p"), "left")
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit(NO_TITLE))
    return out.select("record_id", title.alias("title"), day.alias("day"), F.coalesce("name", "analysis.ticket_info.venue_name").alias("venue"), F.when(F.col("_p").isNotNull(), F.col("_a")).alias("address"))


def page_model(events: DataFrame, venues: DataFrame, as_of: Column, day: Column, town: str) -> DataFrame:
    """The whole page of each event: slug, cleaned title, shown date, badge, venue with stage, address, lead, defaults of missing fields, access, offers.

    Composes the cleaning of titles, long dates, unique slugs, the venue by id, the cascade of access flags and the offers of sellers. Events without a title or a
    date have no page. Links without an offer sell by themselves.
    """
    told = lambda c: F.nullif(F.col(c), F.lit(""))
    info = "analysis.ticket_info"
    v = venues.select(F.col("place_id").alias("_p"), F.col("name").alias("_name"), F.concat_ws(" ", "street", "housenumber").alias("_a"), F.col("city_name").alias("_town"))
    e = events.withColumns({"_shown": clean_title(F.col("title")), "_date": F.coalesce(day.cast("string"), told("date_start")), "_base": slugify(F.coalesce(told("category"), F.lit("wydarzenie")))}).where("coalesce(title, '') <> '' and _date is not null")
    e = unique_slugs(e, "_base", "_date", "time_start", "record_id")
    e = e.join(v, F.col(f"{info}.place_id") == F.col("_p"), "left")
    venue = F.coalesce("_name", told(f"{info}.venue_name"), F.lit(NO_TITLE))
    end = F.coalesce(F.try_to_date(told("date_end")), day, F.try_to_date("_date"))
    return e.select(
        "record_id", "slug", F.col("_shown").alias("title"), long_date(F.col("_date")).alias("date_shown"), badge(day, end, as_of).alias("badge"),
        F.coalesce(told(f"{info}.time_start"), told("time_start"), F.lit("18:00")).alias("time_start"), venue_display(venue, F.col("stage_name")).alias("venue"),
        F.when(F.col("_p").isNotNull(), address_line(F.col("_a"), F.col("_town"))).otherwise(F.lit(town)).alias("address"),
        F.coalesce(told("category"), F.lit("Kultura i Rozrywka")).alias("category"), F.coalesce(told("organizer"), F.col("source"), venue).alias("organizer"),
        F.coalesce(F.nullif(F.substring("description", 1, 180), F.lit("")), F.concat("_shown", F.lit("."))).alias("lead"), told(f"{info}.doors_open").alias("doors_open"), told("age_limit").alias("age_limit"),
        access(F.col("wheelchair_accessible").cast("string"), F.when(F.col("_p").isNotNull(), "limited")).alias("access"), F.size(F.coalesce("ticket_offers", F.array())).alias("n_offers"), told("image_url").alias("image_url"),
    )


def place_pages(places: DataFrame, events: DataFrame, place: Column, as_of: Column, shown_always: Column, most: int = 40) -> DataFrame:
    """Pages of places with their next events: (place_id, name, position, record_id, n_upcoming); places of always shown kinds come without events too.

    Only the first ``most`` events of a place are listed (the page's length), all are counted.
    """
    up = active(events.withColumn("_place", place), as_of).where("_place is not null").select("_place", "record_id", "date_start")
    n = up.groupBy("_place").agg(F.count("*").alias("n_upcoming"))
    top = up.withColumn("position", F.row_number().over(W.partitionBy("_place").orderBy("date_start", "record_id"))).where(F.col("position") <= most).drop("date_start")
    out = places.withColumn("_always", shown_always).join(n, F.col("place_id") == F.col("_place"), "left").drop("_place").where("n_upcoming is not null or _always")
    return out.join(top, F.col("place_id") == F.col("_place"), "left").select("place_id", "name", "position", "record_id", F.coalesce("n_upcoming", F.lit(0)).alias("n_upcoming"))


def linked_data(events: DataFrame, venues: DataFrame) -> DataFrame:
    """Events as linked data: dates, status, location with address, and offers."""
    v = venues.select(F.col("place_id").alias("_p"), F.col("name").alias("_n"), F.concat_ws(" ", "street", "housenumber").alias("_a"))
    e = events.join(v, F.col("analysis.ticket_info.place_id") == F.col("_p"), "left")
    status = F.when(F.col("status") == "cancelled", "EventCancelled").otherwise("EventScheduled")
    links = F.filter(F.transform(F.coalesce("ticket_offers", F.array()), lambda o: o["url"]), lambda u: F.coalesce(u, F.lit("")) != "")
    return e.select(
        "record_id", F.col("title").alias("name"), F.col("date_start").alias("start_date"), F.coalesce(F.nullif("date_end", F.lit("")), "date_start").alias("end_date"), status.alias("event_status"),
        F.coalesce("_n", "analysis.ticket_info.venue_name").alias("location"), F.col("_a").alias("street_address"), F.array_join(links, " ").alias("offers"), F.size(links).alias("n_offers"),
    )


def schema_org(events: DataFrame) -> DataFrame:
    """Event fields as linked data names them."""
    status = F.when(F.col("status") == "cancelled", "EventCancelled").otherwise("EventScheduled")
    return events.select("record_id", F.col("title").alias("name"), F.col("date_start").alias("start_date"), status.alias("event_status"))


def build_checks(pages_: DataFrame, body: str) -> DataFrame:
    """Number of pages, of empty ones and of those that show 'None'."""
    b = F.col(body)
    return pages_.agg(F.count("*").alias("n"), F.count_if(F.length(F.coalesce(b, F.lit(""))) == 0).alias("empty_pages"), F.count_if(F.coalesce(b.contains("None"), F.lit(False))).alias("leaks"))


def running_ids(df: DataFrame, order: str, prefix: str, name: str) -> DataFrame:
    """Consecutive ids in the order of a column: range partitions are numbered apart and offset by the sizes before them.

    A window without a partition would sort everything in one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    parts = cut(parts)
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_c"), F.min("_i").alias("_m"))  # one row a partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    out = parts.join(F.broadcast(before), "_p")
    number = F.col("_before") + F.col("_i") - F.col("_m") + 1
    padded = F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string"))
    return out.withColumn(name, F.concat(F.lit(prefix), padded)).drop("_p", "_i", "_before", "_m")
