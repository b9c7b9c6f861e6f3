"""Driver queries of the subpackage."""

from __future__ import annotations

from pyspark.sql import functions as F

from plakat.llm import address, bpe, canonical, linkage, lookalike, mojibake, packing, pii, survivor
from plakat.plans.registry import Registry
from plakat.runtime import cut, read_table, spread

R = Registry()

def text_fields(spark, sf_dir, *names):
    """(tbl, row_key, field, value, is_json) of the named free-text fields."""
    at = {
        "title": ("event_records", "record_id", "title", False),
        "venue_name": ("event_records", "record_id", "analysis.ticket_info.venue_name", False),
        "name": ("places_final", "place_id", "name", False),
        "lead": ("places_final", "place_id", "editorial.lead", False),
        "payload": ("stored_events", "id", "payload", True),
    }
    out = None
    for n in names:
        t, key, path, js = at[n]
        df = read_table(spark, sf_dir, t).select(F.lit(t).alias("tbl"), F.col(key).cast("string").alias("row_key"), F.lit(n).alias("field"), F.col(path).alias("value"), F.lit(js).alias("is_json"))
        out = df if out is None else out.unionByName(df)
    return out


def _garbling(spark, sf_dir):
    """The one model of garbled text, fitted on the fields of problem 6; the same tables give the same model in every query."""
    return mojibake.fit(text_fields(spark, sf_dir, "title", "payload", "lead"))


def _showings(spark, sf_dir):
    rec = read_table(spark, sf_dir, "event_records")
    info = "analysis.ticket_info"
    rows = rec.select(
        F.col("record_id").alias("id"), "source", "title", F.col("date_start").alias("date"), "date_end", F.coalesce(F.nullif("time_start", F.lit("")), f"{info}.time_start").alias("start"),
        F.col(f"{info}.doors_open").alias("doors"), F.col(f"{info}.venue_name").alias("venue"), F.col(f"{info}.place_id").alias("place"), F.col("city").alias("town"), F.col("category").alias("kind"),
    )
    return linkage.showing_links(rows, _garbling(spark, sf_dir))


@R.add("p1_found")
def p1_found(spark, sf_dir):
    """Pairs of records of different feeds that mean the same showing."""
    return _showings(spark, sf_dir).select(F.col("id_a").alias("record_id_a"), F.col("id_b").alias("record_id_b"))


@R.add("p1_confidence")
def p1_confidence(spark, sf_dir):
    """The same pairs with their confidence."""
    return _showings(spark, sf_dir).select(F.col("id_a").alias("record_id_a"), F.col("id_b").alias("record_id_b"), "confidence")


def _lookalikes(spark, sf_dir):
    fields = text_fields(spark, sf_dir, "title", "venue_name", "name")
    garbled = mojibake.garbled_fields(text_fields(spark, sf_dir, "title"), _garbling(spark, sf_dir))
    return lookalike.lookalike_fields(fields, garbled)


@R.add("p2_found")
def p2_found(spark, sf_dir):
    """Titles, venue names and place names made of look-alike characters."""
    return _lookalikes(spark, sf_dir).select("tbl", "row_key", "field").distinct()


@R.add("p2_canonical")
def p2_canonical(spark, sf_dir):
    """The consistent form of each such field."""
    return _lookalikes(spark, sf_dir)


def _venue_names(spark, sf_dir, all_rows=False):
    """Records to be mapped with the resolved town, and their mapping."""
    ref = read_table(spark, sf_dir, "venue_refs").select(F.col("place_id").alias("entry"), F.col("name").alias("entry_name"), F.col("city").alias("area"), F.col("city_name").alias("area_name"))
    rec = read_table(spark, sf_dir, "event_records").select("record_id", "source", "city", "stage_name", F.col("analysis.ticket_info.venue_name").alias("name"), F.col("analysis.ticket_info.place_id").alias("place_id"))
    ids = ref.select(F.col("entry").alias("place_id")).distinct().withColumn("ok", F.lit(True))
    rec = cut(rec.join(ids, "place_id", "left"))  # the one reading of the records
    # A feed all of whose records lie in one town stands for that town where a record names none.
    town = rec.groupBy("source").agg(F.min("city").alias("lo"), F.max("city").alias("hi")).where("lo = hi").select("source", F.col("lo").alias("town"))
    popular = rec.where("ok").groupBy(F.col("place_id").alias("entry")).agg(F.count("*").alias("popular"))
    asked = rec.where(F.col("name").isNotNull() & F.col("name").rlike(r"(?U)[^\s\u200b-\u200f\u2060\ufeff]"))
    if not all_rows:
        asked = asked.where(F.col("ok").isNull())
    asked = asked.join(town, "source", "left").select("record_id", "name", "place_id", F.coalesce(F.nullif("city", F.lit("")), "town").alias("area"))
    halls = rec.select(F.explode(canonical.words(F.col("stage_name"))).alias("tok")).groupBy("tok").count().where("count > 1").select("tok")
    towns = ref.select(F.explode(canonical.words(F.col("area_name"))).alias("tok"))
    context = halls.union(towns).distinct()
    return asked, canonical.map_names(asked, ref, context, popular)


@R.add("p4_found")
def p4_found(spark, sf_dir):
    """The canonical venue of each record whose place_id is unusable, or 'none'."""
    asked, mapped = _venue_names(spark, sf_dir)
    mapped = mapped.select(F.col("name").alias("n2"), F.col("area").alias("a2"), "entry")
    out = asked.join(mapped, (F.col("name") == F.col("n2")) & F.col("area").eqNullSafe(F.col("a2")), "left")
    return out.select("record_id", F.coalesce("entry", F.lit("none")).alias("place_id"))


@R.add("p4_unmatched")
def p4_unmatched(spark, sf_dir):
    """Names that mean no venue of the list, with the number of records."""
    asked, mapped = _venue_names(spark, sf_dir)
    n = asked.groupBy("name", "area").agg(F.count("*").alias("records")).withColumnsRenamed({"name": "n2", "area": "a2"})
    return mapped.where("entry is null").join(n, (F.col("name") == F.col("n2")) & F.col("area").eqNullSafe(F.col("a2"))).select("name", F.col("area").alias("city"), "records")


def _addresses(spark, sf_dir):
    none = F.lit(None).cast("string")
    places = read_table(spark, sf_dir, "places_final").select(
        F.concat(F.lit("place:"), "place_id").alias("key"), F.lit("place").alias("side"), F.col("city_tag").alias("area"),
        "address.street", "address.housenumber", "address.city", "address.postcode", none.alias("line"),
    )
    doc = F.from_json("payload", "address string, city string, analysis struct<address: string>")
    events = read_table(spark, sf_dir, "stored_events").select("id", "city_tag", doc.alias("p")).select(
        F.concat(F.lit("event:"), F.col("id").cast("string")).alias("key"), F.lit("event").alias("side"), F.col("city_tag").alias("area"),
        none.alias("street"), none.alias("housenumber"), F.col("p.city").alias("city"), none.alias("postcode"),
        F.coalesce(F.nullif(F.trim("p.address"), F.lit("")), F.nullif(F.trim("p.analysis.address"), F.lit(""))).alias("line"),
    )
    return places.unionByName(events.where("line is not null"))


@R.add("p5_found")
def p5_found(spark, sf_dir):
    """Pairs of places, and of places and events, in the same building."""
    return address.same_building_pairs(address.buildings(spread(_addresses(spark, sf_dir))))


@R.add("p5_buildings")
def p5_buildings(spark, sf_dir):
    """The building of each address record, the class its pairs come from, with its number of links."""
    return address.with_links(address.buildings(spread(_addresses(spark, sf_dir))))


@R.add("p6_found")
def p6_found(spark, sf_dir):
    """Fields with garbled or lost letters."""
    fields = text_fields(spark, sf_dir, "title", "payload", "lead")
    return mojibake.garbled_fields(fields, _garbling(spark, sf_dir)).select("tbl", "row_key", "field")


@R.add("p6_restored")
def p6_restored(spark, sf_dir):
    """The chain predicted for each garbled field and the restored text."""
    fields = text_fields(spark, sf_dir, "title", "payload", "lead")
    return mojibake.garbled_fields(fields, _garbling(spark, sf_dir))


_P7 = r"""
WITH v AS (SELECT l.listing_id, l.version_id, f.trust, l.scraped_at, l.offer.url AS url, l.offer.price AS price, l.image_url, l.venue_name, count(*) OVER (PARTITION BY l.listing_id) AS n
  FROM listing_versions l LEFT JOIN feed_sources f USING (source)),
u AS (SELECT listing_id, 'url' AS field, version_id, trust, scraped_at FROM v WHERE n > 1 AND regexp_matches(url, '^https?://[^/]+\.')
  UNION ALL SELECT listing_id, 'price', version_id, trust, scraped_at FROM v WHERE n > 1 AND regexp_matches(lower(price), '[0-9]|bezpłatn|wstęp woln|darmow')
  UNION ALL SELECT listing_id, 'image_url', version_id, trust, scraped_at FROM v WHERE n > 1 AND regexp_matches(image_url, '^https?://[^/]+\.') AND NOT regexp_matches(image_url, 'blank_1x1|not-available')
  UNION ALL SELECT listing_id, 'venue_name', version_id, trust, scraped_at FROM v WHERE n > 1 AND length(trim(venue_name)) > 0
    AND trim(venue_name) NOT IN ('-', '???', 'brak', 'nie podano', 'do ustalenia', '[brak lokalizacji]', 'miejsce nieznane', 'wkrótce', 'TBA'))
SELECT listing_id, field, version_id FROM u
QUALIFY row_number() OVER (PARTITION BY listing_id, field ORDER BY trust DESC NULLS LAST, scraped_at DESC NULLS LAST, version_id) = 1
"""


@R.add("p7_found", _P7)
def p7_found(spark, sf_dir):
    """Surviving version of each field of each listing with two or more versions."""
    feeds = read_table(spark, sf_dir, "feed_sources").groupBy("source").agg(F.max("trust").alias("trust"))
    v = read_table(spark, sf_dir, "listing_versions").select("listing_id", "version_id", "source", "offer", "image_url", "venue_name", "scraped_at").join(feeds, "source", "left")
    url, price, image, venue = F.col("offer.url"), F.col("offer.price"), F.col("image_url"), F.col("venue_name")
    fields = {"url": (url, survivor.url_says(url)), "price": (price, survivor.price_says(price)), "image_url": (image, survivor.image_says(image)), "venue_name": (venue, survivor.says_something(venue))}
    return survivor.surviving_values(v, "listing_id", "version_id", fields, F.col("trust"), F.col("scraped_at")).select("listing_id", "field", "version_id")


@R.add("p8_ids")
def p8_ids(spark, sf_dir):
    """Token ids of every document by byte_bpe_50k."""
    return bpe.token_ids(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


@R.add("p9_packing")
def p9_packing(spark, sf_dir):
    """Containers of 2,048 tokens holding every document."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packing.pack_documents(bpe.token_ids(docs, "doc_id", "text", count_only=True), "doc_id")


@R.add("p10_found")
def p10_found(spark, sf_dir):
    """Spans of personal data in the documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = pii.fit(docs, "doc_id", "text")
    return pii.found_spans(spread(docs), "doc_id", "text", weights).select("doc_id", "pii_type", "found").distinct()


#: Setting that holds the secret of the pseudonyms; the fallback is an example for tests.
PSEUDONYM_KEY, EXAMPLE_KEY = "spark.plakat.pseudonym.key", "p10 example key"


@R.add("p10_masked")
def p10_masked(spark, sf_dir):
    """The documents with typed, linkable placeholders."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.masked_texts(spread(docs), "doc_id", "text", spark.conf.get(PSEUDONYM_KEY, EXAMPLE_KEY), pii.fit(docs, "doc_id", "text"))
