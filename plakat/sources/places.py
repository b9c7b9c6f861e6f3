"""Places: JSON lists or maps, and map elements chosen by tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plakat.functions.geo import coordinate, in_box
from plakat.functions.nested import tag
from plakat.operators.dedup import first_by
from plakat.operators.poi import group_of

_ITEM = "place_id: string, id: string, name: string, poi_group: string, category: string, raw_amenity: string, geo: struct<lat: double, lon: double>, coordinates: struct<lat: double, lon: double>, lat: double, lon: double, address: string, wheelchair: string, phone: string, website: string"
_ADDRESS = "street string, housenumber string, city string"


def read_places(spark: SparkSession, path: str, fallback: str | None = None) -> DataFrame:
    """Places of a JSON file that is a list or a map of objects.

    Key: ``place_id``, else ``id``, else 'idx-' and the position; of equal keys the last wins. Coordinates come from the first of geo, coordinates
    and the top level that is neither null nor zero; an address may be an object or text. Without the file the fallback is read; a file that isn't JSON gives no rows.
    """
    try:
        whole = spark.read.text(path, wholetext=True)
    except Exception:
        if fallback is None:
            raise
        return read_places(spark, fallback)
    as_list = F.from_json("value", f"array<struct<{_ITEM}>>")
    as_map = F.map_values(F.from_json("value", f"map<string, struct<{_ITEM}>>"))
    items = F.when(F.ltrim("value").startswith("["), as_list).otherwise(as_map)
    rows = whole.select(F.posexplode(F.coalesce(items, F.array().cast(f"array<struct<{_ITEM}>>"))).alias("pos", "p")).where("p is not null")
    key = F.coalesce(F.nullif("p.place_id", F.lit("")), F.nullif("p.id", F.lit("")), F.concat(F.lit("idx-"), F.col("pos").cast("string")))
    a = F.from_json("p.address", _ADDRESS)
    out = rows.select(
        key.alias("place_id"), "p.name", F.coalesce("p.poi_group", "p.category").alias("poi_group"), "p.raw_amenity",
        coordinate(F.col("p.geo.lat"), F.col("p.coordinates.lat"), F.col("p.lat")).alias("lat"), coordinate(F.col("p.geo.lon"), F.col("p.coordinates.lon"), F.col("p.lon")).alias("lon"),
        F.coalesce(a["street"], F.when(~F.ltrim("p.address").startswith("{"), F.col("p.address"))).alias("street"), a["housenumber"].alias("housenumber"), a["city"].alias("city"), "p.phone", "p.website", "p.wheelchair", (-F.col("pos")).alias("_o"),
    )
    return first_by(out, ["place_id"], "_o").drop("_o")


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Map elements of an export {elements: [...]}: (osm_id, lat, lon, tags); centres stand in for missing points."""
    doc = "elements array<struct<type: string, id: bigint, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string, string>>>"
    e = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", doc)["elements"]).alias("e"))
    return e.select(F.concat_ws("/", "e.type", F.col("e.id").cast("string")).alias("osm_id"), F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce("e.lon", "e.center.lon").alias("lon"), F.coalesce("e.tags", F.create_map().cast("map<string,string>")).alias("tags"))


def choose(elements: DataFrame, selectors: dict[str, str], box: tuple[float, float, float, float] | None = None, none_of: dict[str, str] | None = None) -> DataFrame:
    """Elements one of whose tags matches its pattern, inside a box (south, west, north, east), without tags that match an excluded pattern."""
    hit: Column = F.lit(False)
    for k, p in selectors.items():
        hit = hit | F.coalesce(F.element_at("tags", k).rlike(p), F.lit(False))
    for k, p in (none_of or {}).items():
        hit = hit & ~F.coalesce(F.element_at("tags", k).rlike(p), F.lit(False))
    if box:
        hit = hit & in_box(F.col("lat"), F.col("lon"), *box)
    return elements.where(hit)


def places_of(elements: DataFrame) -> DataFrame:
    """Map elements as places: name, group and contacts with alternative tags; unnamed ones are dropped."""
    t = F.col("tags")
    amenity = F.coalesce(tag(t, "amenity"), tag(t, "leisure"), tag(t, "tourism"), tag(t, "shop"))
    return elements.select(
        F.col("osm_id").alias("place_id"), tag(t, "name").alias("name"), group_of(t).alias("poi_group"), amenity.alias("raw_amenity"), "lat", "lon",
        tag(t, "addr:street", "addr:place").alias("street"), tag(t, "addr:housenumber").alias("housenumber"), tag(t, "addr:city").alias("city"),
        tag(t, "phone", "contact:phone").alias("phone"), tag(t, "website", "contact:website").alias("website"), tag(t, "wheelchair").alias("wheelchair"),
    ).where("name is not null")


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines sink."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
