"""Driver queries of the point operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from plakat.operators.near import near_pairs
from plakat.plans.registry import Registry
from plakat.runtime import read_table

R = Registry()
PARKING_RADIUS_M = 250.0

_P3 = """
WITH a AS (SELECT place_id, geo.lat AS la, geo.lon AS lo FROM places_final WHERE geo.lat IS NOT NULL AND geo.lon IS NOT NULL AND NOT (geo.lat = 0 AND geo.lon = 0)),
b AS (SELECT osm_id, geo.lat AS la, geo.lon AS lo FROM parkings WHERE geo.lat IS NOT NULL AND geo.lon IS NOT NULL AND NOT (geo.lat = 0 AND geo.lon = 0))
SELECT DISTINCT place_id, osm_id FROM a JOIN b ON b.la BETWEEN a.la - 0.0023 AND a.la + 0.0023
WHERE 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(b.la - a.la) / 2), 2) + cos(radians(a.la)) * cos(radians(b.la)) * pow(sin(radians(b.lo - a.lo) / 2), 2)))) <= 250.0
"""


@R.add("p3_found", _P3)
def p3_found(spark, sf_dir):
    """Car parks within 250 m of each place."""
    places = read_table(spark, sf_dir, "places_final").select("place_id", F.col("geo.lat").alias("lat"), F.col("geo.lon").alias("lon"))
    parks = read_table(spark, sf_dir, "parkings").select("osm_id", F.col("geo.lat").alias("lat"), F.col("geo.lon").alias("lon"))
    out = near_pairs(places, parks, "place_id", "osm_id", "lat", "lon", "lat", "lon", PARKING_RADIUS_M)
    return out.select(F.col("left_id").alias("place_id"), F.col("right_id").alias("osm_id"))
