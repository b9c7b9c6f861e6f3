"""Joins: nearest neighbours, venue resolution, and checks of references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plakat.operators.dedup import first_by
from plakat.operators.near import EARTH_RADIUS_M, near_pairs, usable_point
from plakat.runtime import cut


def knn(left: DataFrame, right: DataFrame, k: int, radius_m: float, left_id: str = "id", right_id: str = "id", lat: str = "lat", lon: str = "lon", exclude_self: bool = False) -> DataFrame:
    """The ``k`` nearest right rows within a radius: (left_id, right_id, distance_m, rank).

    Ties go to the smaller id. The window keeps ``k`` rows a left row before the
    shuffle (WindowGroupLimit). Rows without a usable point are left out.
    """
    p = near_pairs(left, right, left_id, right_id, lat, lon, lat, lon, radius_m, best=k, exclude_self=exclude_self)
    w = W.partitionBy("left_id").orderBy("distance_m", "right_id")
    return p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(left: DataFrame, right: DataFrame, left_id: str = "id", right_id: str = "id", lat: str = "lat", lon: str = "lon", start_m: float = 1_000.0) -> DataFrame:
    """The nearest right row however far: (left_id, right_id, distance_m).

    The radius grows eightfold for the rows still without a neighbour, so dense places never pay for remote ones. Each round is one
    checkpoint of the neighbours found; the loop ends when all points have one, or at half the way round the earth (seven rounds at most).
    """
    usable = left.where(F.col(left_id).isNotNull() & usable_point(F.col(lat), F.col(lon)))
    missing = usable.select(F.countDistinct(left_id)).first()[0]
    out, rest, r = None, usable, start_m
    while True:
        got = cut(knn(rest, right, 1, r, left_id, right_id, lat, lon).select("left_id", "right_id", "distance_m"))
        out = got if out is None else out.unionByName(got)
        missing -= got.count()
        if r >= EARTH_RADIUS_M * 3.15 or missing <= 0:
            return out
        rest = usable.join(out.select(F.col("left_id").alias("_l")), F.col(left_id).cast("string") == F.col("_l"), "left_anti")
        r = min(r * 8, EARTH_RADIUS_M * 3.15)


def resolve(events: DataFrame, key: str, ids: Column, places: DataFrame, by_rule: DataFrame | None = None, by_text: DataFrame | None = None) -> DataFrame:
    """Venue of each event by a cascade: known id, then rule, then text: (key, place_id, how).

    ``by_rule`` and ``by_text`` are (key, place_id) tables made for rows without a known id; a later step only counts
    where the earlier ones found nothing. An id that isn't in ``places`` is kept as it is if no step finds better.
    """
    known = places.select(F.col("place_id").alias("_p")).distinct()
    out = events.select(key, F.nullif(ids, F.lit("")).alias("_own")).join(known, F.col("_own") == F.col("_p"), "left")
    found, how = F.col("_p"), F.when(F.col("_p").isNotNull(), "id")
    for name, step in (("rule", by_rule), ("text", by_text)):
        if step is not None:
            out = out.join(step.select(F.col(key).alias(f"_k{name}"), F.col("place_id").alias(f"_{name}")), F.col(key) == F.col(f"_k{name}"), "left")
            how = F.coalesce(how, F.when(F.col(f"_{name}").isNotNull(), name))
            found = F.coalesce(found, F.col(f"_{name}"))
    return out.select(key, F.coalesce(found, F.col("_own")).alias("place_id"), F.coalesce(how, F.when(F.col("_own").isNotNull(), "own"), F.lit("none")).alias("how"))


def contains_either_way(a: Column, b: Column) -> Column:
    """One text within the other or equal, without case; empty texts match nothing."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))


def held_names(rows: DataFrame, names: DataFrame, block: str, text: str, name: str) -> DataFrame:
    """Rows with the names of their block that hold their text or lie in it: each distinct text of a block meets the block's distinct names once."""
    texts, known = rows.select(block, text).distinct(), names.select(block, name).distinct()
    hit = texts.join(known, block).where(contains_either_way(F.col(text), F.col(name)))
    return rows.join(hit, [block, text]).join(names, [block, name])


def dead_keys(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose non-null key isn't among the keys."""
    return rows.where(F.col(on).isNotNull()).join(keys.select(on).distinct(), on, "left_anti")


def without_partner(keys: DataFrame, rows: DataFrame, on: str) -> DataFrame:
    """Keys no row refers to."""
    return keys.join(rows.select(on).where(F.col(on).isNotNull()).distinct(), on, "left_anti")


def with_details(rows: DataFrame, details: DataFrame, link: str) -> DataFrame:
    """Rows with the details of their link (url, ...); of several details of a link the one that sorts first. Rows without any keep nulls."""
    one = details.where(F.col("url").isNotNull()).groupBy("url").agg(*[F.min(c).alias(c) for c in details.columns if c != "url"]) if len(details.columns) == 2 else first_by(details.where(F.col("url").isNotNull()), ["url"], *[c for c in details.columns if c != "url"])
    return rows.join(one, rows[link] == one["url"], "left").drop("url")


def cached(rows: DataFrame, cache: DataFrame, link: str) -> DataFrame:
    """Rows whose link the cache holds."""
    return rows.join(cache.select(link), link, "left_semi")
